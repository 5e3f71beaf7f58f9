"""Multi-party perspective rotation.

For every participant of a conversation the dialogue is rendered with that
speaker as the assistant, system turns as they are and everybody else as a
named user; the spans of the assistant's words are the training mask.

There is one row for each conversation and participant, however long.  A
dialogue of up to BLOCK turns is gathered and rendered at once.  Of a longer
one the places of the turns come from ranges of their sorted order, blocks of BLOCK turns
are rendered by many tasks, and a row is put together from its rendered
blocks; so only the finished text of a row must fit a task.  Both ways give the same row.
Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import materialise
from .columns import few

#: Turns that are rendered together.
BLOCK = 256
SYSTEM = "system"
#: The marks of the rendering.
SYSTEM_HEAD, OWN_HEAD, USER_HEAD, USER_TAIL, END = "<|system|>\n", "<|assistant|>\n", "<|user name=", "|>\n", "<|end|>\n"


def _turns(conversations: DataFrame) -> DataFrame:
    """conv_id, late, turn, name, content: rows in the order in which they are sorted; ``shown`` is the name as a header shows it."""
    name = F.coalesce(F.col("role").cast("string"), F.lit("unknown"))
    shown = F.regexp_replace(F.replace(F.replace(name, F.lit("<|"), F.lit("< |")), F.lit("|>"), F.lit("| >")), "[\\r\\n]", " ")
    content = F.replace(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit("<|"), F.lit("< |"))
    turn = F.col("turn").cast("long")
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), turn.isNull().alias("late"), turn.alias("turn"), name.alias("name"), content.alias("content"), shown.alias("shown"))


def _ranked(turns: DataFrame) -> DataFrame:
    """``turns`` of long dialogues with ``place`` in the sorted order of their conversation, from 0."""
    order = ["conv_id", "late", "turn", "name", "content", "spread"]  # the last divides equal rows, whose order makes no difference
    ranged = turns.withColumn("spread", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = materialise(ranged.drop("spread").withColumns({"range": F.spark_partition_id(), "row": F.monotonically_increasing_id()}), "ranges")
    counts = ranged.groupBy("conv_id", "range").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = few(materialise(counts.select(F.col("conv_id").alias("c"), F.col("range").alias("r"), (before - F.col("first")).alias("add")), "range_counts"))
    return ranged.join(counts, ranged["conv_id"].eqNullSafe(counts["c"]) & (ranged["range"] == counts["r"])).withColumn("place", F.col("row") + F.col("add")).drop("c", "r", "add", "range", "row")


def _starts(ranked: DataFrame, people: DataFrame) -> DataFrame:
    """(conv_id, speaker, block, block_start) of long dialogues, from the lengths of their turns alone."""
    as_user = F.when(F.col("name") == SYSTEM, F.lit(len(SYSTEM_HEAD))).otherwise(len(USER_HEAD + USER_TAIL) + F.length("shown"))
    sizes = ranked.groupBy("conv_id", "block").agg(F.sum(as_user + F.length("content") + len(END)).alias("size"))
    own = ranked.groupBy(F.col("conv_id").alias("c"), F.col("name").alias("n"), F.col("block").alias("b")).agg(F.sum(len(OWN_HEAD) - as_user).alias("less"))
    both = sizes.join(people, sizes["conv_id"].eqNullSafe(people["p"]), "left").drop("p")
    both = both.join(own, both["conv_id"].eqNullSafe(own["c"]) & (both["speaker"] == own["n"]) & (both["block"] == own["b"]), "left")
    earlier = Window.partitionBy("conv_id", "speaker").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("size") + F.coalesce("less", F.lit(0))).over(earlier), F.lit(0))
    return both.select(F.col("conv_id").alias("c"), F.col("speaker").alias("s"), F.col("block").alias("b"), start.cast("long").alias("block_start"))


def _rendered(gathered: DataFrame, people: DataFrame) -> DataFrame:
    """conv_id, speaker, block, n_turns, n_own, dialogue, own (start and end of own contents) of (conv_id, block, turns)."""
    both = gathered.join(people, gathered["conv_id"].eqNullSafe(people["p"]), "left").drop("p")
    own = lambda t: F.coalesce(t["name"] == F.col("speaker"), F.lit(False))

    def header(t: Column) -> Column:
        return F.when(t["name"] == SYSTEM, F.lit(SYSTEM_HEAD)).when(own(t), F.lit(OWN_HEAD)).otherwise(F.concat(F.lit(USER_HEAD), t["shown"], F.lit(USER_TAIL)))

    pieces = F.transform("turns", lambda t: F.struct(header(t).alias("head"), t["content"].alias("content"), own(t).alias("own")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(a: Column, p: Column) -> Column:
        begin = a["at"] + F.length(p["head"])
        end = begin + F.length(p["content"])
        span = F.struct(begin.cast("long").alias("start"), end.cast("long").alias("end"))
        return F.struct((end + len(END)).alias("at"), F.when(p["own"], F.array_append(a["spans"], span)).otherwise(a["spans"]).alias("spans"))

    return both.select("conv_id", "speaker", "block", pieces.alias("pieces")).select(
        "conv_id", "speaker", "block",
        F.size("pieces").cast("long").alias("n_turns"), F.size(F.filter("pieces", lambda p: p["own"])).cast("long").alias("n_own"),
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["content"], F.lit(END))), "").alias("dialogue"),
        F.aggregate("pieces", start, step, lambda a: a["spans"]).alias("own"),
    )


def _mask(own: Column) -> Column:
    return F.array_join(F.transform(own, lambda x: F.concat(x["start"].cast("string"), F.lit(":"), x["end"].cast("string"))), ",")


def _whole(parts: DataFrame) -> DataFrame:
    """One row for each conversation and speaker from its rendered blocks, whose places count from ``block_start``."""
    moved = F.transform("own", lambda x: F.struct((x["start"] + F.col("block_start")).alias("start"), (x["end"] + F.col("block_start")).alias("end")))
    piece = F.struct("block", "dialogue", moved.alias("own"))
    whole = parts.groupBy("conv_id", "speaker").agg(F.sum("n_turns").alias("n_turns"), F.sum("n_own").alias("n_own"), F.sort_array(F.collect_list(piece)).alias("pieces"))  # the text of one row
    return whole.select("conv_id", "speaker", "n_turns", "n_own", F.array_join(F.transform("pieces", lambda p: p["dialogue"]), "").alias("dialogue"), _mask(F.flatten(F.transform("pieces", lambda p: p["own"]))).alias("mask"))


def rotate(conversations: DataFrame) -> DataFrame:
    """conv_id, speaker, n_turns, n_own, dialogue, mask, one row for each conversation and participant.

    ``mask`` lists start:end of the speaker's contents in ``dialogue`` (code
    points, end exclusive).  Turns go by turn, then role, then text; null turns come
    last.  A null role is the participant ``unknown``, a null text is empty, a
    null conv_id is one conversation.  A conversation of system turns alone
    gives one row with a null speaker.  Repeated rows are repeated turns.  The
    mark ``<|`` inside names and contents becomes ``< |``, in names ``|>``
    becomes ``| >`` and line breaks become blanks, so no text forges a header;
    participants stay apart by their names as they are.
    """
    turns = _turns(conversations)
    people = turns.where(F.col("name") != SYSTEM).select(F.col("conv_id").alias("p"), F.col("name").alias("speaker")).distinct()
    long = turns.groupBy("conv_id").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select(F.col("conv_id").alias("l"))
    long = materialise(long, "long")
    whole = turns
    if not long.isEmpty():
        long = few(long)
        whole = turns.join(long, turns["conv_id"].eqNullSafe(long["l"]), "left_anti")
    gathered = whole.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("late", "turn", "name", "content", "shown"))).alias("turns"))  # at most BLOCK turns
    out = _rendered(gathered.withColumn("block", F.lit(0).cast("long")), people).select("conv_id", "speaker", "n_turns", "n_own", "dialogue", _mask(F.col("own")).alias("mask"))
    if long.isEmpty():
        return out
    ranked = _ranked(turns.join(long, turns["conv_id"].eqNullSafe(long["l"]), "left_semi"))
    ranked = ranked.withColumn("block", F.floor(F.col("place") / BLOCK))
    blocks = ranked.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list(F.struct("place", "name", "content", "shown"))).alias("turns"))
    parts, starts = _rendered(blocks, people), _starts(ranked, people)
    on = parts["conv_id"].eqNullSafe(starts["c"]) & parts["speaker"].eqNullSafe(starts["s"]) & (parts["block"] == starts["b"])
    return out.unionByName(_whole(parts.join(starts, on).drop("c", "s", "b")))


ORACLE_SQL = """
with turns as (
  select conv_id, turn, coalesce(role, 'unknown') as name, replace(coalesce(text, ''), '<|', '< |') as content,
    regexp_replace(replace(replace(coalesce(role, 'unknown'), '<|', '< |'), '|>', '| >'), '[\\r\\n]', ' ', 'g') as shown
  from conversations
), placed as (
  select *, row_number() over (partition by conv_id order by turn nulls last, name, content) as k from turns
), people as (
  select distinct conv_id, name as speaker from turns where name <> 'system'
), pieces as (
  select t.conv_id, p.speaker, k, content, coalesce(name = speaker, false) as own,
    case when name = 'system' then '<|system|>' || chr(10) when name = speaker then '<|assistant|>' || chr(10) else '<|user name=' || shown || '|>' || chr(10) end as head
  from placed t left join people p on t.conv_id is not distinct from p.conv_id
), spans as (
  select *, head || content || '<|end|>' || chr(10) as piece,
    sum(length(head) + length(content) + 8) over (partition by conv_id, speaker order by k rows between unbounded preceding and current row) - length(content) - 8 as start
  from pieces
)
select conv_id, speaker, count(*) as n_turns, count(*) filter (where own) as n_own, string_agg(piece, '' order by k) as dialogue,
  coalesce(string_agg(cast(start as bigint) || ':' || cast(start + length(content) as bigint), ',' order by k) filter (where own), '') as mask
from spans group by conv_id, speaker
"""
