"""Mixing sources to target weights by repetition rates.

Words are summed by source (combined before the shuffle, so a hot source is
one row from each task).  The weights share 150 % of all words; a target stops
at twice its source's words and the rest is shared anew by weight.  Since
capped sources are those with the least cap for their weight, the fixed point
is found by prefix sums over the sources in that order, made over ranges of
sources so that any number of them will do.  A document is taken
floor(rate) times, and once more if a hash of its id, its text and its number among equal rows falls below the fraction.

Only DataFrame functions are used, and all target arithmetic is on integers of
up to 38 digits up to one last division.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import materialise
from .columns import BLANKS, count_words, few, running

WEIGHTS, SEED = (3, 1, 2), "mix-1"


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target for (source, size) rows; places and sums run over ranges of the sources."""
    exact = lambda c: c.cast("decimal(38,0)")
    sums = materialise(sizes.groupBy("source").agg(exact(F.sum("size")).alias("source_size")), "sources")
    by_name = [F.col("source").isNull(), F.col("source")]
    sums = running(sums, by_name, {"place": F.lit(1)})
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("place") % len(WEIGHTS)).cast("int") + 1)
    sums = sums.withColumn("weight", exact(weight)).drop("place")
    # 2 * source_size / weight ascending; products of integers compare the quotients by one value
    lcm = math.lcm(*WEIGHTS)
    by_cap = [exact(F.col("source_size") * F.element_at(F.create_map(*[F.lit(x) for w in sorted(set(WEIGHTS)) for x in (w, lcm // w)]), F.col("weight").cast("int"))), *by_name]
    sums = materialise(running(sums, by_cap, {"before": F.col("source_size"), "weights": F.col("weight")}), "caps")
    total, whole = sums.agg(F.sum("source_size"), F.sum("weight")).first()
    if not total:  # no words at all: nothing is taken
        return sums.select("source", "source_size", F.lit(0.0).alias("target"))
    # the level (words a unit of weight), times two: (3 total - 4 before) / weights from here on, of the first source that stays below its cap
    num, den = exact(3 * F.lit(total) - 4 * F.col("before")), exact(F.lit(whole) - F.col("weights"))
    open_ = exact(F.col("weight") * num) <= exact(4 * F.col("source_size") * den)
    first = sums.where(open_).agg(F.min(F.struct("before", num.alias("num"), den.alias("den"))).alias("level")).first()["level"]
    num, den = (F.lit(first[x] if first else None).cast("decimal(38,0)") for x in ("num", "den"))
    free = F.coalesce(exact(F.col("weight") * num) < exact(4 * F.col("source_size") * den), F.lit(False))
    target = F.when(free, exact(F.col("weight") * num).cast("double") / exact(2 * den).cast("double")).otherwise((2 * F.col("source_size")).cast("double"))
    return sums.select("source", "source_size", target.alias("target"))


def draw(doc_id: Column, text_md5: Column, nth: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on the seed, the id, the text and the row's number among equal rows alone."""
    name = F.concat_ws("/", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), text_md5, nth.cast("string"))
    return F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_nth``: 0, 1, ... among rows of one id, source and text.

    Equal rows are interchangeable, so any order numbers them.  Only repeated
    rows are dealt out, by the partition in which they stand; the numbers of a
    partition begin after those of the partitions before.
    """
    key = ["_id", "_source", "_text"]
    repeated = materialise(docs.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*(F.col(k).alias(f"{k}_again") for k in key)), "repeated")
    if repeated.isEmpty():
        return docs.withColumn("_nth", F.lit(0).cast("long"))
    again = few(repeated)
    same = lambda left, right, mark: reduce(and_, (left[k].eqNullSafe(right[k + mark]) for k in key))
    once = docs.join(again, same(docs, again, "_again"), "left_anti").withColumn("_nth", F.lit(0).cast("long"))
    some = materialise(docs.join(again, same(docs, again, "_again"), "left_semi").withColumn("_place", F.monotonically_increasing_id()), "again")
    some = some.withColumn("_chunk", F.shiftright("_place", 33))
    counts = some.groupBy(*key, "_chunk").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*(F.col(k).alias(f"{k}_here") for k in key), F.col("_chunk").alias("_chunk_here"), before.alias("_before"))
    inside = some.withColumn("_inside", F.row_number().over(Window.partitionBy(*key, "_chunk").orderBy("_place")) - 1)
    placed = inside.join(counts, same(inside, counts, "_here") & (inside["_chunk"] == counts["_chunk_here"]))
    return once.unionByName(placed.withColumn("_nth", F.col("_before") + F.col("_inside")).select(*once.columns))


def mix(documents: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source, source_size, target, copies (and the columns ``carry``, whose names start with an underscore) for every row of ``documents``.

    A null text has size 0; a source whose texts have no words gets target 0
    and its documents no copy.  A null source is the last source.  Every row has a
    draw of its own, equal rows by their number among each other.  An empty table gives an empty result.
    """
    docs = documents.select(F.col("doc_id").alias("_id"), F.col("source").cast("string").alias("_source"), count_words(F.col("text"), BLANKS).alias("_size"), F.md5(F.coalesce(F.col("text"), F.lit(""))).alias("_text"), *carry)
    goals = few(targets(docs.select(F.col("_source").alias("source"), F.col("_size").alias("size"))), 100_000)
    docs = _numbered(docs)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    both = docs.join(goals, docs["_source"].eqNullSafe(goals["source"]), "left").withColumn("_rate", rate)
    copies = F.floor("_rate") + (draw(F.col("_id"), F.col("_text"), F.col("_nth")) < F.col("_rate") - F.floor("_rate")).cast("long")
    return both.select(F.col("_id").alias("doc_id"), F.col("_size").alias("size"), F.col("_source").alias("source"), F.col("source_size").cast("long").alias("source_size"), "target", copies.cast("long").alias("copies"), *carry)


def mixed(documents: DataFrame) -> DataFrame:
    """The mixture itself: each row of ``documents``, as often as it is taken."""
    whole = documents.select("doc_id", "text", "source", F.struct(*documents.columns).alias("_row"))
    out = mix(whole, ("_row",)).where("copies > 0")
    return out.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("_row.*")
