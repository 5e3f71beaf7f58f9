"""Toxicity by class-conditional Kneser-Ney models.

Two models, of toxic and of ordinary labelled texts, spell words character by
character: each gives the next character, or the end of the word, after up to
ORDER - 1 characters of the word.  The highest order has counts and discounts
of the class; an expression that a class has rarely or never seen backs off to
lower orders that both classes share, by continuation counts: in how many
contexts of either class it was seen.  So rare and unknown words are judged by
the parts that they share with known ones, and where neither class knows more,
both models agree and the evidence is 0.

A word's evidence is the log-likelihood of its spelling in the toxic model less
that in the ordinary one.  The evidence of a run of words is divided by its
length, and a text has the greatest evidence of all its runs of one length
(0 is the whole text); a shorter text counts as if neutral words were added.
The length is chosen by tuning rows.

Counts come from all labelled training rows, exact copies once, and are kept
whole, as tables.  Log ratios are worked out by joins of these tables.  Up to
HOT of them are sent to all executors.  Where there are more, those that make
up at least 1 / HOT of all that is counted are sent (so at most HOT), and the
texts' other expressions go as rows to the table of the rest.

Rows with crc32(doc_id) mod 5 = 0 are held out of everything.  Of the others
the remainder 4 only sets the length and the cutoff, the rest are counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import materialise
from .columns import few
from .words import ALNUM_RULE, Block, blocks, mix

#: Characters of an expression, the last one included; the usual discount.
ORDER, DISCOUNT = 5, 0.75
#: Lengths of runs, in words; the tuning rows choose one, of equal ones the longest.
LENGTHS = (1, 2, 4, 8, 16, 32, 64, 0)
FOLDS, TUNING = 5, 4
#: Evidence is tallied for the cutoff in steps of this, between -CLIP and CLIP.
STEP, CLIP = 0.01, 60.0
#: Log ratios sent to all executors.
HOT = 2_000_000
#: The marks of a word's begin and end, which no word holds.
BEGIN, END = 0x5E, 0x24
_BASE = np.uint64(0x9E3779B97F4A7C15)
_CONTEXT = np.uint64(0xD6E8FEB86659FD93)


def fold(doc_id: Column) -> Column:
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % FOLDS


def _characters(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of each character of a block in one number, and the place of each byte's character."""
    data = block.data
    first = (data & 0xC0) != 0x80
    at = np.flatnonzero(first)
    wide = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.uint32)
    more = np.concatenate([~first, np.zeros(3, dtype=bool)])
    code, inside = wide[at], np.ones(len(at), dtype=bool)
    for j in (1, 2, 3):
        inside &= more[at + j]
        code = np.where(inside, (code << np.uint32(8)) | wide[at + j], code)
    return code, np.cumsum(first) - 1


class Spelt:
    """The distinct words of a block, spelt: ``codes`` with marks, and for each place to predict the word (``of``) and the number of characters (``size``)."""

    def __init__(self, block: Block) -> None:
        _, first, self.word = np.unique(block.hashes(), return_index=True, return_inverse=True)
        codes, place = _characters(block)
        begin = place[block.starts[first]] if len(first) else np.zeros(0, np.int64)
        length = place[block.ends[first] - 1] + 1 - begin if len(first) else begin
        self.words = len(first)
        ends = np.cumsum(length + 2)
        starts = ends - length - 2
        of = np.repeat(np.arange(self.words), length + 2)
        inner = np.arange(int(ends[-1]) if self.words else 0) - np.repeat(starts, length + 2)
        source = np.repeat(begin, length + 2) + inner - 1
        out = np.where(inner == 0, BEGIN, END).astype(np.uint32)
        middle = (inner > 0) & (inner <= np.repeat(length, length + 2))
        out[middle] = codes[source[middle]]
        self.codes = out
        self.at = np.flatnonzero(inner > 0)
        self.of = of[self.at]
        self.size = np.minimum(inner[self.at] + 1, ORDER)

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of each place's expression and of its context (all but the last character)."""
        whole, context = np.zeros(len(self.at), np.uint64), np.zeros(len(self.at), np.uint64)
        power = np.ones(1, np.uint64)  # arrays wrap around silently
        for j in range(ORDER):
            some = self.size > j
            code = self.codes[np.maximum(self.at - j, 0)].astype(np.uint64) + np.uint64(1)
            whole[some] += code[some] * power
            if j:
                context[some] += code[some] * last
            last, power = power, power * _BASE
        return mix(whole), mix(context ^ _CONTEXT)

    def expressions(self, some: np.ndarray) -> pa.Array:
        """The characters of the expressions at some places, four bytes each."""
        size = self.size[some]
        back = size[:, None] - 1 - np.arange(ORDER)[None, :]
        chars = self.codes[np.maximum(self.at[some][:, None] - np.maximum(back, 0), 0)]
        data = np.ascontiguousarray(chars[back >= 0].astype(">u4"))
        return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(4 * size)]).astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, n0, n1) of the texts of each block."""
    for batch in batches:
        for part, block in blocks(batch, "text", ALNUM_RULE):
            spelt = Spelt(block)
            toxic = np.asarray(part.column(part.schema.get_field_index("toxic")), dtype=np.int64)[block.text_of_word()]
            _, first, same = np.unique(spelt.keys()[0], return_index=True, return_inverse=True)
            n = []
            for c in (0, 1):
                times = np.bincount(spelt.word[toxic == c], minlength=spelt.words)
                n.append(pa.array(np.bincount(same, times[spelt.of], minlength=len(first)).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([spelt.expressions(first), *n], ["gram", "n0", "n1"])


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, n and value of rows (gram, context, n, value); contexts have keys of their own."""
    for batch in batches:
        grams = batch.column(0)
        offsets = np.frombuffer(grams.buffers()[1], np.int32)[grams.offset : grams.offset + len(grams) + 1].astype(np.int64) // 4
        codes = np.frombuffer(grams.buffers()[2], ">u4").astype(np.uint64) if grams.buffers()[2] is not None else np.zeros(0, np.uint64)
        size, ends, keys, power = np.diff(offsets), offsets[1:] - 1, np.zeros(len(grams), np.uint64), np.ones(1, np.uint64)
        for j in range(ORDER):
            some = size > j
            keys[some] += (codes[ends[some] - j] + np.uint64(1)) * power
            power = power * _BASE
        context = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        yield pa.RecordBatch.from_arrays([pa.array(mix(np.where(context, keys ^ _CONTEXT, keys)).view(np.int64)), batch.column(2), batch.column(3)], ["key", "n", "value"])


class Model:
    """Counts of the texts of ``documents`` that ``marks`` (doc_id, toxic 0/1) names, and the log ratios that follow from them."""

    def __init__(self, documents: DataFrame, marks: DataFrame) -> None:
        texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(few(marks), "doc_id")
        first = texts.groupBy(F.xxhash64("text").alias("hash"), "toxic").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
        texts = texts.join(few(materialise(first, "first_copies")), "doc_id", "left_semi").select("text", "toxic")
        counted = texts.mapInArrow(_counted, "gram binary, n0 long, n1 long")
        self.counts = materialise(counted.groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "expressions")
        self.total = [int(x or 0) for x in self.counts.agg(F.sum("n0"), F.sum("n1")).first()]

    def shared(self) -> DataFrame:
        """(gram, p): the shared probability of a lower-order expression's last character after the others."""
        size = F.octet_length("gram") / 4
        parts = self.counts.select(F.explode(F.transform(F.sequence(F.lit(1), size.cast("int")), lambda i: F.substring("gram", i * 4 - 3, F.lit(4 * ORDER)))).alias("gram")).distinct()
        parts = materialise(parts, "parts")
        seen = parts.where(size > 1).groupBy(F.substring("gram", 5, 4 * ORDER).alias("gram")).agg(F.count("*").cast("double").alias("n"))
        seen = materialise(seen.withColumn("context", _context("gram")), "continuations")
        sums = seen.groupBy("context").agg(F.sum("n").alias("whole"), F.count("*").alias("kinds"))
        seen = materialise(seen.join(sums, "context").select("gram", "n", "whole", "kinds"), "shared_counts")
        chain = seen.select("gram", F.explode(F.transform(F.sequence(F.lit(1), size.cast("int")), lambda i: F.struct(i.alias("i"), F.substring("gram", i * 4 - 3, F.lit(4 * ORDER)).alias("part")))).alias("x")).select("gram", "x.*")
        chain = chain.join(seen.select(F.col("gram").alias("part"), "n", "whole", "kinds"), "part")
        alphabet = float(parts.where(size == 1).count() + 1)
        steps = F.sort_array(F.collect_list(F.struct((-F.col("i")).alias("i"), "n", "whole", "kinds")))  # at most ORDER, shortest first
        p = F.aggregate(steps, F.lit(1 / alphabet), lambda p, x: F.greatest(x["n"] - DISCOUNT, F.lit(0.0)) / x["whole"] + DISCOUNT * x["kinds"] / x["whole"] * p)
        return chain.groupBy("gram").agg(p.alias("p"))

    def ratios(self) -> DataFrame:
        """(key, n, value): log ratios of all expressions and, for what is not seen after them, of all contexts."""
        counts = self.counts.withColumn("context", _context("gram"))
        sides = [(F.sum(f"n{c}").cast("double").alias(f"t{c}"), F.count_if(F.col(f"n{c}") > 0).alias(f"k{c}")) for c in (0, 1)]
        contexts = materialise(counts.groupBy("context").agg(*sides[0], *sides[1]), "contexts")
        rows = counts.join(contexts, "context").withColumn("part", F.substring("gram", 5, 4 * ORDER)).join(self.shared().withColumnRenamed("gram", "part"), "part")
        room = lambda c: F.when(F.col(f"t{c}") > 0, DISCOUNT * F.col(f"k{c}") / F.col(f"t{c}")).otherwise(F.lit(1.0))
        own = lambda c: F.when(F.col(f"t{c}") > 0, F.greatest(F.col(f"n{c}") - DISCOUNT, F.lit(0.0)) / F.col(f"t{c}")).otherwise(F.lit(0.0))
        of_all = rows.select("gram", F.lit(False).alias("context"), (F.col("n0") + F.col("n1")).alias("n"), F.log((own(1) + room(1) * F.col("p")) / (own(0) + room(0) * F.col("p"))).alias("value"))
        of_none = contexts.select(F.col("context").alias("gram"), F.lit(True).alias("context"), (F.col("t0") + F.col("t1")).cast("long").alias("n"), F.log(room(1) / room(0)).alias("value"))
        return materialise(of_all.unionByName(of_none).mapInArrow(_keyed, "key long, n long, value double"), "ratios")


def _context(gram: str) -> Column:
    return F.substring(F.col(gram), F.lit(1), (F.octet_length(gram) - 4).cast("int"))


def _best_runs(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The greatest mean of each of LENGTHS over the runs of each text, from the words' values."""
    counts = np.diff(first)
    sums = np.concatenate([[0.0], np.cumsum(values)])
    out = np.zeros((len(counts), len(LENGTHS)))
    for j, length in enumerate(LENGTHS):
        short = (counts <= length) | (length == 0)
        out[short, j] = (sums[first[1:]] - sums[first[:-1]])[short] / (length or np.maximum(counts[short], 1))
        if length and not short.all():
            runs = (sums[length:] - sums[:-length]) / length
            # the runs of long texts, text by text; those over a text's end are left out
            text = np.repeat(np.arange(len(counts)), counts)[: len(runs)]
            inside = np.arange(len(runs)) + length <= first[1:][text]
            best = np.full(len(counts), -np.inf)
            np.maximum.at(best, text[inside], runs[inside])
            out[~short, j] = best[~short]
    return out


def _found(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the wanted keys are in the table, and their values."""
    if not len(keys):
        return np.zeros(len(wanted), dtype=bool), np.zeros(len(wanted))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    hit = keys[at] == wanted
    return hit, np.where(hit, values[at], 0.0)


_SCORED = "row long, doc_id long, runs array<double>, words array<double>, place long, key long, context long, other double"


def _scored(batches: Iterator[pa.RecordBatch], keys: np.ndarray, values: np.ndarray, rest: bool) -> Iterator[pa.RecordBatch]:
    """Each text's runs; with ``rest``, its words' values and a row for each expression that the table may lack."""
    fields = [("row", pa.int64()), ("doc_id", pa.int64()), ("runs", pa.list_(pa.float64())), ("words", pa.list_(pa.float64())), ("place", pa.int64()), ("key", pa.int64()), ("context", pa.int64()), ("other", pa.float64())]
    for batch in batches:
        for part, block in blocks(batch, "text", ALNUM_RULE):
            spelt = Spelt(block)
            whole, context = spelt.keys()
            hit, value = _found(keys, values, whole)
            known, other = _found(keys, values, context)
            lacking = ~hit if rest else np.zeros(len(hit), dtype=bool)
            value = np.where(hit, value, other)
            value[lacking] = 0.0
            words = np.bincount(spelt.of, value, minlength=spelt.words)[spelt.word] if len(block.starts) else np.zeros(0)
            n, rows = len(block), part.column(part.schema.get_field_index("row"))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * len(LENGTHS), pa.int32()), pa.array(_best_runs(words, block.first).ravel()))
            own = pa.ListArray.from_arrays(pa.array(block.first, pa.int32()), pa.array(words)) if rest else pa.nulls(n, fields[3][1])
            yield pa.RecordBatch.from_arrays([rows, part.column(part.schema.get_field_index("doc_id")), flat, own, *(pa.nulls(n, t) for _, t in fields[4:])], [f for f, _ in fields])
            if lacking.any():
                # each distinct word's lacking expressions, for each place of the word
                lost = np.flatnonzero(lacking)
                starts = np.searchsorted(spelt.of[lost], np.arange(spelt.words + 1))
                times = np.diff(starts)[spelt.word]
                places = np.repeat(np.arange(len(spelt.word)), times)
                which = lost[np.repeat(starts[:-1][spelt.word] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(len(places))]
                texts = block.text_of_word()[places]
                m = len(places)
                yield pa.RecordBatch.from_arrays([
                    rows.take(pa.array(texts)), *(pa.nulls(m, t) for _, t in fields[1:4]), pa.array(places - block.first[texts]),
                    pa.array(whole[which].view(np.int64)), pa.array(context[which].view(np.int64)), pa.array(other[which], mask=~known[which]),
                ], [f for f, _ in fields])


def _rerun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of texts from their words' values and what their lacking expressions add."""
    for batch in batches:
        runs = []
        for words, added in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            values = np.array(words, dtype=np.float64)
            for x in added:
                values[x["place"]] += x["value"]
            runs.append(_best_runs(values, np.array([0, len(values)]))[0].tolist())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(runs, pa.list_(pa.float64()))], ["row", "again"])


def evidence(texts: DataFrame, ratios: DataFrame) -> DataFrame:
    """doc_id and ``runs`` (one number for each of LENGTHS) for every row of ``texts`` (doc_id, text)."""
    size, whole = ratios.agg(F.count("*"), F.sum("n")).first()
    rest = size > HOT
    sent = ratios.where(F.col("n") >= whole / HOT) if rest else ratios  # at most about HOT rows
    table = sent.select("key", "value").toArrow()
    keys, values = table.column("key").to_numpy().astype(np.int64).view(np.uint64), table.column("value").to_numpy()
    order = np.argsort(keys)
    both = texts.sparkSession.sparkContext.broadcast((keys[order], values[order]))
    out = texts.withColumn("row", F.monotonically_increasing_id()).mapInArrow(lambda it: _scored(it, *both.value, rest), _SCORED)
    if not rest:
        return out.select("doc_id", "runs")
    out = materialise(out, "spelt")
    left = ratios.where(F.col("n") < whole / HOT)
    lacking = out.where("key is not null").join(left.select("key", "value"), "key", "left")
    lacking = lacking.join(left.select(F.col("key").alias("context"), F.col("value").alias("late")), "context", "left").withColumn("value", F.coalesce("value", "other", "late"))
    added = lacking.where("value <> 0").groupBy("row", "place").agg(F.sum("value").alias("value")).groupBy("row").agg(F.collect_list(F.struct("place", "value")).alias("added"))  # as many as the text has words
    texts = out.where("key is null")
    again = texts.select("row", "words").join(added, "row").mapInArrow(_rerun, "row long, again array<double>")
    return texts.join(again, "row", "left").select("doc_id", F.coalesce("again", "runs").alias("runs"))


def _tallies(rows: DataFrame, value: Column) -> DataFrame:
    """(bin, toxic, n) of rows (toxic)."""
    clipped = F.greatest(F.lit(-CLIP), F.least(F.lit(CLIP), value))
    return rows.groupBy(F.floor(clipped / STEP).cast("int").alias("bin"), "toxic").agg(F.count("*").alias("n"))


def cutoff(tallies: list[tuple[int, int, int]]) -> tuple[float, float, float]:
    """Evidence from which a text is called toxic, with the best F1, the slope of the score and that F1; from (bin, toxic, n)."""
    bins = sorted({b for b, _, _ in tallies})
    n = {(b, c): k for b, c, k in tallies}
    toxic, ordinary = sum(k for _, c, k in tallies if c), sum(k for _, c, k in tallies if not c)
    if not toxic or not ordinary:
        return CLIP, 1.0, 0.0
    best, at, hits, wrong = -1.0, CLIP, toxic, ordinary
    for low, high in zip([bins[0] - 1, *bins], [*bins, bins[-1] + 1], strict=True):  # between two bins
        hits -= n.get((low, 1), 0)
        wrong -= n.get((low, 0), 0)
        f1 = 2 * hits / (hits + wrong + toxic) if hits else 0.0
        if f1 > best:
            best, at = f1, (low + 1 + high) / 2 * STEP
    mean = [sum(b * k for b, c, k in tallies if c == x) * STEP / (toxic if x else ordinary) for x in (0, 1)]
    return at, 6 / max(mean[1] - mean[0], STEP), best


def score(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, evidence, score, predicted for every row of ``documents``.

    Null and empty texts have evidence 0.  A null doc_id is held out (it has
    no remainder and no label).  A document labelled more than once is toxic if
    any label says so; labels that are null or name no document say nothing.
    Without labels of both classes in the rows that are counted, or in those
    that tune, nothing is predicted toxic.  Rows repeating a doc_id are scored
    alone; other columns are never read.
    """
    marks = labels.where("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic")).withColumn("fold", fold(F.col("doc_id")))
    marks = materialise(marks.where("fold <> 0"), "marks")
    model = Model(documents, marks.where(F.col("fold") != TUNING).drop("fold"))
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    held_out = (F.coalesce(fold(F.col("doc_id")), F.lit(0)) == 0).alias("held_out")
    if min(model.total) == 0:
        return texts.select("doc_id", held_out, F.lit(0.0).alias("evidence"), (1 / (1 + F.exp(F.lit(CLIP)))).alias("score"), F.lit(0).alias("predicted"))
    tuning = few(marks.where(F.col("fold") == TUNING).select("doc_id", "toxic"))
    out = materialise(evidence(texts, model.ratios()), "toxicity")
    tried = materialise(out.join(tuning, "doc_id"), "tried")
    trials = [cutoff([tuple(r) for r in _tallies(tried, F.col("runs")[j]).collect()]) for j in range(len(LENGTHS))]  # at most 2 * CLIP / STEP bins of two classes
    chosen = max(range(len(LENGTHS)), key=lambda j: (trials[j][2], LENGTHS[j] or float("inf")))
    at, slope, _ = trials[chosen]
    out = out.withColumn("evidence", F.col("runs")[chosen])
    logit = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), (F.col("evidence") - at) * slope))
    never = F.lit(at >= CLIP)  # no cutoff: nothing is called toxic, whatever its evidence
    value = F.when(never, F.lit(0.0)).otherwise(1 / (1 + F.exp(-logit)))
    return out.select("doc_id", held_out, "evidence", value.alias("score"), (value >= 0.5).cast("int").alias("predicted"))
