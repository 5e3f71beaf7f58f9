"""Quality rules with risk-controlled cutoffs.

Fixed base rules come first.  Above them, each stratum (language) gets cutoffs
for some of five text statistics, in two steps on two halves of its labelled
texts.  The first half proposes: for each statistic the cutoff whose rejected
bad texts most exceed PRICE times its rejected good ones, and rules that use
the best statistic, the best two, and so on.  The second half, the holdout,
certifies: the rules are tested in that order, each rejecting all that the one
before does, until the exact binomial test no longer shows that a rule wrongly
rejects at most RISK of the stratum's good texts.  The last rule shown so is
taken, or none.  Tests in a fixed order that end at the first failure need no
correction among themselves; between strata it is Bonferroni's.  So with
confidence 1 - DELTA no stratum loses more than RISK of its good texts.

The bound needs independent trials: each distinct labelled text is one trial,
however many documents repeat it.

Only DataFrame functions are used.  One pass over the texts leaves a narrow
table of statistics, from which both the cutoffs and the verdicts come.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import materialise
from .columns import BLANKS, few, let, split_words

RISK, DELTA, PRICE = 0.05, 0.05, 4
_SHARES = (10, 20, 30, 50, 75, 100, 150, 200, 300, 400, 500, 700)
#: Statistic: cutoffs; a document is rejected above the cutoff taken.  Shares are in thousandths, word length in tenths.
GRIDS = {"symbols": _SHARES, "dup_lines": _SHARES, "repeats": _SHARES, "capitals": _SHARES, "word_length": (60, 65, 70, 75, 80, 90, 100, 120, 150, 200)}


def _repeated_words(w: Column) -> Column:
    """Words inside three-word windows that occur twice or more.

    Window hashes are sorted with their places packed into the low bits, so
    equal windows are neighbours; the marked places are then merged.
    """

    def from_hashes(h: Column) -> Column:
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(F.size(h)))) - F.lit(1).cast("long")

        def from_sorted(s: Column, mask: Column) -> Column:
            def same(x: Column, y: Column) -> Column:
                near = x.bitwiseXOR(y)
                return F.coalesce((near >= 0) & (near <= mask) & (F.get(h, x.bitwiseAND(mask).cast("int")) == F.get(h, y.bitwiseAND(mask).cast("int"))), F.lit(False))

            marked = F.filter(s, lambda x, j: same(x, F.get(s, j - 1)) | same(x, F.get(s, j + 1)))
            places = F.sort_array(F.transform(marked, lambda x: x.bitwiseAND(mask)))
            zero = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("end"))
            return F.aggregate(places, zero, lambda a, p: F.struct((a["total"] + p + 3 - F.greatest(p, a["end"])).alias("total"), (p + 3).alias("end")), lambda a: a["total"])

        return let(mask, lambda m: let(F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(F.bitwise_not(m)).bitwiseOR(i.cast("long")))), lambda s: from_sorted(s, m)))

    hashes = F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(F.size(w) < 4, F.lit(0).cast("long")).otherwise(let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(from_hashes(h))))


def statistics(documents: DataFrame) -> DataFrame:
    """doc_id, stratum, text_hash, the base counts, base_failed and the statistics of GRIDS (null where undefined)."""
    text = F.coalesce("text", F.lit(""))
    cut = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("stratum"), F.xxhash64("text").alias("text_hash"), text.alias("t"), split_words(text, BLANKS).alias("w"))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    counts = cut.select(
        "doc_id", "stratum", "text_hash",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.size(F.regexp_extract_all("t", F.lit("[#*$%&|<>]"), F.lit(0))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("lines"),
        let(F.col("w"), _repeated_words).alias("n_repeat_words"),
        F.length(F.array_join(F.regexp_extract_all("t", F.lit("[A-Z]+"), F.lit(0)), "")).cast("long").alias("n_capitals"),
    )

    def share(part: str, whole: str, scale: int) -> Column:
        return F.when(F.col(whole) > 0, F.floor(F.col(part) * scale / F.col(whole))).cast("long")

    counts = counts.withColumn("n_lines", F.col("lines.n")).withColumn("n_dup_lines", F.col("lines.dup")).drop("lines")
    return counts.select(
        "doc_id", "stratum", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words").alias("base_failed"),
        share("n_symbols", "word_chars", 1000).alias("symbols"), share("n_dup_lines", "n_lines", 1000).alias("dup_lines"),
        share("n_repeat_words", "n_words", 1000).alias("repeats"), share("n_capitals", "word_chars", 1000).alias("capitals"),
        share("word_chars", "n_words", 10).alias("word_length"),
    )


def binomial_tail(n: Column, k: Column, rate: float) -> Column:
    """P(X <= k) for X binomial (n, rate), exact; 1 where k is above n * rate (no use is made of it there).

    Runs over i = 1..k with the log of the i-th term and the ratio of the sum
    so far to that term, so nothing under- or overflows.
    """
    odds = rate / (1 - rate)
    zero = F.struct((n * F.log1p(F.lit(-rate))).alias("term"), F.lit(1.0).alias("ratio"))

    def step(a: Column, i: Column) -> Column:
        up = (n - i + 1) * odds / i
        return F.struct((a["term"] + F.log(up)).alias("term"), (1 + a["ratio"] / up).alias("ratio"))

    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1)))).otherwise(F.array().cast("array<long>"))
    return F.when(k > n * rate, F.lit(1.0)).otherwise(F.aggregate(steps, zero, step, lambda a: F.exp(a["term"] + F.log(a["ratio"]))))


def trials(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """stratum, quality, half (0 proposes, 1 certifies) and the statistics of each distinct labelled text of a stratum.

    A text is good only if all labels of its documents say so.  A doc_id with
    several texts, labels without doc_id or quality, and labels of unknown
    documents say nothing.
    """
    marks = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    seen = stats.where("not base_failed").join(marks, "doc_id")
    one = seen.groupBy("doc_id").agg(F.count_distinct("text_hash").alias("texts")).where("texts = 1").select("doc_id")
    seen = seen.join(one, "doc_id", "left_semi")
    out = seen.groupBy("stratum", "text_hash").agg(F.min("quality").alias("quality"), F.min("doc_id").alias("doc_id"), *[F.first(f).alias(f) for f in GRIDS])
    return out.withColumn("half", (F.substring(F.md5(F.col("doc_id").cast("string")), 1, 1) < "8").cast("int"))


def cutoffs(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each labelled stratum: stratum and, by statistic, the cutoff taken or null."""
    seen = materialise(trials(stats, labels), "trials")
    cells = [(name, c) for name, grid in GRIDS.items() for c in grid]
    hit = lambda name, c, quality: F.count_if((F.col(name) > c) & (F.col("quality") == quality))
    sums = seen.where("half = 0").groupBy("stratum").agg(F.array(*[F.struct(F.lit(f).alias("name"), F.lit(c).cast("long").alias("cutoff"), (hit(f, c, 0) - PRICE * hit(f, c, 1)).alias("gain")) for f, c in cells]).alias("cells"))
    best = sums.select("stratum", F.inline("cells")).where("gain > 0").groupBy("stratum", "name").agg(F.max(F.struct("gain", "cutoff")).alias("best"))
    place = F.row_number().over(Window.partitionBy("stratum").orderBy(F.desc("best.gain"), "name"))  # at most a row for each statistic
    best = best.withColumn("place", place)
    of = lambda f, value: F.max(F.when(F.col("name") == f, F.col(value)))
    proposed = best.groupBy("stratum").agg(*[of(f, "best.cutoff").alias(f"cut_{f}") for f in GRIDS], *[of(f, "place").alias(f"place_{f}") for f in GRIDS])
    strata = max(1, seen.select("stratum").distinct().count())
    rejected = F.least(*[F.when(F.col(f) > F.col(f"cut_{f}"), F.col(f"place_{f}")) for f in GRIDS])  # by which rule first
    held = seen.where("half = 1 and quality = 1").join(few(proposed, 100_000), "stratum").withColumn("rejected", rejected)
    steps = range(1, len(GRIDS) + 1)
    held = held.groupBy("stratum").agg(F.count("*").alias("n"), *[F.count_if(F.col("rejected") <= i).alias(f"k{i}") for i in steps])
    depth = F.lit(len(GRIDS))
    for i in reversed(steps):
        shown = binomial_tail(F.col("n"), F.col(f"k{i}"), RISK) <= DELTA / strata
        depth = F.when(shown, depth).otherwise(F.lit(i - 1))
    held = held.select("stratum", depth.alias("depth"))
    return proposed.join(held, "stratum").select("stratum", *[F.when(F.col(f"place_{f}") <= F.col("depth"), F.col(f"cut_{f}")).alias(f"cut_{f}") for f in GRIDS])


def judge(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The statistics of every row of ``documents`` (doc_id, text, lang) with ``kept``.

    Null and empty texts have no words and fail the base rules.  A null lang
    is a stratum of its own; strata with few or no labels have no cutoffs, so
    only base rules reject there.  Rows repeating a doc_id are judged alone.
    """
    stats = materialise(statistics(documents), "quality")
    cuts = few(materialise(cutoffs(stats, labels), "cutoffs"), 100_000)
    above = F.lit(False)
    for f in GRIDS:
        above = above | F.coalesce(F.col(f) > F.col(f"cut_{f}"), F.lit(False))
    return stats.join(cuts, "stratum", "left").withColumn("kept", ~F.col("base_failed") & ~above)
