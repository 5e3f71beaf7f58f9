"""Secrets: fixed patterns, and strings that a battery of tests finds random.

Assignments, access keys and long hexadecimal runs are found by patterns.
Beside them every run of LEAST or more characters of ``RUN`` but plain numbers
is a candidate.  Its encoding is the smallest alphabet that holds all of its
characters; in that alphabet it must look uniformly random by three tests:

* chi-squared: the number of equal pairs of characters, which is the
  statistic up to constants, has the mean and variance of a uniform string;
* runs: the runs of the lower and upper half of the alphabet (Wald-Wolfowitz);
* serial correlation at lag one of the places in the alphabet.

To look random is no discovery yet: short ordinary strings do so by chance.  The
ordinary strings of the corpus, its distinct runs of 8 to 19 characters, tell
how often characters come and how often a mixed string changes between small
letters, capitals, digits and signs.  Under that model a candidate's p-value joins two
tests by Fisher's rule: that it has so few equal pairs (exact mean
and variance for its length, normal tail) and so many changes (Chernoff's bound for
its length).  So a short string needs more than a long one.  A candidate that fails the
battery has p-value 1.  Benjamini and Hochberg's rule, for each doubling of
length on its own, keeps the expected share of false finds at FALSE.  Each
distinct candidate is one test, however often it is repeated.

Only DataFrame functions are used.  Texts are read twice, by patterns alone;
what moves between tasks are finds, candidates and distinct short runs.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import materialise
from .columns import few

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run of capitals and digits that is too short holds no later match that is long enough, nor does a short run of digits.
ACCESS, HEX = "AKIA[A-Z0-9]{16,}+", "(?<![0-9a-f])[0-9a-f]{24,}+"
VALUE = 6
RUN = "[A-Za-z0-9+/_-]"
ORDINARY, LEAST = 8, 20
#: Bound on each statistic of the battery in standard deviations, and the share of false finds.
BATTERY, FALSE = 3.0, 0.01
#: Changes of class and neighbours that the model begins with.
PRIOR = (20, 100)

_LOW, _UP, _DIGITS = string.ascii_lowercase, string.ascii_uppercase, string.digits
#: Alphabets in the order in which they are tried, each as a pattern of its characters.
ENCODINGS = {
    "hex": (_DIGITS + "abcdef", "[0-9a-f]+"),
    "upper hex": (_DIGITS + "ABCDEF", "[0-9A-F]+"),
    "small": (_LOW, "[a-z]+"),
    "capital": (_UP, "[A-Z]+"),
    "base32": (_UP + "234567", "[A-Z2-7]+"),
    "small and digits": (_LOW + _DIGITS, "[a-z0-9]+"),
    "capital and digits": (_UP + _DIGITS, "[A-Z0-9]+"),
    "letters": (_UP + _LOW, "[A-Za-z]+"),
    "letters and digits": (_UP + _LOW + _DIGITS, "[A-Za-z0-9]+"),
    "base64": (_UP + _LOW + _DIGITS + "+/", "[A-Za-z0-9+/]+"),
    "base64 for names": (_UP + _LOW + _DIGITS + "-_", "[A-Za-z0-9_-]+"),
    "all": (_UP + _LOW + _DIGITS + "+/-_", "[A-Za-z0-9+/_-]+"),
}
_ALL = ENCODINGS["all"][0]


def _hits(text: Column, kind: int, pattern: str, group: int = 0) -> Column:
    """(kind, number, gap, size, value) of a pattern's matches, with the length of the text between one and the one before."""
    p = F.lit(pattern)
    zipped = F.arrays_zip(F.regexp_extract_all(text, p, F.lit(0)).alias("hit"), F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, p, F.lit(group)).alias("value"))
    one = lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("number"), F.length(x["gap"]).cast("long").alias("gap"), F.length(x["hit"]).cast("long").alias("size"), x["value"].alias("value"))
    none = F.array().cast("array<struct<kind:int,number:int,gap:bigint,size:bigint,value:string>>")
    return F.when(text.rlike(pattern), F.transform(F.filter(zipped, lambda x: x["hit"].isNotNull()), one)).otherwise(none)


def _placed(table: DataFrame) -> DataFrame:
    """(row, kind, start, end, value) of all matches: places are sums of what lies before in the text."""
    each = table.where("size(hits) > 0").select("row", F.inline("hits"))
    order = Window.partitionBy("row", "kind").orderBy("number")
    start = F.sum("gap").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = each.withColumn("start", start).withColumn("end", F.col("start") + F.col("size"))
    return placed.where((F.col("kind") != 0) | (F.length("value") >= VALUE)).select("row", "kind", "start", "end", F.when(F.col("kind") == 3, F.col("value")).alias("value"))


def _changes(value: Column) -> Column:
    """Changes between small letters, capitals, digits and signs."""
    return sum((F.regexp_count(value, F.lit(p)) for p in ("[a-z]+", "[A-Z]+", "[0-9]+", "[+/_-]+")), F.lit(0)) - 1


def ordinary(documents: DataFrame) -> DataFrame:
    """(encoding, k, alphabet, halves, squares, cubes, rate): how ordinary strings of the corpus use each alphabet; a row for each."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    runs = F.filter(F.regexp_extract_all(text, F.lit(RUN + "{%d,}" % ORDINARY), F.lit(0)), lambda x: (F.length(x) < LEAST) & x.rlike("[^0-9]"))
    runs = materialise(documents.select(F.explode(runs).alias("run")).distinct(), "runs")
    mixed = runs.where(~F.col("run").rlike("^([a-z]+|[A-Z]+|[+/_-]+)$"))
    changes, neighbours = mixed.agg(F.sum(_changes(F.col("run"))), F.sum(F.length("run") - 1)).first()
    rate = ((changes or 0) + PRIOR[0]) / ((neighbours or 0) + PRIOR[1])
    counted = runs.select(F.explode(F.regexp_extract_all("run", F.lit("."), F.lit(0))).alias("char")).groupBy("char").agg(F.count("*").alias("n"))
    session = documents.sparkSession
    cells = session.createDataFrame([(name, c) for name, (alphabet, _) in ENCODINGS.items() for c in alphabet], "encoding string, char string")
    shares = cells.join(counted, "char", "left").withColumn("n", F.coalesce("n", F.lit(0)) + 1)
    shares = shares.withColumn("q", F.col("n") / F.sum("n").over(Window.partitionBy("encoding")))
    shares = shares.groupBy("encoding").agg(F.sum(F.col("q") * F.col("q")).alias("squares"), F.sum(F.col("q") * F.col("q") * F.col("q")).alias("cubes"))
    halves = lambda k: "0" * (k // 2) + "1" * (k - k // 2)
    kinds = session.createDataFrame([(name, len(a), a, halves(len(a))) for name, (a, _) in ENCODINGS.items()], "encoding string, k int, alphabet string, halves string")
    return materialise(kinds.join(shares, "encoding").withColumn("rate", F.lit(rate)), "alphabets")


def _encoding(value: Column) -> Column:
    found = F.lit("all")
    for name, (_, pattern) in reversed(list(ENCODINGS.items())[:-1]):
        found = F.when(value.rlike(f"^{pattern}$"), F.lit(name)).otherwise(found)
    return found


def battery(candidates: DataFrame, alphabets: DataFrame) -> DataFrame:
    """(value, encoding, n, pairs, z_pairs, z_runs, z_serial, passes, p) of distinct candidates ``value``."""
    c = candidates.select("value", _encoding(F.col("value")).alias("encoding"), F.length("value").cast("double").alias("n"))
    c = c.join(F.broadcast(alphabets), "encoding")  # a row for each of ENCODINGS
    times = lambda x: (F.col("n") - F.length(F.replace("value", x))).cast("double")
    counts = F.aggregate(F.array(*map(F.lit, _ALL)), F.lit(0.0), lambda a, x: a + times(x) * (times(x) - 1) / 2)
    bits = F.expr("translate(value, alphabet, halves)")
    places = F.transform(F.regexp_extract_all("value", F.lit("."), F.lit(0)), lambda x: F.instr(F.col("alphabet"), x).cast("double"))
    zero = F.struct(*(F.lit(0.0).alias(x) for x in ("last", "x", "xx", "xy")))
    sums = F.aggregate("places", zero, lambda a, x: F.struct(x.alias("last"), (a["x"] + x).alias("x"), (a["xx"] + x * x).alias("xx"), (a["xy"] + a["last"] * x).alias("xy")))
    c = c.withColumns({"pairs": counts, "bits": bits, "places": places}).withColumn("s", sums)
    low = F.length(F.replace("bits", F.lit("1"))).cast("double")
    c = c.withColumns({"all_pairs": F.col("n") * (F.col("n") - 1) / 2, "low": low, "runs": (F.regexp_count("bits", F.lit("0+")) + F.regexp_count("bits", F.lit("1+"))).cast("double")})
    m, n = F.col("s")["x"] / F.col("n"), F.col("n")
    spread = F.col("s")["xx"] - n * m * m
    c = c.withColumns({
        "z_pairs": (F.col("pairs") - F.col("all_pairs") / F.col("k")) / F.sqrt(F.col("all_pairs") / F.col("k") * (1 - F.lit(1.0) / F.col("k"))),
        "mean": 1 + 2 * F.col("low") * (n - F.col("low")) / n,
        "serial": F.when(spread > 0, (F.col("s")["xy"] - m * (2 * F.col("s")["x"] - F.element_at("places", 1) - F.element_at("places", -1)) + (n - 1) * m * m) / spread).otherwise(1.0),
        "changes": _changes(F.col("value")).cast("double") / (n - 1),
        "expected": F.col("all_pairs") * F.col("squares"),
        "deviation": F.sqrt(F.col("all_pairs") * (F.col("squares") - F.col("squares") * F.col("squares")) + n * (n - 1) * (n - 2) * (F.col("cubes") - F.col("squares") * F.col("squares"))),
    })
    variance = (F.col("mean") - 1) * (F.col("mean") - 2) / (n - 1)
    c = c.withColumns({"z_runs": F.when(variance > 0, (F.col("runs") - F.col("mean")) / F.sqrt(variance)).otherwise(99.0), "z_serial": (F.col("serial") + 1 / n) * F.sqrt(n)})
    z = (F.col("expected") - F.col("pairs")) / F.col("deviation")
    few_pairs = F.when(z > 0, F.exp(-z * z / 2) / 2).otherwise(1.0)
    w, rate = F.col("changes"), F.col("rate")
    surprise = w * F.ln(w / rate) + F.when(w < 1, (1 - w) * F.ln((1 - w) / (1 - rate))).otherwise(0.0)
    many_changes = F.when(w > rate, F.exp(-(n - 1) * surprise)).otherwise(1.0)
    passes = (F.col("z_pairs") <= BATTERY) & (F.abs("z_runs") <= BATTERY) & (F.abs("z_serial") <= BATTERY)
    both = F.greatest(few_pairs * many_changes, F.lit(1e-300))
    c = c.withColumn("passes", passes).withColumn("p", F.when(F.col("passes"), F.least(both * (1 - F.ln(both)), F.lit(1.0))).otherwise(1.0))
    return c.select("value", "encoding", "n", "pairs", "z_pairs", "z_runs", "z_serial", "passes", "p")


def discoveries(tested: DataFrame) -> DataFrame:
    """The candidates of ``battery`` that the false-discovery rule keeps, by powers of two of p within each doubling of length."""
    step = tested.withColumns({"stratum": F.floor(F.log2(F.col("n") / LEAST)), "step": F.floor(-F.log2("p"))})
    counts = step.groupBy("stratum", "step").agg(F.count("*").alias("here"))  # a row for each doubling and power
    by = Window.partitionBy("stratum")
    counts = counts.withColumns({"found": F.sum("here").over(by.orderBy(F.desc("step"))), "tests": F.sum("here").over(by)})
    cuts = counts.where(F.col("tests") * F.pow(F.lit(2.0), -F.col("step")) <= FALSE * F.col("found")).groupBy("stratum").agg(F.min("step").alias("cut"))
    return step.join(F.broadcast(cuts), "stratum").where("step >= cut").drop("stratum", "step", "cut")


def scan(documents: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base, spans for every row of ``documents``.

    ``base`` and ``spans`` are kind:start:end lists by start, then kind (code
    points, end exclusive); ``spans`` has the random strings too, but those
    that lie within a base find.  A null text is empty; empty texts have no
    spans.  Rows that repeat a doc_id or a text are rows of their own and have
    equal finds; a null doc_id stays null.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    hits = F.concat(_hits(text, 0, ASSIGN, 2), _hits(text, 1, ACCESS), _hits(text, 2, HEX), F.filter(_hits(text, 3, RUN + "{%d,}+" % LEAST), lambda x: x["size"] > 0))
    table = materialise(documents.select(F.col("doc_id").cast("long").alias("doc_id"), hits.alias("hits")).withColumn("row", F.monotonically_increasing_id()), "hits")
    placed = materialise(_placed(table), "places")
    candidates = placed.where((F.col("kind") == 3) & F.col("value").rlike("[^0-9]")).select("row", "start", "end", "value")
    tested = materialise(battery(candidates.select("value").distinct(), ordinary(documents)), "tested")
    random = few(materialise(discoveries(tested).select("value"), "random"))
    added = candidates.join(random, "value").select("row", F.lit(3).alias("kind"), "start", "end")
    finds = placed.where("kind < 3").drop("value").unionByName(added)
    # a random string within a base find tells nothing new
    before = Window.partitionBy("row").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    finds = finds.withColumn("reach", F.max(F.when(F.col("kind") < 3, F.col("end"))).over(before)).where((F.col("kind") < 3) | F.col("reach").isNull() | (F.col("reach") < F.col("end")))
    listed = finds.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("found"))  # what one text holds
    named = lambda found: F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")
    rows = table.select("row", "doc_id").join(listed, "row", "left").withColumn("found", F.coalesce("found", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")))
    return rows.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), named(F.filter("found", lambda x: x["kind"] < 3)).alias("base"), named(F.col("found")).alias("spans"))
