"""Column expressions shared by the native operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import materialise

#: Separators of the two word rules, for Java regular expressions.
BLANKS = "[\\x20\\x09-\\x0D]+"
NOT_ALNUM = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Up to so many rows and bytes are sent to all executors; beyond, the same join shuffles.
BROADCAST_IDS, BROADCAST_BYTES = 1_000_000, 64 << 20


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, also where lambdas inside use it."""
    return F.transform(F.array(value), body)[0]


def split_words(text: Column, separators: str) -> Column:
    """Words between runs of separators; null and wordless texts give an empty array."""
    parts = F.split(F.coalesce(text, F.lit("")), separators)

    def inner(a: Column) -> Column:
        lead = (a[0] == "").cast("int")
        tail = ((F.element_at(a, -1) == "") & (F.size(a) > 1)).cast("int")
        return F.slice(a, lead + 1, F.size(a) - lead - tail)

    return let(parts, inner)


def count_words(text: Column, separators: str) -> Column:
    parts = F.split(F.coalesce(text, F.lit("")), separators)
    return let(parts, lambda a: F.size(a) - (a[0] == "").cast("int") - ((F.element_at(a, -1) == "") & (F.size(a) > 1)).cast("int")).cast("long")


def few(rows: DataFrame, bound: int = BROADCAST_IDS, size: int = BROADCAST_BYTES) -> DataFrame:
    """``rows``, marked for broadcast if there are at most ``bound`` of them and their values, written as JSON, have at most ``size`` bytes."""
    n, written = rows.agg(F.count("*"), F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()
    return F.broadcast(rows) if n <= bound and (written or 0) <= size else rows


def without_rows(documents: DataFrame, rejected: DataFrame) -> DataFrame:
    """Rows of ``documents`` but those whose (doc_id, text hash) is in ``rejected`` (doc_id, text_hash).

    A null doc_id is compared as a value.  The texts stay where they are
    while the rejected ids are few enough to be sent to all executors.
    """
    gone = few(rejected.select(F.col("doc_id").alias("_gone_id"), F.col("text_hash").alias("_gone_hash")).distinct())
    return documents.join(gone, documents["doc_id"].eqNullSafe(gone["_gone_id"]) & (F.xxhash64(documents["text"]) == gone["_gone_hash"]), "left_anti")


def running(rows: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``rows`` with, for each of ``sums``, the sum over all rows before in ``order``.

    Rows are dealt by ranges of the order and summed in each range; only one
    row of totals for each range comes to the driver.
    """
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = placed.withColumns({"_range": F.spark_partition_id(), "_row": F.monotonically_increasing_id(), **{f"_own_{k}": v.cast("decimal(38,0)") for k, v in sums.items()}})
    placed = materialise(placed, "ranges")
    totals = sorted(placed.groupBy("_range").agg(*[F.sum(f"_own_{k}").alias(k) for k in sums]).collect(), key=lambda r: r["_range"])  # a row for each range
    table, before = [], dict.fromkeys(sums, 0)
    for r in totals:
        table.append((r["_range"], *(Decimal(before[k]) for k in sums)))
        before = {k: before[k] + int(r[k] or 0) for k in sums}
    starts = rows.sparkSession.createDataFrame(table, ", ".join(["_range int", *(f"_start_{k} decimal(38,0)" for k in sums)]))
    earlier = Window.partitionBy("_range").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    out = placed.join(F.broadcast(starts), "_range")
    out = out.withColumns({k: (F.col(f"_start_{k}") + F.coalesce(F.sum(f"_own_{k}").over(earlier), F.lit(0))).cast("decimal(38,0)") for k in sums})
    return out.select(*rows.columns, *sums)
