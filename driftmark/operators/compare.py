"""Record-by-record comparison of two versions.

One outer join by id classifies every record; changed fields are only worked
out for records whose hashes differ.  Field hashes travel no further than that
join, values never: examples fetch them for the few records shown.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import SnapshotError
from ..plans.scratch import materialise
from ..plans.sizes import small
from . import drift
from .snapshot import Snapshot

_SIDE = ("label", "hash", "rest", "file_rank", "pos")
_PLACES = ("b_file_rank", "b_pos", "a_file_rank", "a_pos")


def changed_fields(before: Column, after: Column) -> Column:
    """Sorted pointers whose hashes differ, or that one side lacks."""
    unequal = F.map_zip_with(before, after, lambda _, x, y: ~x.eqNullSafe(y))
    return F.array_sort(F.map_keys(F.map_filter(unequal, lambda _, v: v)))


def classify(before: DataFrame, after: DataFrame, clash: bool = False) -> DataFrame:
    """One row per record: id, kind (unchanged, changed, removed, added), and both sides' columns b_*, a_*.

    Ids are unique on each side, but for a literal ``a#2`` beside a repeated
    ``a``; ``clash`` says that this may be so.  Then the last record with an
    id stands for it where the other side looks it up.
    """
    left = before.select("id", *[F.col(c).alias("b_" + c) for c in _SIDE])
    right = after.select("id", *[F.col(c).alias("a_" + c) for c in _SIDE])
    if clash:
        row = F.struct(*["b_" + c for c in _SIDE])
        last = left.groupBy("id").agg(F.max_by(row, F.struct("b_file_rank", "b_pos")).alias("row")).select("id", "row.*")
        both = right.join(last, "id", "left").unionByName(left.join(right.select("id"), "id", "left_anti"), allowMissingColumns=True)
    else:
        both = left.join(right, "id", "full_outer")
    kind = F.when(F.col("b_hash").isNull(), "added").when(F.col("a_hash").isNull(), "removed").when(F.col("a_hash") == F.col("b_hash"), "unchanged").otherwise("changed")
    return both.withColumn("kind", kind)


def with_changes(pairs: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """``pairs`` of records with ``changed``, from the field hashes of these records alone."""
    places = small(pairs.select(*_PLACES))
    old = before.select(F.col("file_rank").alias("b_file_rank"), F.col("pos").alias("b_pos"), F.col("fields").alias("b_fields")).join(places, ["b_file_rank", "b_pos"])
    new = after.select(F.col("file_rank").alias("a_file_rank"), F.col("pos").alias("a_pos"), F.col("fields").alias("a_fields")).join(places.select("a_file_rank", "a_pos"), ["a_file_rank", "a_pos"])
    fields = old.join(new, ["a_file_rank", "a_pos"]).select(*_PLACES, changed_fields(F.col("b_fields"), F.col("a_fields")).alias("changed"))
    return pairs.join(fields, list(_PLACES))


def key_edits(classified: DataFrame) -> DataFrame:
    """Removed and added records whose remainder occurs once on either side: before_id, id and both sides' columns."""
    def side(kind: str, mark: str, name: str) -> DataFrame:
        mine = classified.where(F.col("kind") == kind)
        once = mine.groupBy(f"{mark}_rest").agg(F.count("*").alias("n"), F.min("id").alias(name)).where("n = 1").drop("n")
        columns = [c for c in mine.columns if c.startswith(mark + "_")]
        return once.select(name).join(mine.select(F.col("id").alias(name), *columns), name)

    old, new = side("removed", "b", "before_id"), side("added", "a", "id")
    return old.join(new, old["b_rest"].eqNullSafe(new["a_rest"]))


def field_counts(changed: DataFrame, rekeyed: DataFrame | None = None) -> DataFrame:
    """(path, n, first) of changed fields, most frequent first, then by first encounter."""
    rows = changed.select(F.lit(0).alias("phase"), "a_file_rank", "a_pos", "changed")
    if rekeyed is not None:
        rows = rows.unionByName(rekeyed.select(F.lit(1).alias("phase"), "a_file_rank", "a_pos", "changed"))
    each = rows.select("phase", "a_file_rank", "a_pos", F.posexplode("changed").alias("i", "path"))
    return each.groupBy("path").agg(F.count("*").alias("n"), F.min(F.struct("phase", "a_file_rank", "a_pos", "i")).alias("first")).orderBy(F.desc("n"), "first")


_RUN = pa.schema([("begin", pa.list_(pa.int64())), ("first", pa.list_(pa.int64())), ("last", pa.list_(pa.int64())), ("rising", pa.bool_())])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First and last place of a sorted partition, and whether the after places rise."""
    begin = first = last = None
    rising = True
    for batch in batches:
        if not batch.num_rows:
            continue
        b_rank, b_pos, rank, pos = (c.to_numpy().astype(np.int64) for c in batch.columns)
        ends = [int(rank[-1]), int(pos[-1])]
        if first is None:
            begin, first = [int(b_rank[0]), int(b_pos[0])], [int(rank[0]), int(pos[0])]
        else:
            rank, pos = np.append(last[0], rank), np.append(last[1], pos)
        later = (rank[1:] > rank[:-1]) | (rank[1:] == rank[:-1]) & (pos[1:] >= pos[:-1])
        rising, last = rising and bool(later.all()), ends
    if first is not None:
        yield pa.RecordBatch.from_pylist([{"begin": begin, "first": first, "last": last, "rising": rising}], schema=_RUN)


def order_changed(classified: DataFrame) -> bool:
    """Whether the common records stand in another order; one row for each range of places comes to the driver."""
    common = classified.where("kind in ('unchanged', 'changed')").select("b_file_rank", "b_pos", "a_file_rank", "a_pos")
    runs = common.repartitionByRange("b_file_rank", "b_pos").sortWithinPartitions("b_file_rank", "b_pos").mapInArrow(_runs, "begin array<long>, first array<long>, last array<long>, rising boolean")
    rows = sorted(runs.collect(), key=lambda r: r["begin"])
    return not all(r["rising"] for r in rows) or any(x["last"] > y["first"] for x, y in zip(rows, rows[1:], strict=False))


@dataclass
class DatasetDiff:
    """What differs between two versions; tables in reading order of the side named.

    ``changed`` and ``rekeyed`` (after), ``removed`` (before), ``added`` (after).
    """

    before: Snapshot
    after: Snapshot
    classified: DataFrame
    rekeyed: DataFrame
    _counts: dict[str, int] = field(default_factory=dict)

    @cached_property
    def changes(self) -> DataFrame:
        """The changed records with their changed fields, in no order."""
        pairs = self.classified.where("kind = 'changed'")
        return materialise(with_changes(pairs, self.before.entries, self.after.entries), "changed")

    @cached_property
    def changed(self) -> DataFrame:
        return self.changes.orderBy("a_file_rank", "a_pos")

    @cached_property
    def removed(self) -> DataFrame:
        rest = self.classified.where("kind = 'removed'").join(self.rekeyed.select(F.col("before_id").alias("id")), "id", "left_anti")
        return rest.orderBy("b_file_rank", "b_pos")

    @cached_property
    def added(self) -> DataFrame:
        return self.classified.where("kind = 'added'").join(self.rekeyed.select("id"), "id", "left_anti").orderBy("a_file_rank", "a_pos")

    @cached_property
    def counts(self) -> dict[str, int]:
        kinds = {r["kind"]: r["n"] for r in self.classified.groupBy("kind").agg(F.count("*").alias("n")).collect()}  # four kinds
        edited = self.rekeyed.count()
        return {
            "unchanged": kinds.get("unchanged", 0), "changed": kinds.get("changed", 0), "key_edited": edited,
            "removed": kinds.get("removed", 0) - edited, "added": kinds.get("added", 0) - edited,
            "duplicates_before": self.before.duplicates, "duplicates_after": self.after.duplicates,
        }

    @property
    def has_changes(self) -> bool:
        return any(self.counts[k] for k in ("changed", "key_edited", "removed", "added"))

    @cached_property
    def field_counts(self) -> DataFrame:
        return field_counts(self.changes, self.rekeyed)

    @cached_property
    def drift(self) -> DataFrame:
        """(path, change, before, after): fields added, removed, or with other JSON types."""
        return materialise(drift.drift(self.before.profile, self.after.profile), "drift")

    @cached_property
    def schema(self) -> dict[str, Any]:
        """``drift`` as one dict, where names of fields are no data."""
        rows = self.drift.orderBy("path").collect()
        retyped = {r["path"]: {"before": r["before"], "after": r["after"]} for r in rows if r["change"] == "retyped"}
        return {**{kind: [r["path"] for r in rows if r["change"] == kind] for kind in ("added", "removed")}, "retyped": retyped}

    @cached_property
    def order_changed(self) -> bool:
        return order_changed(self.classified)

    def write(self, path: str) -> None:
        """All tables as Parquet below ``path``, for results too large for a report."""
        for name in ("classified", "changes", "rekeyed", "field_counts", "drift"):
            getattr(self, name).write.parquet(f"{path.rstrip('/')}/{name}")


def compare(before: Snapshot, after: Snapshot) -> DatasetDiff:
    """Pair the records of two versions and classify them; both must be made with the same matching and ignored fields."""
    for what, one, other in (("matching", before.match.describe(), after.match.describe()), ("ignored fields", before.ignore, after.ignore)):
        if one != other:
            raise SnapshotError(f"the two sides were made with different {what}: {one} and {other}")
    classified = materialise(classify(before.entries, after.entries, before.clash or after.clash), "classified")
    edits = key_edits(classified) if before.match.by == "key" else key_edits(classified.limit(0))
    edits = materialise(edits, "edits")
    rekeyed = edits.withColumn("changed", F.array().cast("array<string>")) if edits.isEmpty() else materialise(with_changes(edits, before.entries, after.entries), "rekeyed")
    return DatasetDiff(before, after, classified, rekeyed)
