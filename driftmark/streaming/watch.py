"""Arriving records against a stored version."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import entries as ent
from ..operators.compare import changed_fields
from ..operators.snapshot import Snapshot


def watch(stream: DataFrame, snapshot: Snapshot, pos: str) -> DataFrame:
    """(id, kind, fields, err) for each record of a streaming DataFrame, by the snapshot's way of matching.

    Ids are looked up as they are (repeats within the stream are not
    numbered, which would need state without bound).  The join is between the
    stream and a static table, so it holds no state.
    """
    placed = stream.withColumns({"_src": F.lit("stream"), "_rank": F.lit(0), "_pos": F.col(pos).cast("long")})
    rows = ent.from_columns(placed, snapshot.match, snapshot.ignore, "_src", "_rank", "_pos")
    old = snapshot.entries.select(F.col("id").alias("raw_id"), F.col("hash").alias("old_hash"), F.col("fields").alias("old_fields"))
    both = rows.join(old, "raw_id", "left")
    kind = F.when(F.col("err").isNotNull(), "error").when(F.col("old_hash").isNull(), "added").when(F.col("old_hash") == F.col("hash"), "unchanged").otherwise("changed")
    return both.select(F.col("raw_id").alias("id"), kind.alias("kind"), F.when(kind == "changed", changed_fields(F.col("old_fields"), F.col("fields"))).alias("fields"), "err")
