"""Parquet footers read in tasks, and row groups of files that Spark's reader cannot or would not read rightly.

Spark refuses nanosecond timestamps and times of day, loses the unit of
durations and the type of unsigned 64-bit integers, gives legacy timestamps a zone,
and passes over files whose names begin with ``_`` or ``.``.  Files of that kind
are decoded by Arrow, a row group at a time in batches of rows, and their values
become JSON values as those of other files do.
"""

from __future__ import annotations

import base64
import datetime
import decimal
import hashlib
import math
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import DataFile

#: Rows decoded at once, and files whose footers one task reads.
ROWS, FOOTERS = 4096, 64


def _opened(uri: str):  # noqa: ANN202
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


def own_way(kind: pa.DataType) -> bool:
    """Whether Spark's reader lacks this type, or a type within it, or takes it for another."""
    if pa.types.is_nested(kind):
        return any(own_way(kind.field(i).type) for i in range(kind.num_fields))
    if pa.types.is_dictionary(kind):
        return own_way(kind.value_type)
    alone = (pa.types.is_time, pa.types.is_duration, pa.types.is_uint64, pa.types.is_float16)
    return any(test(kind) for test in alone) or (pa.types.is_timestamp(kind) and kind.unit == "ns")


def json_value(value: Any) -> Any:
    """A decoded value as JSON has it; durations are seconds, bytes are base64, numbers that JSON lacks are text."""
    match value:
        case dict():
            return {k: json_value(v) for k, v in value.items()}
        case list() | tuple():
            return [json_value(v) for v in value]
        case datetime.timedelta():
            return value.total_seconds()
        case datetime.date() | datetime.time():
            return value.isoformat()
        case bytes():
            return base64.b64encode(value).decode()
        case decimal.Decimal():
            return str(value)
        case float() if not math.isfinite(value):
            return str(value)
    return value


def _footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import pyarrow.parquet as pq

    for batch in batches:
        rows = []
        for rank, uri in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            row = {"file_rank": rank}
            try:
                with _opened(uri) as stream, pq.ParquetFile(stream) as file:
                    schema, meta = file.schema_arrow, file.metadata
                    text = schema.remove_metadata().to_string(show_field_metadata=False) + str(file.schema)
                    row |= {"kind": hashlib.sha256(text.encode()).hexdigest(), "own_way": any(own_way(f.type) for f in schema), "has_id": "id" in schema.names, "groups": [meta.row_group(g).num_rows for g in range(meta.num_row_groups)]}
            except pa.ArrowInvalid as exc:
                row["err"] = str(exc).splitlines()[0]
            except (pa.ArrowException, OSError, NotImplementedError):
                row["kind"] = None  # a store that Arrow does not know: Spark reads it
            rows.append(row)
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("file_rank", pa.int32()), ("kind", pa.string()), ("own_way", pa.bool_()), ("has_id", pa.bool_()), ("groups", pa.list_(pa.int64())), ("err", pa.string())]))


def footers(spark: SparkSession, files: list[DataFile]) -> DataFrame:
    """(file_rank, kind, own_way, has_id, groups, err) of Parquet files: equal kinds are equal schemas, groups the rows of each row group.

    ``kind`` is null without an error where only Spark can open the file.
    """
    table = spark.createDataFrame([(f.rank, f.uri) for f in files], "file_rank int, uri string")
    table = table.repartition(max(1, -(-len(files) // FOOTERS)))
    return table.mapInArrow(_footers, "file_rank int, kind string, own_way boolean, has_id boolean, groups array<long>, err string")


def _decoded(make: Callable):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        rows = make()
        for batch in batches:
            for r in batch.to_pylist():
                pos = r["before"]
                with _opened(r["uri"]) as stream, pq.ParquetFile(stream) as file:
                    for part in file.iter_batches(batch_size=ROWS, row_groups=[r["number"]]):
                        for value in part.to_pylist():
                            pos += 1
                            rows.add(r["src"], r["file_rank"], pos, json_value(value))
                            if rows.full():
                                yield rows.take()
        yield rows.take()

    return run


def entries(spark: SparkSession, files: list[DataFile], groups: dict[int, list[int]], make: Callable, schema: str) -> DataFrame:
    """Entries of files by row groups; ``groups`` has the rows of each group by file."""
    table = spark.createDataFrame([(f.label, f.rank, f.uri, groups[f.rank]) for f in files], "src string, file_rank int, uri string, groups array<long>")
    each = table.select("src", "file_rank", "uri", "groups", F.posexplode("groups").alias("number", "rows"))
    each = each.withColumn("before", F.aggregate(F.slice("groups", 1, F.col("number")), F.lit(0).cast("long"), lambda a, x: a + x)).drop("groups")
    return each.repartition(max(1, sum(map(len, groups.values()))), "file_rank", "number").mapInArrow(_decoded(make), schema)
