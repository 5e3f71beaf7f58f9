"""Text files of any size as chunks that end in a separator byte, read by byte ranges.

Spark's text reader deals out ranges of ordinary files.  It passes over files
whose names begin with ``_`` or ``.``, so a Python data source reads those, with ranges
cut by the same rule: a chunk belongs to the range in which it begins.

Every chunk comes as (src, file_rank, start, row, value): ``start`` is where its range
begins, ``row`` rises within the range, ``value`` are its bytes without the separator.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..plans.scratch import materialise
from .files import DataFile

#: Bytes that a range is read by.
BLOCK = 1 << 20
#: Up to so many files are sent to all executors as a table; beyond, the same join shuffles.
FILES = 100_000
#: The same for rows of ranges.
RANGES = 1_000_000


class _Range(InputPartition):
    def __init__(self, uri: str, rank: int, start: int, end: int) -> None:
        self.uri, self.rank, self.start, self.end = uri, rank, start, end


def read_range(stream, start: int, end: int, separator: bytes, block: int = BLOCK) -> Iterator[bytes]:  # noqa: ANN001
    """Chunks of a seekable stream that begin in [start, end); a range after the first begins behind a separator."""
    at = start
    if start:
        stream.seek(start - 1)  # a separator just before the range makes its first byte a beginning
        at -= 1
    held = b""
    skipping = bool(start)
    while True:
        data = stream.read(block)
        if not data:
            if held and not skipping and at < end:
                yield held
            return
        held += data
        *whole, rest = held.split(separator)
        for chunk in whole:
            if skipping:
                skipping = False
            elif at < end:
                yield chunk
            at += len(chunk) + 1
        held = rest
        if at >= end:
            return


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.files, self.size, self.separator = json.loads(options["files"]), int(options["size"]), options["separator"].encode()

    def partitions(self) -> list[InputPartition]:
        if not self.separator:
            return [_Range(uri, rank, 0, length) for uri, rank, length in self.files]
        return [_Range(uri, rank, at, min(at + self.size, length)) for uri, rank, length in self.files for at in range(0, length, self.size)]

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(part.uri)
        names = ["file_rank", "start", "value"]
        with system.open_input_file(path) as stream:
            held, size = [], 0
            for chunk in read_range(stream, part.start, part.end, self.separator) if self.separator else [stream.read()]:
                held.append(chunk)
                size += len(chunk) + 8
                if size >= BLOCK:
                    yield pa.RecordBatch.from_arrays([pa.array([part.rank] * len(held), pa.int32()), pa.array([part.start] * len(held), pa.int64()), pa.array(held, pa.binary())], names)
                    held, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array([part.rank] * len(held), pa.int32()), pa.array([part.start] * len(held), pa.int64()), pa.array(held, pa.binary())], names)


class ByteRanges(DataSource):
    """Chunks of listed files, whatever their names; ``files`` is a JSON list of (uri, rank, length).  Without a separator a file is one chunk."""

    @classmethod
    def name(cls) -> str:
        return "driftmark_ranges"

    def schema(self) -> str:
        return "file_rank int, start long, value binary"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(self.options)


def range_bytes(spark: SparkSession) -> int:
    """``spark.sql.files.maxPartitionBytes``, in bytes."""
    text = spark.conf.get("spark.sql.files.maxPartitionBytes").lower().removesuffix("b")
    units = {"k": 10, "m": 20, "g": 30, "t": 40}
    return max(1, int(text[:-1]) << units[text[-1]] if text[-1] in units else int(text))


def files_table(spark: SparkSession, files: list[DataFile]) -> DataFrame:
    """(_uri, src, file_rank, length), a row for each file."""
    table = spark.createDataFrame([(f.uri, f.label, f.rank, f.length) for f in files], "uri string, src string, file_rank int, length long")
    table = table.select(plain_uri(F.col("uri")).alias("_uri"), "src", "file_rank", "length")
    return F.broadcast(table) if len(files) <= FILES else table


def plain_uri(c):  # noqa: ANN001, ANN201
    return F.regexp_replace(c, "^file:/+", "file:/")


def chunks(spark: SparkSession, files: list[DataFile], separator: str = "\n") -> DataFrame:
    """(src, file_rank, start, row, value) of all chunks of ``files``."""
    seen, hidden = [f for f in files if not f.hidden], [f for f in files if f.hidden]
    parts = []
    if seen:
        lines = spark.read.option("lineSep", separator).text([f.uri for f in seen])
        lines = lines.select(F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"), F.col("value").cast("binary").alias("value"))
        parts.append(lines.join(files_table(spark, seen), plain_uri(F.col("_path")) == F.col("_uri")).select("src", "file_rank", "start", "row", "value"))
    if hidden:
        parts.append(_listed(spark, hidden, separator).select("src", "file_rank", "start", "row", "value"))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _listed(spark: SparkSession, files: list[DataFile], separator: str) -> DataFrame:
    spark.dataSource.register(ByteRanges)
    listed = json.dumps([(f.uri, f.rank, f.length) for f in files])
    lines = spark.read.format(ByteRanges.name()).option("files", listed).option("separator", separator).option("size", range_bytes(spark)).load()
    lines = lines.select("file_rank", "start", F.monotonically_increasing_id().alias("row"), "value")
    return lines.join(files_table(spark, files).select("src", "file_rank"), "file_rank")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(pos, value) of the lines of one text file, numbered from 1."""
    lines = spark.read.text(path).select(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"), "value")
    # lines of a range are consecutive; earlier ranges of the file are counted before them
    counts = lines.groupBy("start").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each range
    counts = materialise(counts.select("start", (before - F.col("first") + 1).alias("add")), "splits")
    return lines.join(F.broadcast(counts) if counts.count() <= RANGES else counts, "start").select((F.col("row") + F.col("add")).alias("pos"), "value")


def contents(spark: SparkSession, files: list[DataFile]) -> DataFrame:
    """(src, file_rank, content) of whole files."""
    seen, hidden = [f for f in files if not f.hidden], [f for f in files if f.hidden]
    parts = []
    if seen:
        raw = spark.read.format("binaryFile").load([f.uri for f in seen]).select(F.col("path").alias("_path"), "content")
        parts.append(raw.join(files_table(spark, seen), plain_uri(F.col("_path")) == F.col("_uri")).select("src", "file_rank", "content"))
    if hidden:
        parts.append(_listed(spark, hidden, "").select("src", "file_rank", F.col("value").alias("content")))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, dict, list[bytes]]]:
    """(whether a range begins, its other columns, values) of consecutive rows of one range."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        names = [n for n in batch.schema.names if n != "value"]
        keys = list(zip(batch.column("file_rank").to_pylist(), batch.column("start").to_pylist(), strict=True))
        values, at = batch.column("value").to_pylist(), 0
        while at < len(keys):
            end = at + 1
            while end < len(keys) and keys[end] == keys[at]:
                end += 1
            first = {n: batch.column(n)[at].as_py() for n in names}
            yield keys[at] != last, first, values[at:end]
            last, at = keys[at], end
