"""Data sets as entries: JSON Lines, JSON, CSV and Parquet files, or directories of them.

Text formats are decoded strictly in Arrow functions, which yield entries
directly.  JSON Lines are split by Spark and numbered by prefix sums of line
counts over the ranges.  A JSON or CSV file of up to LARGE bytes is decoded by one
task; larger CSV files and JSON arrays are read by ranges (``by_range``).  Parquet goes through native
expressions, files with the same schema together.
"""

from __future__ import annotations

import csv
import io
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InputError
from ..operators import entries as ent
from ..operators.matching import Match
from ..plans.scratch import materialise
from . import by_range, row_groups, strict_json
from .chunks import chunks, contents, files_table, plain_uri, runs
from .files import DataFile, head, input_files

_MAP = pa.map_(pa.string(), pa.string())
_ARROW = pa.schema([("src", pa.string()), ("file_rank", pa.int32()), ("pos", pa.int64()), ("raw_id", pa.string()), ("label", pa.string()), ("hash", pa.string()), ("rest", pa.string()), ("fields", _MAP), ("types", _MAP), ("leaves", _MAP), ("record", pa.string()), ("err", pa.string()), ("has_id", pa.bool_())])
_CUT_ARROW = pa.schema([*_ARROW, ("owner", pa.int64()), ("part", pa.int64()), ("piece", pa.string()), ("names", pa.list_(pa.string()))])
_BATCH = 1000
#: Larger JSON and CSV files are read by ranges.
LARGE = 64 << 20
#: Tasks for each core that texts of a table are decoded by.
TASKS = 4


@dataclass(frozen=True)
class How:
    """What entries are made for: the way of matching, ignored fields, whether the record's JSON is wanted, and by what ways files are read."""

    match: Match
    ignore: tuple[str, ...] = ()
    record: bool = False
    large: int | None = None  # bytes beyond which a CSV or JSON file is read by ranges

    def by_ranges(self, f: DataFile) -> bool:
        return f.length > (LARGE if self.large is None else self.large)


def _column(values: list, kind: pa.DataType) -> pa.Array:
    """Values as Arrow; those of a map are lists of pairs."""
    if not pa.types.is_map(kind):
        return pa.array(values, kind)
    offsets, keys, items = [], [], []
    for pairs in values:
        offsets.append(None if pairs is None else len(keys))
        for key, item in pairs or ():
            keys.append(key)
            items.append(item)
    offsets.append(len(keys))
    return pa.MapArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys, kind.key_type), pa.array(items, kind.item_type))


class Rows:
    """Collects entries and hands them out as Arrow batches."""

    def __init__(self, how: How, schema: pa.Schema = _ARROW) -> None:
        self.how, self.schema, self.rows = how, schema, []

    def add(self, src: str, rank: int, pos: int, value: Any, wrong: str | None = None) -> None:
        row = {"err": wrong} if wrong else ent.from_record(value, self.how.match, self.how.ignore, f"{src} record {pos}", self.how.record)
        self.rows.append({"src": src, "file_rank": rank, "pos": pos, "has_id": wrong is None and "id" in value, **row})

    def fragment(self, src: str, rank: int, owner: int, part: int, pos: int | None, piece: str, names: list[str] | None) -> None:
        """A part of a record that other ranges have parts of; ``owner`` tells the record within its file."""
        self.rows.append({"src": src, "file_rank": rank, "owner": owner, "part": part, "pos": pos, "piece": piece, "names": names})

    def full(self) -> bool:
        return len(self.rows) >= _BATCH

    def take(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_arrays([_column([r.get(f.name) for r in rows], f.type) for f in self.schema], schema=self.schema)


def _decoded(raw: bytes) -> tuple[str, str | None]:
    try:
        return raw.decode(), None
    except UnicodeDecodeError as exc:
        return "", f"not valid UTF-8 ({exc.reason})"


def _line(rows: Rows, src: str, rank: int, pos: int, raw: bytes) -> None:
    text, wrong = _decoded(raw)
    if wrong:
        wrong = f"{src}: {wrong}"
    elif not text.strip():
        return
    value = None
    if not wrong:
        try:
            value = strict_json.loads(text)
            if not isinstance(value, dict):
                wrong = f"{src} line {pos}: expected a JSON object"
        except ValueError as exc:
            wrong = f"{src} line {pos}: invalid JSON: {exc}"
    rows.add(src, rank, pos, value, wrong)


def _lines(batches: Iterator[pa.RecordBatch], how: How) -> Iterator[pa.RecordBatch]:
    rows = Rows(how)
    for batch in batches:
        for src, rank, pos, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            _line(rows, src, rank, pos, raw)
            if rows.full():
                yield rows.take()
    yield rows.take()


def _numbered(batches: Iterator[pa.RecordBatch], how: How) -> Iterator[pa.RecordBatch]:
    """Entries of the lines of ranges; a carriage return ends a line too."""
    rows, pos = Rows(how), 0
    for begins, at, values in runs(batches):
        if begins:
            pos = at["before"]
            if at["mark"]:
                rows.add(at["src"], at["file_rank"], by_range.WHOLE, None, f"{at['src']} line 1: invalid JSON: unexpected byte order mark")
        for value in values:
            for line in value.removesuffix(b"\r").split(b"\r"):
                pos += 1
                _line(rows, at["src"], at["file_rank"], pos, line)
            if rows.full():
                yield rows.take()
    yield rows.take()


def _json_file(src: str, text: str) -> Iterator[tuple[int, Any, str | None]]:
    try:
        value = strict_json.loads(text)
    except ValueError as exc:
        yield 0, None, f"{src}: invalid JSON: {exc}"
        return
    if isinstance(value, dict):
        value = [value]
    if not isinstance(value, list):
        yield 0, None, f"{src}: expected a JSON array of objects"
        return
    for pos, item in enumerate(value, 1):
        yield pos, item, None if isinstance(item, dict) else f"{src} item {pos}: expected an object"


def _csv_file(src: str, text: str) -> Iterator[tuple[int, Any, str | None]]:
    pos = 0
    try:
        for pos, row in enumerate(csv.DictReader(io.StringIO(text, newline="")), 1):
            yield pos, dict(row), None
    except csv.Error as exc:
        yield pos + 1, None, f"{src}: {exc}"


def _whole(batches: Iterator[pa.RecordBatch], read: Callable, how: How) -> Iterator[pa.RecordBatch]:
    rows = Rows(how)
    for batch in batches:
        for i in range(batch.num_rows):
            src, rank = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
            text, wrong = _decoded(batch.column(2)[i].as_py())
            if wrong:
                rows.add(src, rank, 0, None, f"{src}: {wrong}")
                continue
            for pos, value, wrong in read(src, text):
                rows.add(src, rank, pos, value, wrong)
                if rows.full():
                    yield rows.take()
    yield rows.take()


_OUT = ent.SCHEMA + ", has_id boolean"


_CUT = _OUT + ", owner long, part long, piece string, names array<string>"


def _placed(spark: SparkSession, df: DataFrame, files: list[DataFile]) -> DataFrame:
    """``df`` (with ``_path``) and each file's src and file_rank."""
    return df.join(files_table(spark, files).drop("length"), plain_uri(F.col("_path")) == F.col("_uri")).drop("_uri", "_path")


def _read_lines(spark: SparkSession, files: list[DataFile], how: How) -> DataFrame:
    lines = chunks(spark, files)
    text = F.col("value").cast("string")
    returns = F.length("value") - F.octet_length(F.replace(text, F.lit("\r"))) - F.endswith(text, F.lit("\r")).cast("int")
    ranges = lines.groupBy("file_rank", "start").agg(F.sum(F.length("value")).alias("n_bytes"), F.count("*").alias("n_chunks"), F.sum(returns + 1).alias("lines"))
    ranges = materialise(ranges, "ranges").join(files_table(spark, files).select("file_rank", "length"), "file_rank")
    before = F.coalesce(F.sum("lines").over(by_range.earlier()), F.lit(0))
    mark = (by_range.missing_bytes() >= 2) & (F.col("start") == 0)  # Spark would drop it
    ranges = materialise(ranges.select("file_rank", "start", before.alias("before"), mark.alias("mark")), "line-numbers")
    placed = by_range.with_ranges(spark, files, "\n", ranges).select("src", "file_rank", "start", "before", "mark", "value")
    return placed.mapInArrow(lambda it: _numbered(it, how), _OUT)


def _read_whole(spark: SparkSession, files: list[DataFile], how: How, read: Callable) -> DataFrame:
    return contents(spark, files).select("src", "file_rank", "content").mapInArrow(lambda it: _whole(it, read, how), _OUT)


def _read_csv(spark: SparkSession, files: list[DataFile], how: How) -> DataFrame:
    large = [f for f in files if how.by_ranges(f)]
    small = [f for f in files if not how.by_ranges(f)]
    parts = [_read_whole(spark, small, how, _csv_file)] if small else []
    if large:
        parts.append(by_range.csv_entries(spark, large, lambda: Rows(how, _CUT_ARROW), _OUT, _CUT, lambda: Rows(how)))
    return reduce(DataFrame.unionByName, parts)


def _read_json(spark: SparkSession, files: list[DataFile], how: How) -> DataFrame:
    opening = {}
    for f in filter(how.by_ranges, files):
        start = head(spark, f.uri, 1 << 16)
        if (rest := start.lstrip(b" \t\n\r")).startswith(b"["):  # any other is one record
            opening[f.rank] = len(start) - len(rest)
    whole = [f for f in files if f.rank not in opening]
    parts = [_read_whole(spark, whole, how, _json_file)] if whole else []
    if opening:
        parts.append(by_range.json_entries(spark, [f for f in files if f.rank in opening], lambda: Rows(how, _CUT_ARROW), _OUT, _CUT, lambda: Rows(how), opening))
    return reduce(DataFrame.unionByName, parts)


def _read_parquet(spark: SparkSession, files: list[DataFile], how: How) -> DataFrame:
    of = {f.rank: f for f in files}
    by_kind: dict[str, list[DataFile]] = defaultdict(list)
    own_way, groups = [], {}
    for r in sorted(row_groups.footers(spark, files).collect(), key=lambda r: r["file_rank"]):  # a row for each file, as the listing has
        f = of[r["file_rank"]]
        if r["err"]:
            raise InputError(f"{f.label}: {r['err']}")
        if r["kind"] and (r["own_way"] or f.hidden):
            own_way.append(f)
            groups[f.rank] = r["groups"]
        else:
            by_kind[r["kind"] or f.uri].append(f)
    parts = [row_groups.entries(spark, own_way, groups, lambda: Rows(how), _OUT)] if own_way else []
    for some in by_kind.values():
        try:
            data = spark.read.parquet(*[f.uri for f in some])
        except Exception as exc:
            raise InputError(f"{some[0].label}: {str(exc).splitlines()[0]}") from exc
        named = data.select(F.col("_metadata.file_path").alias("_path"), (F.col("_metadata.row_index") + 1).alias("_pos"), *data.columns)
        placed = _placed(spark, named, some).withColumnsRenamed({"src": "_src", "file_rank": "_rank"}) if not {"src", "file_rank"} & set(data.columns) else _shielded(spark, named, some)
        part = ent.from_columns(placed, how.match, how.ignore, "_src", "_rank", "_pos")
        parts.append(part.withColumn("has_id", F.lit("id" in data.columns)))
    return reduce(DataFrame.unionByName, parts)


def _shielded(spark: SparkSession, named: DataFrame, files: list[DataFile]) -> DataFrame:
    """As ``_placed`` for data whose own columns clash with the place columns."""
    packed = named.select("_path", "_pos", F.struct(*[c for c in named.columns if c not in ("_path", "_pos")]).alias("_row"))
    return _placed(spark, packed, files).withColumnsRenamed({"src": "_src", "file_rank": "_rank"}).select("_src", "_rank", "_pos", "_row.*")


def _read(spark: SparkSession, files: list[DataFile], how: How) -> DataFrame:
    kinds: dict[str, list[DataFile]] = defaultdict(list)
    for f in files:
        kinds[f.format].append(f)
    readers: dict[str, Callable[[list[DataFile]], DataFrame]] = {
        "lines": lambda some: _read_lines(spark, some, how),
        "json": lambda some: _read_json(spark, some, how),
        "csv": lambda some: _read_csv(spark, some, how),
        "parquet": lambda some: _read_parquet(spark, some, how),
    }
    return reduce(DataFrame.unionByName, [readers[kind](some) for kind, some in kinds.items()])


def _first_has_id(spark: SparkSession, f: DataFile) -> bool | None:
    """Whether the first record of a file has a field ``id``; None if there is no record."""
    if f.format == "parquet":
        r = row_groups.footers(spark, [f]).first()
        if r["kind"]:
            return r["has_id"] if sum(r["groups"]) else None
        data = spark.read.parquet(f.uri)
        return None if data.isEmpty() else "id" in data.columns
    if f.format == "lines":
        for line in chunks(spark, [f]).where(F.trim(F.replace(F.col("value").cast("string"), F.lit("\r"))) != "").select("value").head(1):
            try:
                first = next(x for x in bytes(line["value"]).split(b"\r") if x.strip())
                value = strict_json.loads(first.decode())
            except (StopIteration, ValueError):
                break  # the reader tells what is wrong
            return "id" in value if isinstance(value, dict) else None
    first = _read(spark, [f], How(Match("content"))).select("pos", "has_id").orderBy("pos").first()
    return first["has_id"] if first else None


def detect_match(spark: SparkSession, path: str) -> Match:
    """By ``id`` if the first record has such a field (before anything is ignored), else by content.

    Of JSON Lines and Parquet only the head of a file is read.
    """
    answers = (_first_has_id(spark, f) for f in input_files(spark, path))
    return Match("id", ("id",)) if next((x for x in answers if x is not None), False) else Match("content")


def read_entries(spark: SparkSession, path: str, match: Match, ignore: tuple[str, ...] = ()) -> DataFrame:
    """Entries of a file or directory, in no particular order (file_rank and pos hold it)."""
    return _read(spark, input_files(spark, path), How(match, ignore)).drop("has_id")


def read_rows(spark: SparkSession, path: str, large: int | None = None) -> DataFrame:
    """(source, file_rank, position, data, err) for every record; data is its canonical JSON.

    CSV and JSON files of more than ``large`` bytes (LARGE by default) are read by ranges.
    """
    rows = _read(spark, input_files(spark, path), How(Match("content"), (), True, large))
    return rows.select(F.col("src").alias("source"), "file_rank", F.col("pos").alias("position"), F.col("record").alias("data"), "err")


def entries_from_json(df: DataFrame, column: str, match: Match, ignore: tuple[str, ...] = (), src: str = "src", rank: str = "file_rank", pos: str = "pos") -> DataFrame:
    """Entries of a DataFrame whose ``column`` holds a JSON object as text, decoded as strictly as JSON Lines."""
    rows = df.select(F.col(src).cast("string").alias("src"), F.col(rank).cast("int").alias("file_rank"), F.col(pos).cast("long").alias("pos"), F.col(column).cast("binary").alias("value"))
    how = How(match, ignore)
    # tables that are small on disk come in a few tasks however many rows they have, and decoding is the work
    tasks = TASKS * df.sparkSession.sparkContext.defaultParallelism
    return rows.where("value is not null").repartition(tasks, "file_rank", "pos").mapInArrow(lambda it: _lines(it, how), _OUT).drop("has_id")
