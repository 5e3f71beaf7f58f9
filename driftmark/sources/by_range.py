"""Large CSV files and JSON arrays, decoded by many tasks.

Where a record begins depends on everything before it, but only by a small
state: whether a quote is open, and in JSON how deep the brackets are.  A first pass
over the ranges of a file finds what each does to either state; windows over
these small rows, one for each range, compose them, so that the state and the
number of records before each range are known.  A second pass cuts and decodes the
ranges in parallel.  What of a record lies in a range beside those of its
beginning travels as a fragment, two for each range at most, and is put together
record by record.

CSV is cut at line feeds, JSON at closing braces; only the text between two of them
must fit a task.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..errors import InputError
from ..plans.scratch import materialise
from . import strict_json
from .chunks import RANGES, chunks, files_table, runs
from .files import DataFile, head

#: Errors of a file as a whole come before those of its records.
WHOLE = -(1 << 62)



def earlier() -> WindowSpec:
    """The ranges of a file before one."""
    return Window.partitionBy("file_rank").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)


def _so_far() -> WindowSpec:
    return Window.partitionBy("file_rank").orderBy("start").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _is_last() -> Column:
    return F.lead("start").over(Window.partitionBy("file_rank").orderBy("start")).isNull()


def state_before(end0: Column, end1: Column) -> Column:
    """The state (0 or 1) in which a range begins, if ranges map it to end0 or end1 and a file begins with 0.

    A range that ends alike from both states settles it; after the last such
    one only the ranges that exchange the states count.
    """
    exchanges = F.when((end0 == 1) & (end1 == 0), 1).otherwise(0)
    settled = F.when(end0 == end1, F.struct(end0.alias("state"), F.sum(exchanges).over(_so_far()).alias("exchanges")))
    last = F.last(settled, ignorenulls=True).over(earlier())
    return (F.coalesce(last["state"], F.lit(0)) + F.coalesce(F.sum(exchanges).over(earlier()), F.lit(0)) - F.coalesce(last["exchanges"], F.lit(0))) % 2


def missing_bytes() -> Column:
    """Bytes of a file beyond its chunks and their separators: -1 if it does not end in a separator, 3 more for a byte order mark that Spark dropped."""
    return F.col("length") - F.sum(F.col("n_bytes") + F.col("n_chunks")).over(Window.partitionBy("file_rank"))


def _unended() -> Column:
    """The last chunk's row if the file does not end in the separator."""
    return F.when(missing_bytes().isin(-1, 2) & _is_last(), F.col("last_row"))


def with_ranges(spark: SparkSession, files: list[DataFile], separator: str, ranges: DataFrame) -> DataFrame:
    """The chunks, in order within each range, with the columns of their range."""
    some = chunks(spark, files, separator)
    if ranges.count() <= RANGES:
        return some.join(F.broadcast(ranges), ["file_rank", "start"])
    return some.join(ranges, ["file_rank", "start"]).repartition("file_rank", "start").sortWithinPartitions("file_rank", "start", "row")


# CSV

_PHYSICAL = re.compile(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+")
#: A line, begun outside quotes, that leaves a quoted field open.
_OPENS = re.compile(r'(?:"[^"]*+(?:""[^"]*+)*+"[^,]*+|[^",][^,]*+|,)*+"[^"]*+(?:""[^"]*+)*+\Z')


def stays_open(line: str, quoted: bool) -> bool:
    """Whether a quoted field is open after a line."""
    if '"' not in line:
        return quoted
    return _OPENS.match('"' + line if quoted else line) is not None


def _csv_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["file_rank", "start", "last_row", "n_bytes", "n_chunks", "end0", "end1", "n0", "n1"]
    found: list[dict] = []
    state, count = [0, 1], [0, 0]
    for begins, at, values in runs(batches):
        if begins:
            state, count = [0, 1], [0, 0]
            found.append({"file_rank": at["file_rank"], "start": at["start"], "last_row": at["row"] - 1, "n_bytes": 0, "n_chunks": 0})
        here = found[-1]
        here["last_row"] += len(values)
        here["n_chunks"] += len(values)
        for value in values:
            here["n_bytes"] += len(value)
            lines = _PHYSICAL.findall(value.decode(errors="replace") + "\n") if b"\r" in value or b'"' in value else [value]
            for line in lines:
                blank = not line.strip("\r\n") if isinstance(line, str) else not line
                for k in (0, 1):
                    if state[k] == 0 and not (blank and (count[k] or here["start"])):  # the first line of a file is its header
                        count[k] += 1
                    if isinstance(line, str):
                        state[k] = int(stays_open(line, bool(state[k])))
        here |= {"end0": state[0], "end1": state[1], "n0": count[0], "n1": count[1]}
    yield pa.RecordBatch.from_pylist(found, schema=pa.schema([(n, pa.int32() if n in ("file_rank", "end0", "end1") else pa.int64()) for n in names]))


def header(spark: SparkSession, uri: str, size: int = 1 << 16) -> list[str]:
    """The first record of a CSV file, with a byte order mark as part of its first name."""
    while True:
        raw = head(spark, uri, size)
        text = raw.decode(errors="ignore")
        done, quoted = [], False
        for line in _PHYSICAL.findall(text):
            quoted = stays_open(line, quoted)
            done.append(line)
            if not quoted:
                break
        if len(raw) < size or (not quoted and len("".join(done)) < len(text)):
            try:
                return next(csv.reader(done), [])
            except csv.Error as exc:
                raise InputError(f"{uri}: {exc}") from exc
        size *= 8


def _dict(names: list[str], row: list[str]) -> dict:
    out: dict = dict(zip(names, row, strict=False))
    if len(row) > len(names):
        out[None] = row[len(names) :]
    return out | dict.fromkeys(names[len(row) :])


def _record(names: list[str], lines: list[str], src: str) -> tuple[Any, str | None]:
    try:
        return _dict(names, next(csv.reader(lines))), None
    except csv.Error as exc:
        return None, f"{src}: {exc}"


def _cut_csv(make: Callable):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, at, held, pos, quoted, leading = make(), None, [], 0, False, False

        def rest() -> None:
            if held:
                rows.fragment(at["src"], at["file_rank"], at["owner"] if leading else at["start"], at["start"], None if leading else pos, "".join(held), at["names"])

        for begins, first, values in runs(batches):
            if begins:
                rest()
                at, held, pos, quoted = first, [], first["before"], bool(first["state"])
                leading, row = quoted, first["row"]
            for value in values:
                try:
                    text = (value if row == at["unended"] else value + b"\n").decode()
                except UnicodeDecodeError as exc:
                    rows.add(at["src"], at["file_rank"], WHOLE + at["start"], None, f"{at['src']}: not valid UTF-8 ({exc.reason})")
                    text = value.decode(errors="replace") + "\n"
                row += 1
                for line in _PHYSICAL.findall(text):
                    head_line = pos == 0 and not at["start"] and not held
                    if not held and not leading and not head_line and not line.strip("\r\n"):
                        continue
                    held.append(line)
                    quoted = stays_open(line, quoted)
                    if quoted:
                        continue
                    if leading:
                        rest()
                        leading = False
                    else:
                        if pos:  # the first record is the header
                            rows.add(at["src"], at["file_rank"], pos, *_record(at["names"], held, at["src"]))
                        pos += 1
                    held = []
                    if rows.full():
                        yield rows.take()
        rest()
        yield rows.take()

    return run


def _joined_csv(make: Callable):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = make()
        for batch in batches:
            for r in batch.to_pylist():
                if r["pos"]:
                    rows.add(r["src"], r["file_rank"], r["pos"], *_record(r["names"], _PHYSICAL.findall(r["text"]), r["src"]))
                if rows.full():
                    yield rows.take()
        yield rows.take()

    return run


def _together(table: DataFrame, extra: list[str], finish: Callable, schema: str) -> DataFrame:
    """The records of a cut table: whole ones, and those put together from fragments."""
    pieces = F.sort_array(F.collect_list(F.struct("part", "piece")))
    broken = table.where("piece is not null").groupBy("src", "file_rank", "owner").agg(F.max("pos").alias("pos"), F.array_join(F.transform(pieces, lambda x: x["piece"]), "").alias("text"), *(F.first(c).alias(c) for c in extra))  # one record's text
    whole = table.where("piece is null").drop("owner", "part", "piece", "names")
    return whole.unionByName(broken.mapInArrow(finish, schema))


def csv_entries(spark: SparkSession, files: list[DataFile], make: Callable, schema: str, cut_schema: str, plain: Callable) -> DataFrame:
    """Entries of CSV files by ranges; ``make`` gives a collector of rows and fragments, ``plain`` one of rows."""
    states = chunks(spark, files).select("file_rank", "start", "row", "value").mapInArrow(_csv_states, "file_rank int, start long, last_row long, n_bytes long, n_chunks long, end0 int, end1 int, n0 long, n1 long")
    states = materialise(states, "csv-ranges").join(files_table(spark, files).select("file_rank", "length"), "file_rank")
    # Spark's text reader drops a byte order mark; the header is read apart
    states = states.withColumn("state", state_before(F.col("end0"), F.col("end1"))).withColumn("unended", _unended())
    begun, end = F.when(F.col("state") == 0, F.col("n0")).otherwise(F.col("n1")), F.when(F.col("state") == 0, F.col("end0")).otherwise(F.col("end1"))
    ranges = states.withColumns({"begun": begun, "end": end}).withColumns({"before": F.coalesce(F.sum("begun").over(earlier()), F.lit(0)), "owner": F.last(F.when((F.col("end") == 1) & (F.col("begun") > 0), F.col("start")), ignorenulls=True).over(earlier())})
    ranges = materialise(ranges.select("file_rank", "start", "state", "before", "owner", "unended"), "csv-states")
    names = spark.createDataFrame([(f.rank, header(spark, f.uri)) for f in files], "file_rank int, names array<string>")
    placed = with_ranges(spark, files, "\n", ranges).join(F.broadcast(names), "file_rank")
    table = materialise(placed.select("src", "file_rank", "start", "row", "state", "before", "owner", "unended", "names", "value").mapInArrow(_cut_csv(make), cut_schema), "csv")
    return _together(table, ["names"], _joined_csv(plain), schema)


# JSON

_KINDS = np.zeros(256, dtype=np.int8)
_KINDS[[ord("["), ord("{")]], _KINDS[[ord("]"), ord("}")]] = 1, -1


def scanned(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of JSON bytes that begin outside a string: which are inside strings, and what brackets do to the depth.

    A quote behind an odd number of backslashes is none.  The text may as well begin
    inside a string: then all that is inside is outside and the other way round.
    """
    slashes = np.flatnonzero(data == 0x5C)
    escaped = np.zeros(len(data) + 1, dtype=bool)
    if len(slashes):
        fresh = np.concatenate(([True], np.diff(slashes) != 1))
        first = slashes[fresh][np.cumsum(fresh) - 1]
        escaped[slashes[(slashes - first) % 2 == 0] + 1] = True
    inside = np.cumsum((data == 0x22) & ~escaped[:-1]) % 2 == 1
    return inside, _KINDS[data]


def _bytes(values: list[bytes], row: int, unended: int | None) -> np.ndarray:
    raw = b"}".join(values) + (b"" if unended is not None and row <= unended < row + len(values) else b"}")
    return np.frombuffer(raw, dtype=np.uint8)


def _json_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each range: its quotes' parity, and from either state the change of depth and the commas by depth."""
    found: list[dict] = []
    for begins, at, values in runs(batches):
        if begins:
            found.append({"file_rank": at["file_rank"], "start": at["start"], "last_row": at["row"] - 1, "n_bytes": 0, "n_chunks": 0, "parity": 0, "depth0": 0, "depth1": 0, "commas0": {}, "commas1": {}})
        here = found[-1]
        here["last_row"] += len(values)
        here["n_chunks"] += len(values)
        here["n_bytes"] += sum(map(len, values))
        data = _bytes(values, 0, None)  # a brace too many at the end of a file is never counted: what follows its last chunk is nothing
        inside, kinds = scanned(data)
        comma = data == 0x2C
        for k in (0, 1):
            outside = inside != (here["parity"] == k)  # begun in state k, the bytes outside strings
            depth = here[f"depth{k}"] + np.cumsum(np.where(outside, kinds, 0))
            levels, times = np.unique(depth[comma & outside], return_counts=True)
            for level, n in zip(levels.tolist(), times.tolist(), strict=True):
                here[f"commas{k}"][level] = here[f"commas{k}"].get(level, 0) + n
            here[f"depth{k}"] = int(depth[-1]) if len(depth) else here[f"depth{k}"]
        here["parity"] ^= int(inside[-1]) if len(inside) else 0
    counts = pa.map_(pa.int64(), pa.int64())
    rows = [{**r, "commas0": list(r["commas0"].items()), "commas1": list(r["commas1"].items())} for r in found]
    fields = [("file_rank", pa.int32()), *((n, pa.int64()) for n in ("start", "last_row", "n_bytes", "n_chunks")), ("parity", pa.int32()), ("depth0", pa.int64()), ("depth1", pa.int64()), ("commas0", counts), ("commas1", counts)]
    yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(fields))


_BLANK = b" \t\n\r"


def _item(src: str, pos: int, raw: bytes) -> tuple[int, Any, str | None]:
    """(place, value, error) of an item's text; what is no JSON is an error of the file."""
    try:
        value = strict_json.loads(raw.decode())
    except UnicodeDecodeError as exc:
        return WHOLE + pos, None, f"{src}: not valid UTF-8 ({exc.reason})"
    except ValueError as exc:
        return WHOLE + pos, None, f"{src}: invalid JSON: item {pos}: {exc}"
    return pos, value, None if isinstance(value, dict) else f"{src} item {pos}: expected an object"


def _cut_json(make: Callable):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, at, held, pos, part = make(), None, [], 0, 0

        def rest() -> None:
            """What lies behind the last comma, and before the first, may be a part of an item."""
            if at is not None:
                rows.fragment(at["src"], at["file_rank"], pos, 2 * at["start"] + part, pos, b"".join(held).hex(), None)

        for begins, first, values in runs(batches):
            if begins:
                rest()
                at, held, pos, part = first, [], first["before"] + 1, 0
                state, depth, row = first["state"], first["depth"], first["row"]
            data = _bytes(values, row, at["unended"])
            row += len(values)
            inside, kinds = scanned(data)
            outside = inside == bool(state)
            level = depth + np.cumsum(np.where(outside, kinds, 0))
            raw = data.tobytes()
            # only the array's own brackets lie at depth 0; all else there must be white space
            opens, closes = np.flatnonzero(outside & (kinds == 1) & (level == 1)), np.flatnonzero(outside & (kinds == -1) & (level == 0))
            stray = ((level <= 0) & ~(outside & (kinds == -1) & (level == 0)) & ~np.isin(data, list(_BLANK))).any()
            if stray or any(raw[i] != 0x5D for i in closes) or any(not begins or at["start"] + i != at["opening"] for i in opens):
                rows.add(at["src"], at["file_rank"], WHOLE, None, f"{at['src']}: invalid JSON: something beside the array")
            cut, before = np.flatnonzero(outside & (level == 1) & (data == 0x2C)), 0
            if len(opens):
                before = int(opens[0]) + 1
            for i in cut.tolist():
                held.append(raw[before:i])
                if part == 0 and at["start"]:  # begun before this range
                    rest()
                else:
                    place, value, error = _item(at["src"], pos, b"".join(held))
                    rows.add(at["src"], at["file_rank"], place, value, error)
                held, before, pos, part = [], i + 1, pos + 1, 1
                if rows.full():
                    yield rows.take()
            end = int(closes[0]) if len(closes) else len(raw)
            held.append(raw[before:end])
            depth, state = int(level[-1]) if len(level) else depth, int(state) ^ (int(inside[-1]) if len(inside) else 0)
        rest()
        yield rows.take()

    return run


def _joined_json(make: Callable):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = make()
        for batch in batches:
            for r in batch.to_pylist():
                raw = bytes.fromhex(r["text"])
                if raw.strip(_BLANK) or r["owner"] > 1:  # an array without items has one empty text
                    place, value, error = _item(r["src"], r["owner"], raw)
                    rows.add(r["src"], r["file_rank"], place, value, error)
                if rows.full():
                    yield rows.take()
        yield rows.take()

    return run


def json_entries(spark: SparkSession, files: list[DataFile], make: Callable, schema: str, cut_schema: str, plain: Callable, opening: dict[int, int]) -> DataFrame:
    """Entries of JSON files that hold an array, by ranges; ``opening`` says where each file's bracket stands."""
    states = chunks(spark, files, "}").select("file_rank", "start", "row", "value").mapInArrow(_json_states, "file_rank int, start long, last_row long, n_bytes long, n_chunks long, parity int, depth0 long, depth1 long, commas0 map<long,long>, commas1 map<long,long>")
    states = materialise(states, "json-ranges").join(files_table(spark, files).select("file_rank", "src", "length"), "file_rank")
    states = states.withColumns({"state": F.coalesce(F.sum("parity").over(earlier()), F.lit(0)) % 2, "unended": _unended()})
    ended = F.when(F.col("unended").isNotNull(), 1).otherwise(0)  # the brace that _json_states added
    change = F.when(F.col("state") == 0, F.col("depth0")).otherwise(F.col("depth1"))
    states = states.withColumn("change", change).withColumn("depth", F.coalesce(F.sum("change").over(earlier()), F.lit(0)))
    commas = F.coalesce(F.element_at(F.when(F.col("state") == 0, F.col("commas0")).otherwise(F.col("commas1")), 1 - F.col("depth")), F.lit(0))
    states = states.withColumn("commas", commas).withColumn("before", F.coalesce(F.sum("commas").over(earlier()), F.lit(0)))
    last = _is_last()
    final = states.select("src", "file_rank", "unended", last.alias("last"), ((F.col("state") + F.col("parity")) % 2).alias("open"), (F.col("depth") + F.col("change") + F.when(F.col("state") + F.col("parity") == 1, 0).otherwise(ended)).alias("left"))
    broken = final.where("last and (open = 1 or left <> 0)").select("src", "file_rank")
    ranges = materialise(states.select("file_rank", "start", "state", "depth", "before", "unended"), "json-states")
    openings = spark.createDataFrame(sorted(opening.items()), "file_rank int, opening long")
    placed = with_ranges(spark, files, "}", ranges).join(F.broadcast(openings), "file_rank")
    table = materialise(placed.select("src", "file_rank", "start", "row", "state", "depth", "before", "unended", "opening", "value").mapInArrow(_cut_json(make), cut_schema), "json")
    unclosed = broken.select("src", "file_rank", F.lit(WHOLE).alias("pos"), F.concat("src", F.lit(": invalid JSON: it ends within the array")).alias("err"))
    return _together(table, [], _joined_json(plain), schema).unionByName(unclosed, allowMissingColumns=True)
