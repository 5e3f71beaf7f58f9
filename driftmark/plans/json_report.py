"""The JSON report, whatever its size.

A report is a few constant texts and, between them, blocks of rows that Spark
orders and prints.  It is read as a stream of texts (one partition at a time by
the driver) or written to a file, whose blocks are part files that Spark wrote,
joined as bytes inside the JVM.  Names of fields are data too: no list of them
is held anywhere.  ``read`` gives the lists of a report in a file back as a
table, by ranges of its lines.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.typed import quoted
from ..operators.compare import DatasetDiff
from ..sources import by_range, files
from ..sources.chunks import chunks, runs
from .scratch import materialise, new_path


@dataclass
class Block:
    """Rows of a JSON list or object: the text before them, each row's ``value``, and the depth of the bracket that closes it."""

    before: str
    rows: DataFrame
    depth: int

    @property
    def close(self) -> str:
        return "\n" + "  " * self.depth


def _text(name: str) -> Column:
    return F.coalesce(quoted(F.col(name)), F.lit("null"))


def _names(name: str, depth: int) -> Column:
    """An array of strings, printed as a list at some depth."""
    inside, outside = "\n" + "  " * (depth + 1), "\n" + "  " * depth
    items = F.array_join(F.transform(name, quoted), "," + inside)
    return F.when(F.size(name) == 0, "[]").otherwise(F.concat(F.lit("[" + inside), items, F.lit(outside + "]")))


def _object(depth: int, *members: tuple[str, Column, Column | None]) -> Column:
    """An object at some depth; a member with a condition is left out where that is not true."""
    inside, outside = "\n" + "  " * (depth + 1), "\n" + "  " * depth
    parts = [F.concat(F.lit(f"{json.dumps(name)}: "), value) for name, value, _ in members]
    parts = [part if condition is None else F.when(condition, part) for part, (_, _, condition) in zip(parts, members, strict=True)]
    return F.concat(F.lit("{" + inside), F.concat_ws("," + inside, *parts), F.lit(outside + "}"))


def _rows(table: DataFrame, depth: int, value: Column) -> DataFrame:
    return table.select(F.concat(F.lit("\n" + "  " * depth), value).alias("value"))


def _changed(table: DataFrame) -> DataFrame:
    moved = F.col("before_id") != F.col("id") if "before_id" in table.columns else F.lit(False)
    before_id = _text("before_id") if "before_id" in table.columns else F.lit("null")
    return _rows(table.orderBy("a_file_rank", "a_pos"), 2, _object(2, ("id", _text("id"), None), ("label", _text("a_label"), None), ("before_id", before_id, moved), ("before_label", _text("b_label"), moved), ("fields", _names("changed", 3), None)))


def _alone(table: DataFrame, label: str) -> DataFrame:
    return _rows(table, 2, _object(2, ("id", _text("id"), None), ("label", _text(label), None)))


def blocks(diff: DatasetDiff) -> tuple[list[Block], str]:
    """The blocks of the report in their order, and what ends it."""
    head: dict[str, Any] = {
        "before": {"source": diff.before.source, "records": diff.before.records}, "after": {"source": diff.after.source, "records": diff.after.records},
        "match": diff.before.match.to_dict(), "ignore": list(diff.before.ignore), "has_changes": diff.has_changes, "counts": diff.counts,
    }
    start = json.dumps(head, ensure_ascii=False, indent=2)[: -len("\n}")]
    drift = lambda kind: diff.drift.where(F.col("change") == kind).orderBy("path")
    retyped = F.concat(_text("path"), F.lit(": "), _object(3, ("before", _names("before", 4), None), ("after", _names("after", 4), None)))
    found = [
        Block(start + ',\n  "fields_changed": {', _rows(diff.field_counts, 2, F.concat(_text("path"), F.lit(": "), F.col("n").cast("string"))), 1),
        Block('},\n  "schema": {\n    "added": [', _rows(drift("added"), 3, _text("path")), 2),
        Block('],\n    "removed": [', _rows(drift("removed"), 3, _text("path")), 2),
        Block('],\n    "retyped": {', _rows(drift("retyped"), 3, retyped), 2),
        Block(f'}}\n  }},\n  "order_changed": {json.dumps(diff.order_changed)},\n  "changed": [', _changed(diff.changes), 1),
        Block('],\n  "key_edited": [', _changed(diff.rekeyed), 1),
        Block('],\n  "removed": [', _alone(diff.removed, "b_label"), 1),
        Block('],\n  "added": [', _alone(diff.added, "a_label"), 1),
    ]
    return found, "]\n}\n"


def stream(diff: DatasetDiff) -> Iterator[str]:
    """The report in pieces, none larger than a record's."""
    found, end = blocks(diff)
    for block in found:
        yield block.before
        first = True
        for row in block.rows.toLocalIterator():
            yield row["value"] if first else "," + row["value"]
            first = False
        if not first:
            yield block.close
    yield end


def write(diff: DatasetDiff, path: str) -> None:
    """Write the report to one file of any store that Spark writes to; an existing file is replaced."""
    spark = diff.classified.sparkSession
    found, end = blocks(diff)
    pieces: list[files.Piece] = []
    for block in found:
        folder = new_path(spark, "report")
        block.rows.write.option("lineSep", ",").text(folder)
        pieces += [block.before.encode(), files.Parts(folder, 1, block.close.encode())]
    files.joined(spark, path, [*pieces, end.encode()])


#: Lines that name a part of the report, a member of the whole or of its schema; for Spark, and for Python.
_HEAD = '^(  "|    "(added|removed|retyped)": [\\[{])'
_PART = re.compile(rb'(  |    )"([a-z_]+)"')
_ARROW = pa.schema([("section", pa.string()), ("part", pa.int64()), ("opens", pa.bool_()), ("whole", pa.bool_()), ("value", pa.string())])
_BATCH = 10_000


def _inside(section: str) -> bytes:
    """What the lines of a part's items begin with."""
    return b"?" if section == "schema" else b"      " if section.startswith("schema ") else b"    "


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items of ranges of lines.  A range's last item may go on in the next range, and what comes before its first goes on with an earlier one: these are fragments."""
    rows: list[tuple] = []
    part, section, inside, held, opens = 0, "", b"?", [], False

    def done(whole: bool) -> None:
        if held:
            rows.append((section, part, opens, whole and opens, b"\n".join(held)))
            held.clear()

    def taken() -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(_ARROW)
        rows.clear()
        return pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(columns[:-1], _ARROW, strict=False)), pa.array(columns[-1], pa.binary()).cast(pa.string())], schema=_ARROW)

    for begins, first, lines in runs(batches):
        if begins:
            done(False)
            part, section, opens = first["start"], first["section"] or "", False
            inside = _inside(section)
        for line in lines:
            if line.startswith(inside):
                if line[len(inside) : len(inside) + 1] not in (b" ", b"}", b"]"):
                    done(True)
                    opens = True
                held.append(line)
                continue
            done(True)
            if head := _PART.match(line):
                section = ("schema " if len(head[1]) == 4 else "") + head[2].decode()
                inside = _inside(section)
        if len(rows) >= _BATCH:
            yield taken()
    done(False)
    yield taken()


def read(spark: SparkSession, path: str) -> DataFrame:
    """(section, value): the text of each item that a report of ``write`` lists, in no order; sections are fields_changed, changed, ..., schema added, ....

    Texts of such a report have no line breaks of their own, so its indentation tells where items begin.
    """
    some = files.input_files(spark, path)
    lines = chunks(spark, some).withColumn("text", F.col("value").cast("string"))
    heads = lines.groupBy("file_rank", "start").agg(F.max_by("text", F.when(F.col("text").rlike(_HEAD), F.col("row"))).alias("head"))
    head = F.last("head", ignorenulls=True).over(by_range.earlier())
    name = F.concat(F.when(head.startswith("    "), "schema ").otherwise(""), F.regexp_extract(head, '"([a-z_]+)"', 1))
    ranges = materialise(heads.select("file_rank", "start", name.alias("section")), "report-ranges")
    placed = by_range.with_ranges(spark, some, "\n", ranges).select("file_rank", "start", "row", "section", "value")
    table = materialise(placed.mapInArrow(_items, "section string, part long, opens boolean, whole boolean, value string"), "report-items")
    fragments = table.where("not whole").withColumn("item", F.sum(F.col("opens").cast("int")).over(Window.orderBy("part", "opens").rowsBetween(Window.unboundedPreceding, Window.currentRow)))  # two rows for each range
    pieces = F.sort_array(F.collect_list(F.struct("part", "opens", "value")))
    joined = fragments.groupBy("item", "section").agg(F.array_join(F.transform(pieces, lambda x: x["value"]), "\n").alias("value"))
    return table.where("whole").select("section", "value").unionByName(joined.select("section", "value")).select("section", F.rtrim("value", F.lit(",")).alias("value"))
