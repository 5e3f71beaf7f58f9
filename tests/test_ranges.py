"""Files read by byte ranges against the same files read whole, cut everywhere."""

import csv
import io
import json
import random

import pyarrow as pa
import pytest

from driftmark.errors import InputError
from driftmark.operators.matching import Match
from driftmark.sources import by_range, chunks, readers

CONTENT = Match("content")


@pytest.fixture
def cut(spark, monkeypatch):
    """Read everything by ranges of so many bytes."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def at(size):
        monkeypatch.setattr(readers, "LARGE", -1)
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")

    yield at
    for k, v in old.items():
        spark.conf.set(k, v)


def entries(spark, path):
    df = readers.read_entries(spark, str(path), CONTENT)
    return sorted(tuple(str(v) for v in r) for r in df.select("src", "file_rank", "pos", "raw_id", "label", "fields", "types", "leaves", "err").collect())


CSV = {
    "plain.csv": "a,b\n1,2\n\n3,4\n5",
    "quoted.csv": 'a,"b\n c",d\r\n"x\n\n""y"", z\r",2,3\n\r\n4,"5",6,7\n"8""\n",9\n10,11"12,"13"14\n',
    "open.csv": 'a,b\n1,2\n3,"4\n5,6\n',
    "open2.csv": 'a,b\n1,"2\n3',
    "blank.csv": "\n\na,b\n1,2\n",
    "header.csv": '"a\nb\n\nc",d\n1,2\n"3\n4",5\n',
    "returns.csv": 'a,b\r1,"2\r3"\r\r\n4,5\r',
    "empty.csv": "",
    "twice.csv": "a,a,é\n1,2,ü\n",
}


@pytest.mark.parametrize("size", [25, 1 << 20])
def test_csv_cut_anywhere(spark, tmp_path, cut, size):
    for name, text in CSV.items():
        (tmp_path / name).write_bytes(text.encode())
    (tmp_path / "_hidden.csv").write_bytes(CSV["quoted.csv"].encode())
    whole = entries(spark, tmp_path)
    assert len(whole) > 20
    cut(size)
    assert entries(spark, tmp_path) == whole


def batches(data, size, separator, columns):
    """The rows that Spark would hand to a task of all ranges, with each range's ``columns``."""
    for at in range(0, len(data), size):
        values = list(chunks.read_range(io.BytesIO(data), at, min(at + size, len(data)), separator))
        for k, v in enumerate(values):
            row = {"src": "x", "file_rank": 0, "start": at, "row": 100 * at + k, "value": v, **columns.get(at, {})}
            yield pa.RecordBatch.from_pylist([row])


def by_ranges(data, size, kind):
    """(pos, value, error) of a file's records by ranges of ``size`` bytes, composed by a plain loop."""
    found, fragments = [], {}

    class Rows:
        def __init__(self):
            self.rows = []

        def add(self, src, rank, pos, value, wrong=None):
            found.append((pos, value, wrong))

        def fragment(self, src, rank, owner, part, pos, piece, names):
            fragments.setdefault(owner, []).append((part, pos, piece, names))

        def full(self):
            return False

        def take(self):
            return None

    separator = b"\n" if kind == "csv" else b"}"
    ended = data.endswith(separator)
    columns, state, before, depth, owner, starts = {}, 0, 0, 0, None, []
    states = by_range._csv_states if kind == "csv" else by_range._json_states
    for r in (r for batch in states(batches(data, size, separator, {})) for r in batch.to_pylist()):
        starts.append(r["start"])
        columns[r["start"]] = {"state": state, "before": before, "owner": owner, "depth": depth, "unended": None, "names": None, "opening": None}
        if kind == "csv":
            begun, end = r[f"n{state}"], r[f"end{state}"]
            owner = r["start"] if end and begun else owner
            state, before = end, before + begun
        else:
            before, depth, state = before + dict(r[f"commas{state}"]).get(1 - depth, 0), depth + r[f"depth{state}"], (state + r["parity"]) % 2
        last = r["last_row"]
    if starts and not ended:
        columns[starts[-1]]["unended"] = last
    names = next(csv.reader(io.StringIO(data.decode(), newline="")), []) if kind == "csv" else None
    for c in columns.values():
        c |= {"names": names, "opening": len(data) - len(data.lstrip())}
    cutter, joiner = (by_range._cut_csv, by_range._joined_csv) if kind == "csv" else (by_range._cut_json, by_range._joined_json)
    wide = pa.schema([("src", pa.string()), ("file_rank", pa.int32()), ("start", pa.int64()), ("row", pa.int64()), ("value", pa.binary()), ("state", pa.int32()), ("before", pa.int64()), ("owner", pa.int64()), ("depth", pa.int64()), ("unended", pa.int64()), ("names", pa.list_(pa.string())), ("opening", pa.int64())])
    list(cutter(Rows)(pa.RecordBatch.from_pylist(b.to_pylist(), schema=wide) for b in batches(data, size, separator, columns)))
    whole = [{"src": "x", "file_rank": 0, "owner": o, "pos": max((p for _, p, _, _ in parts if p is not None), default=None), "text": "".join(x for _, _, x, _ in sorted(parts, key=lambda y: y[0])), "names": names} for o, parts in fragments.items()]
    list(joiner(Rows)([pa.RecordBatch.from_pylist(whole)] if whole else []))
    return sorted(found, key=str)


@pytest.mark.parametrize("size", [*range(1, 30), 1000])
def test_csv_cut_at_every_byte(size):
    draw = random.Random(size)
    texts = [*CSV.values(), *("".join(draw.choice('ab,,""\n\n\r') for _ in range(120)) for _ in range(10))]
    for text in texts:
        assert by_ranges(text.encode(), size, "csv") == sorted(readers._csv_file("x", text), key=str), text


@pytest.mark.parametrize("size", [*range(1, 30), 1000])
def test_json_cut_at_every_byte(size):
    for text in JSON.values():
        assert by_ranges(text.encode(), size, "json") == sorted(readers._json_file("x", text), key=str), text
    for text in BROKEN[:-1]:
        if text not in ('[{"a": 1}', '[{"a": "1}]', "["):  # those are seen by the composition
            assert any(wrong for _, _, wrong in by_ranges(text.encode(), size, "json")), text


def test_lines_that_stay_open():
    draw = random.Random(1)
    for _ in range(3000):
        line = "".join(draw.choice('a,""\r ') for _ in range(draw.randrange(9))).replace("\r", "") + "\n"
        for quoted in (False, True):
            rows = list(csv.reader(['"' + line if quoted else line, "@\n"]))
            assert by_range.stays_open(line, quoted) == (len(rows) == 1 and rows[0] != ["@"]), (line, quoted)


JSON = {
    "plain.json": '[{"a": 1}, {"a": {"b": [1, 2, {"c": "}"}]}}, {}]',
    "strings.json": '\n [ {"a,": "x\\"y}],[{", "b": "\\\\"},\n{"é": "ü}\\\\\\"{"} , {"a": [[], [{}]]}\n]\n ',
    "none.json": " [ ] ",
    "many.json": json.dumps([{"i": i, "t": "}" * (i % 4) + '"' * (i % 3)} for i in range(60)]),
}
BROKEN = ['[{"a": 1},]', '[{"a": 1} {"a": 2}]', '[{"a": 1}', '[{"a": "1}]', '[{"a": 1}]]', '[{"a": 1}] x', '[{"a": 1}] [{"a": 2}]', '[{"a": 1}}', '[,{"a": 1}]', '[{"a": 1, "a": 2}]', '[{"a": NaN}]', '[{"a": 1}, 5]', '[{"a": 1}, {"b": \\"x\\"}]', "[", '[{"a"}]']


@pytest.mark.parametrize("size", [40, 1 << 20])
def test_json_cut_anywhere(spark, tmp_path, cut, size):
    for name, text in JSON.items():
        (tmp_path / name).write_bytes(text.encode())
    (tmp_path / ".hidden.json").write_bytes(JSON["strings.json"].encode())
    whole = entries(spark, tmp_path)
    assert len(whole) > 65
    cut(size)
    assert entries(spark, tmp_path) == whole


@pytest.mark.parametrize("size", [1 << 20])
def test_broken_json(spark, tmp_path, cut, size):
    cut(size)
    for i, text in enumerate(BROKEN):
        (tmp_path / f"{i:02}.json").write_text(text)
    found = {r["src"] for r in readers.read_entries(spark, str(tmp_path), CONTENT).where("err is not null").collect()}
    assert found == {f"{i:02}.json" for i in range(len(BROKEN))}


@pytest.mark.parametrize("size", [9, 1 << 20])
def test_json_lines(spark, tmp_path, cut, size):
    text = '{"a": 1}\n\n{"a": 2}\r\n{"a": 3}\r\r{"a": "x"}\r\n \n{"a": 4}'
    (tmp_path / "a.jsonl").write_bytes(text.encode())
    (tmp_path / "_b.jsonl").write_bytes(text.encode())
    cut(size)
    want = [(i, json.loads(line)["a"]) for i, line in enumerate(io.StringIO(text, newline=None), 1) if line.strip()]
    rows = readers.read_rows(spark, str(tmp_path)).collect()
    for name in ("a.jsonl", "_b.jsonl"):
        assert sorted((r["position"], json.loads(r["data"])["a"]) for r in rows if r["source"] == name) == want


@pytest.mark.parametrize("name", ["a.jsonl", "_a.jsonl"])
def test_byte_order_mark(spark, tmp_path, name):
    from driftmark.operators import entries as ent

    (tmp_path / name).write_bytes(b'\xef\xbb\xbf{"a": 1}\n{"a": 2}\n')
    with pytest.raises(InputError, match="line 1: invalid JSON: unexpected byte order mark"):
        ent.first_error(readers.read_entries(spark, str(tmp_path / name), CONTENT))


@pytest.mark.parametrize("size", range(1, 9))
def test_ranges_of_a_stream(size):
    for data in (b"", b"\n", b"ab\ncd\n\nefg\n", b"ab\ncd", b"\n\n\na", b"abcdefghijkl"):
        got = [c for at in range(0, len(data), size) for c in chunks.read_range(io.BytesIO(data), at, min(at + size, len(data)), b"\n", 2)]
        want = data.split(b"\n")
        assert got == (want[:-1] if not want[-1] else want)
