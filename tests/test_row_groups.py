"""Parquet files that Spark's reader refuses or takes for others."""

import datetime
import decimal
import json

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from driftmark.errors import InputError
from driftmark.operators.matching import Match
from driftmark.sources import readers, row_groups


def data(spark, path):
    rows = readers.read_rows(spark, str(path)).orderBy("file_rank", "position").collect()
    return [(r["source"], r["position"], json.loads(r["data"])) for r in rows]


def test_types_of_their_own(spark, tmp_path):
    day = datetime.date(2024, 2, 29)
    table = pa.table({
        "ns": pa.array([1_700_000_000_123_456_789, None], pa.timestamp("ns")), "zone": pa.array([1_700_000_000_000_000_000, 0], pa.timestamp("ns", "UTC")),
        "time": pa.array([datetime.time(1, 2, 3, 4), None]), "took": pa.array([datetime.timedelta(seconds=90, microseconds=5), None]), "large": pa.array([2**64 - 1, 0], pa.uint64()),
        "half": pa.array(np.array([1.5, np.inf], dtype=np.float16)), "in": pa.array([{"t": datetime.time(5), "d": day}, None]), "list": pa.array([[2**63], []], pa.list_(pa.uint64())),
        "raw": pa.array([b"\x00\xff", b""]), "money": pa.array([decimal.Decimal("0E-10"), decimal.Decimal("12.50")], pa.decimal128(20, 10)), "nan": pa.array([float("nan"), float("-inf")]), "map": pa.array([[("a", 1)], []], pa.map_(pa.string(), pa.int64())),
    })
    pq.write_table(table, tmp_path / "a.parquet", row_group_size=1)
    (_, one, first), (_, two, second) = data(spark, tmp_path)
    assert (one, two) == (1, 2)
    assert first == {
        "ns": "2023-11-14T22:13:20.123456789", "zone": "2023-11-14T22:13:20+00:00", "time": "01:02:03.000004", "took": 90.000005, "large": 2**64 - 1, "half": 1.5,
        "in": {"t": "05:00:00", "d": "2024-02-29"}, "list": [2**63], "raw": "AP8=", "money": "0E-10", "nan": "nan", "map": [["a", 1]],
    }
    assert second["took"] is None and second["half"] == "inf" and second["nan"] == "-inf" and second["list"] == [] and second["in"] is None and second["money"] == "12.5000000000"


def test_legacy_timestamps_have_no_zone(spark, tmp_path):
    pq.write_table(pa.table({"t": pa.array([datetime.datetime(2024, 1, 2, 3, 4, 5)], pa.timestamp("us"))}), tmp_path / "a.parquet", use_deprecated_int96_timestamps=True)
    assert data(spark, tmp_path)[0][2] == {"t": "2024-01-02T03:04:05"}


def test_both_ways_agree_and_hidden_files_are_read(spark, tmp_path):
    table = pa.table({"id": list(range(50)), "s": [f"é{i}" for i in range(50)], "f": [i / 7 for i in range(50)], "d": [{"x": None, "y": [i]} for i in range(50)], "ts": pa.array([datetime.datetime(2024, 1, 1, 0, 0, i) for i in range(50)], pa.timestamp("us")), "n": pa.array([decimal.Decimal(i) for i in range(50)], pa.decimal128(9, 2))})
    for name in ("a.parquet", "_a.parquet", ".b.parquet"):
        pq.write_table(table, tmp_path / name, row_group_size=7)
    pq.write_table(table.select(["id"]), tmp_path / "c.parquet")
    rows = data(spark, tmp_path)
    parts = {name: [r[1:] for r in rows if r[0] == name] for name in ("a.parquet", "_a.parquet", ".b.parquet", "c.parquet")}
    assert len(rows) == 200 and parts["a.parquet"] == parts["_a.parquet"] == parts[".b.parquet"] and parts["a.parquet"][3][0] == 4
    assert readers.detect_match(spark, str(tmp_path)) == Match("id", ("id",))


def test_a_broken_footer_names_the_file(spark, tmp_path):
    (tmp_path / "a.parquet").write_bytes(b"no table")
    with pytest.raises(InputError, match="a.parquet"):
        readers.read_entries(spark, str(tmp_path), Match("content"))


def test_footers_are_read_once_for_all_files(spark, tmp_path, monkeypatch):
    for i in range(5):
        pq.write_table(pa.table({"a": [i]}), tmp_path / f"{i}.parquet")
    calls = []
    real = row_groups.footers
    monkeypatch.setattr(row_groups, "footers", lambda s, f: calls.append(len(f)) or real(s, f))
    assert [x[2] for x in data(spark, tmp_path)] == [{"a": i} for i in range(5)] and calls == [5]
