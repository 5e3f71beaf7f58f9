"""Files that queries write and read: their order and their number."""

import json
from pathlib import Path

import duckdb
import pytest

from driftmark import queries
from driftmark.operators.compare import compare
from driftmark.operators.matching import Match
from driftmark.operators.snapshot import build_snapshot
from driftmark.plans import json_report

SQL = queries.oracle_sql()


def test_ranges_of_one_file_are_in_the_order_of_keys(spark, oracle, same_rows, tmp_path):
    """A file whose rows come from many tasks, in no order."""
    for name, key in (("orders", "o_orderkey"), ("customer", "c_custkey")):
        duckdb.sql(f"copy (select * from '/root/testdata/sf0.01/{name}.parquet' order by hash({key})) to '{tmp_path}/{name}.parquet' (row_group_size 2048)")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        for name in ("read_csv_ranges", "read_json_ranges"):
            same_rows(queries.queries()[name](spark, str(tmp_path)).toPandas(), oracle(SQL[name], str(tmp_path)))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_files_of_a_larger_table_are_more(spark):
    few, many = spark.range(0, 100, 1, 2), spark.range(0, 100, 1, 12)
    assert [len(spark.read.text(queries._written(df, "lines")).inputFiles()) for df in (few, many)] == [3, 12]


@pytest.mark.parametrize("size", [61, 700, 1 << 20])
def test_a_report_is_read_by_ranges(spark, tmp_path, size):
    """The lists of a report in a file, read by ranges that cut its items anywhere, are those of the report as one JSON document."""
    name = 'a"\\\n, [{ é'
    old = [{"id": f"{name}{i}", f"f{i},": i, "x": [i]} for i in range(6)] + [{"id": "gone", "v": 1}]
    new = [{**r, f"f{i},": "y", **{f"n{j}": j for j in range(i)}} for i, r in enumerate(old[:6])] + [{"id": "here", "w": {}}]
    paths = [tmp_path / f"{x}.jsonl" for x in "ab"]
    for path, rows in zip(paths, (old, new), strict=True):
        path.write_text("".join(json.dumps(r) + "\n" for r in rows))
    report = str(tmp_path / "report.json")
    json_report.write(compare(*(build_snapshot(spark, str(p), Match("id", ("id",))) for p in paths)), report)
    data = json.loads(Path(report).read_text(encoding="utf-8"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    try:
        found = json_report.read(spark, report).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    items = lambda section, form: sorted((json.loads(form.format(r["value"])) for r in found if r["section"] == section), key=str)
    listed = lambda rows: sorted(rows, key=str)
    for section in ("changed", "removed", "added"):
        assert data[section] and [x for x, in items(section, "[{}]")] == listed(data[section])
    for section, rows in (("fields_changed", data["fields_changed"]), ("schema retyped", data["schema"]["retyped"])):
        assert rows and items(section, "{{{}}}") == listed({k: v} for k, v in rows.items())
    for section in ("added", "removed"):
        assert data["schema"][section] and [x for x, in items(f"schema {section}", "[{}]")] == listed(data["schema"][section])
