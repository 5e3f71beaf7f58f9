import pytest

from driftmark import queries

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_equals_sql(name, spark, tiny, oracle, same_rows):
    same_rows(queries.queries()[name](spark, tiny).toPandas(), oracle(SQL[name]))


def test_flagship_constants(spark):
    got = {r["kind"]: r["n"] for r in queries.diff_counts_by_id(spark, "/root/testdata/sf0.01").collect()}
    assert got == {"unchanged": 10_789, "changed": 2_847, "removed": 1_364, "added": 883}


def test_entry_has_a_query_for_each_name():
    import __spark_entry__ as entry

    assert set(queries.queries()) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", ["record_hash", "field_hash"])
def test_hashes_have_one_zero(name, spark, oracle, same_rows, tmp_path):
    """-0.0 and 0.0 are one value: canonical JSON has 0.0 for both, and so has the SQL."""
    spark.sql("select 1L c_custkey, 'a' c_name, 2 c_nationkey, cast('-0.0' as double) c_acctbal, 'B' c_mktsegment union all select 2L, 'a', 2, 0D, 'B'").coalesce(1).toPandas().to_parquet(tmp_path / "customer.parquet")
    same_rows(queries.queries()[name](spark, str(tmp_path)).toPandas(), oracle(SQL[name], str(tmp_path)))
