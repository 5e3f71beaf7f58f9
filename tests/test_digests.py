"""Hashes over all entries of a snapshot."""

import pytest

from driftmark import queries
from driftmark.operators.matching import Match

SQL = queries.oracle_sql()


def test_hashes_of_a_snapshot_are_made_by_tasks(spark, tiny, oracle, monkeypatch):
    """The driver gets digests only, and of nothing the hash of an empty list."""
    from pyspark.sql import DataFrame

    monkeypatch.setattr(DataFrame, "toLocalIterator", lambda *_: pytest.fail("rows pass by the driver"))
    row, found = oracle(SQL["dataset_hash"]).iloc[0], queries.dataset_hash(spark, tiny).first()
    assert (found["dataset_hash"], found["order_hash"]) == (row["dataset_hash"], row["order_hash"])
    none = queries.version(queries.table(spark, tiny, "nation").limit(0), "n_nationkey", Match("id", ("n_nationkey",)))
    assert none.dataset_hash == "4f53cda18c2baa0c0354bb5f9a3ecbe5ed12ab4d8e11ba873c2f11161202b945"
