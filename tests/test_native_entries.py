"""Entries of typed columns without Python, where it would say the same."""

import numpy as np

from driftmark import queries
from driftmark.functions import typed


def test_floats_have_the_shortest_digits(spark, monkeypatch):
    """Digits that Spark prints as Python does are taken from it; all others go through Python, and both are the shortest."""
    draw = np.random.default_rng(3)
    some = [0.0, -0.0, 0.1, 0.001, 0.00099999, 9999999.5, 1e7, -1e7, 2e-3, 123456.789, 1e16, 1e22, 2e23, 5e-324, 1 / 3, -2.5, 1234567.123456789, float("nan"), float("inf"), float("-inf")]
    some += [*draw.normal(0, 1000, 200), *draw.normal(0, 1e-4, 50), *np.round(draw.uniform(-1e6, 1e6, 500), 2)]
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(some)], "i long, x double")
    root = typed.tree(df.select("x").schema)
    rows = df.select("i", *typed.leaf_columns(root)).collect()
    want = {i: (str(x), None) if not np.isfinite(x) else (None, repr(float(x) or 0.0)) for i, x in enumerate(some)}
    assert {r["i"]: (r["t0"], r["j0"]) for r in rows} == want


def test_maps_of_flat_records_are_compiled(spark, tiny):
    plan = queries.entries(queries.table(spark, tiny, "orders"), "o_orderkey", queries.BY_ORDER)
    text = plan.select("fields", "types")._jdf.queryExecution().optimizedPlan().toString()
    assert "map_from_entries" not in text and "map_from_arrays" in text
