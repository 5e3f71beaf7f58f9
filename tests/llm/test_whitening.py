"""Whitening against exact fractions and NumPy."""

from fractions import Fraction

import numpy as np
import pytest

from driftmark.llm import oracles, queries, whitening


def exact(vectors):
    """n, sums and scatter of the distinct vectors, in Python integers."""
    fit = sorted(set(map(tuple, vectors)))
    n, d = len(fit), len(fit[0])
    s = [sum(v[i] for v in fit) for i in range(d)]
    return fit, n, s, [[n * sum(v[i] * v[j] for v in fit) - s[i] * s[j] for j in range(d)] for i in range(d)]


@pytest.mark.parametrize("size", [1 << 10, 1 << 30, 1 << 50, (1 << 63) - 1])
def test_products_are_exact(size):
    y = np.random.default_rng(size % 97).integers(-size, size, (300, 5), dtype=np.int64)
    y = y if size < whitening.SAFE else y.astype(object)
    assert whitening.products(y).astype(object).tolist() == y.astype(object).T.dot(y.astype(object)).tolist()


def test_moments_with_a_great_offset(spark):
    draw = np.random.default_rng(1)
    rows = [([float(x) for x in 1e12 + draw.normal(size=3)],) for _ in range(400)] + [([1e12, 1e12, 1e12],)] * 50 + [([1e30, -1e30, 0.5],)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "vec_id long, embedding array<double>")
    vectors = [[min(max(int(np.floor(256 * c)), -(2**63)), 2**63 - 1) for c in r[0]] for r in rows]
    _, n, s, scatter = exact(vectors)
    found = whitening.moments(whitening.usable(df).select("x").distinct().repartition(5))[3]
    assert (found.n, found.sums, found.scatter.tolist()) == (n, s, scatter)


def test_rows(spark, tiny):
    table = spark.read.parquet(f"{tiny}/embeddings.parquet")
    table = table.unionByName(table.where("vec_id < 40"))
    vectors = [[int(np.floor(256 * float(c))) for c in r["embedding"]] for r in table.collect()]
    fit, n, s, scatter = exact(vectors)
    v = np.array([[float(Fraction(x, n * n)) for x in row] for row in scatter])
    values, axes = np.linalg.eigh(v)
    rows = queries.op12_embedding_whitening(spark, tiny).toPandas()
    assert len(rows) == 4 * 500 and set(rows["n"]) == {n} and rows["identity_error"].max() < 1e-9
    rows = whitening.whiten(table).toPandas()
    assert len(rows) == 4 * len(vectors) and set(rows["n"]) == {n}
    of = {r["vec_id"]: x for r, x in zip(table.collect(), vectors, strict=True)}
    for k in range(4):
        part = rows[rows["component"] == k + 1]
        assert np.allclose(part["explained"], values[-1 - k] / np.trace(v), rtol=1e-9)
        centred = np.array([[float(Fraction(n * a - b, n)) for a, b in zip(of[i], s, strict=True)] for i in part["vec_id"]])
        want = centred @ axes[:, -1 - k] / np.sqrt(values[-1 - k])
        assert np.allclose(want, part["whitened"], atol=1e-7) or np.allclose(-want, part["whitened"], atol=1e-7)
        assert part["deviation"].tolist() == [str(sum((n * a - b) ** 2 for a, b in zip(of[i], s, strict=True))) for i in part["vec_id"]]


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1e30, 2.0]), (2, [-1e30, -1.0]), (3, [3.5, -2.25]), (3, [3.5, -2.25]), (None, [7.0]), (4, []), (5, None), (6, [nan, 1.0]), (7, [None, 1.0]), (8, [inf, 1.0]), (9, [-0.0, -0.001])]
    df = spark.createDataFrame([(*r, 1, "clash") for r in rows], "vec_id long, embedding array<double>, x int, d string")
    found = whitening.whiten(df).toPandas()
    assert sorted(found[found["d"] == 2]["vec_id"]) == [1, 1, 2, 2, 3, 3, 3, 3, 9, 9]
    alone = found[found["d"] == 1]
    assert len(alone) == 1 and alone["whitened"].isna().all() and alone["explained"].tolist() == [0.0] and alone["identity_error"].isna().all() and alone["deviation"].tolist() == ["0"]
    assert found["vec_id"].isna().sum() == 1 and set(found["d"]) == {1, 2}
    assert whitening.whiten(df.limit(0)).collect() == []


def test_equal_rows_have_no_extent(spark):
    found = whitening.whiten(spark.createDataFrame([(i, [1.0, 2.0, 3.0]) for i in range(30)], "vec_id long, embedding array<float>")).collect()
    assert len(found) == 90 and all(r["whitened"] is None and r["n"] == 1 for r in found)


def test_scatter_equals_sql(spark, tiny, oracle, same_rows):
    same_rows(queries.whitening_scatter(spark, tiny).toPandas(), oracle(oracles.SQL["whitening_scatter"]))
