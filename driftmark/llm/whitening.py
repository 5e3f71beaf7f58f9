"""Whitening of embeddings from an exact integer scatter.

Entries become integers (256 steps to the unit).  The fit list is each distinct
integer vector once.  Every task subtracts one shift from its vectors, which
leaves small numbers, and adds up their sums and cross-products in integers of
any size; Spark adds the tasks' sums limb by limb.  From the totals
n XtX - S St is formed exactly, and only then turned into floating point and
decomposed.  So the covariance has no rounding of its own, whatever the order
of rows, the offset of the data or the number of tasks.

Products come from floating-point matrix products that cannot round: numbers
are split into limbs of 21 bits, so that a block of 8192 products of limbs
stays below 2**53.  The driver holds one d x d matrix, never vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import materialise

STEPS, COMPONENTS = 256, 4
ROWS, RADIX = 8192, 21
#: Below this, sums and differences of two numbers fit 64 bits.
SAFE = 1 << 61
#: Totals leave a task in limbs of 30 bits, each a long that Spark can add up over 2**33 tasks: 180 bits in all.
LIMBS, LIMB = 6, 30
#: Cells of matrices that a task holds before it hands them on (tables of many lengths).
HELD = 4_000_000


def fixed_point(vector: Column) -> Column:
    """floor(256 c) of each entry; beyond 64 bits the nearest long."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * STEPS).cast("long"))


def usable(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and x of the rows whose vector is there, with finite entries only."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))
    rows = embeddings.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("v"))
    return rows.where(F.col("v").isNotNull() & F.forall("v", finite)).select("vec_id", fixed_point(F.col("v")).alias("x"))


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, their vectors as one matrix) for each length of vector in a batch."""
    lists = batch.column(batch.schema.get_field_index("x"))
    sizes = np.asarray(pc.list_value_length(lists), dtype=np.int64)
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        yield at, lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(at), int(d))


def _less(x: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """x - shift, as Python integers where 64 bits might not do."""
    if np.abs(x.astype(np.float64)).max(initial=0) < SAFE and np.abs(shift.astype(np.float64)).max(initial=0) < SAFE:
        return x - shift
    return x.astype(object) - shift.astype(object)


def products(y: np.ndarray) -> np.ndarray:
    """yT y of at most ROWS rows, exactly: int64 where that is sure to do, else Python integers."""
    if y.dtype == object:
        return y.T.dot(y)
    limbs, rest = [], y
    while not limbs or rest.any():
        low = ((rest + (1 << RADIX - 1)) & ((1 << RADIX) - 1)) - (1 << RADIX - 1)
        limbs.append(low.astype(np.float64))
        rest = (rest - low) >> RADIX
    if len(limbs) == 1:
        return (limbs[0].T @ limbs[0]).astype(np.int64)
    total = np.zeros((y.shape[1], y.shape[1]), dtype=object)
    for i, a in enumerate(limbs):
        for j, b in enumerate(limbs):
            total = total + (a.T @ b).astype(np.int64).astype(object) * (1 << RADIX * (i + j))
    return total


class _Total:
    """Sum of many product matrices in integers of any size."""

    def __init__(self, d: int) -> None:
        self.small, self.times, self.large = np.zeros((d, d), dtype=np.int64), 0, None

    def add(self, part: np.ndarray) -> None:
        if part.dtype == object:
            self.large = part if self.large is None else self.large + part
            return
        self.small += part  # each below 2**53
        self.times += 1
        if self.times == 256:
            self.large = self.small.astype(object) + (0 if self.large is None else self.large)
            self.small, self.times = np.zeros_like(self.small), 0

    def value(self) -> np.ndarray:
        return self.small.astype(object) + (0 if self.large is None else self.large)


def _limbs(values: list[int]) -> list[pa.Array]:
    """The numbers as LIMBS columns: the last is signed, the others are not."""
    mask = (1 << LIMB) - 1
    return [pa.array([(v >> LIMB * k) & mask if k < LIMBS - 1 else v >> LIMB * k for v in values], pa.int64()) for k in range(LIMBS)]


_NAMES = ["d", "i", "j", *(f"limb{k}" for k in range(LIMBS))]
_PARTS = "d int, i int, j int, " + ", ".join(f"limb{k} long" for k in range(LIMBS))


def _add_up(shifts: dict[int, list[int]]):
    """Task function: products of (x - shift, 1) with itself, summed; the last row holds sums and the count."""

    def rows(totals: dict[int, _Total]) -> Iterator[pa.RecordBatch]:
        for d, total in totals.items():
            i, j = np.triu_indices(d + 1)
            cells = [pa.array(np.full(len(i), d), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32())]
            yield pa.RecordBatch.from_arrays([*cells, *_limbs(total.value()[i, j].tolist())], _NAMES)
        totals.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, _Total] = {}
        for batch in batches:
            for _, x in _by_length(batch):
                d = x.shape[1]
                if d not in totals and sum((k + 1) ** 2 for k in totals) > HELD:
                    yield from rows(totals)
                total, shift = totals.setdefault(d, _Total(d + 1)), np.array(shifts[d], dtype=np.int64)
                for a in range(0, len(x), ROWS):
                    y = _less(x[a : a + ROWS], shift)
                    total.add(products(np.concatenate([y, np.ones((len(y), 1), dtype=y.dtype)], axis=1)))
        yield from rows(totals)

    return run


@dataclass
class Moments:
    """Of the fit vectors of one length: count, sums and n XtX - S St, all exact."""

    n: int
    sums: list[int]
    scatter: np.ndarray  # of Python integers


def moments(fit: DataFrame) -> dict[int, Moments]:
    """Exact moments of ``fit`` (distinct vectors x) by length."""
    shifts = {r["d"]: list(r["x"]) for r in fit.groupBy(F.size("x").alias("d")).agg(F.min("x").alias("x")).collect()}  # a vector for each length
    parts = fit.mapInArrow(_add_up(shifts), _PARTS).groupBy("d", "i", "j").agg(*(F.sum(f"limb{k}").alias(f"limb{k}") for k in range(LIMBS)))
    cells: dict[int, list[tuple[int, int, int]]] = {}
    for d, i, j, *limbs in parts.collect():  # a row for each cell of the matrices
        cells.setdefault(d, []).append((i, j, sum(v << LIMB * k for k, v in enumerate(limbs))))
    out = {}
    for d, found in cells.items():
        m = np.zeros((d + 1, d + 1), dtype=object)
        for i, j, v in found:
            m[i, j] = m[j, i] = v
        n, s = int(m[d, d]), m[d, :d]
        out[d] = Moments(n, [int(a) + n * b for a, b in zip(s, shifts[d], strict=True)], n * m[:d, :d] - np.multiply.outer(s, s))
    return out


@dataclass
class Whitener:
    """Projection of the vectors of one length; ``scale`` is None where the data have no extent."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    scale: list[float | None]
    explained: list[float]

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exactly."""
        largest = self.n * float(np.abs(x.astype(np.float64)).max(initial=0)) + max(map(abs, self.sums), default=0)
        kind = np.int64 if largest < SAFE else object
        return x.astype(kind) * self.n - np.array(self.sums, dtype=kind)

    def project(self, centred: np.ndarray) -> list[np.ndarray | None]:
        places = (centred / self.n).astype(np.float64) @ self.vectors
        return [None if s is None else places[:, k] / s for k, s in enumerate(self.scale)]


def whitener(m: Moments, components: int = COMPONENTS) -> Whitener:
    """Eigenvectors of the covariance by falling eigenvalue, the largest entry of each positive."""
    d = len(m.sums)
    square = m.n * m.n
    covariance = np.array([[v / square for v in row] for row in m.scatter.tolist()], dtype=np.float64).reshape(d, d)  # int / int rounds once
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])] < 0, -1.0, 1.0) if d else vectors
    trace = float(np.trace(covariance))
    least = max(values[0], 0.0) * d * np.finfo(np.float64).eps if len(values) else 0.0
    real = [bool(e > least) for e in values]
    return Whitener(m.n, m.sums, vectors, [float(np.sqrt(e)) if ok else None for e, ok in zip(values, real, strict=True)], [float(e / trace) if ok else 0.0 for e, ok in zip(values, real, strict=True)])


def _squares(centred: np.ndarray) -> pa.Array:
    """Exact sums of squares of the rows, as decimal digits."""
    if centred.dtype != object and centred.shape[1] * float(np.abs(centred).max(initial=0)) ** 2 < SAFE:
        return pa.array((centred * centred).sum(axis=1)).cast(pa.string())
    return pa.array([str(sum(v * v for v in row)) for row in centred.tolist()], pa.string())


def _projected(models: dict[int, Whitener], components: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in _by_length(batch):
                model = models[x.shape[1]]
                places = model.project(model.centred(x))
                columns = [pa.nulls(len(x), pa.float64()) if k >= len(places) or places[k] is None else pa.array(places[k]) for k in range(components)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), x.shape[1]), pa.int32()), *columns], ["d", *(f"w{k}" for k in range(components))])

    return run


def identity_errors(fit: DataFrame, models: dict[int, Whitener], components: int = COMPONENTS) -> dict[int, float]:
    """Largest absolute entry of the whitened fit list's covariance minus the identity, by length of vector."""
    placed = fit.mapInArrow(_projected(models, components), "d int, " + ", ".join(f"w{k} double" for k in range(components)))
    pairs = [(a, b) for a in range(components) for b in range(a, components)]
    entries = F.array(*(F.abs(F.covar_pop(f"w{a}", f"w{b}") - float(a == b)) for a, b in pairs))  # centred before multiplying; null without extent
    return {r["d"]: r["error"] for r in placed.groupBy("d").agg(F.array_max(F.filter(entries, lambda e: e.isNotNull())).alias("error")).collect()}


_FIELDS = ["vec_id", "d", "component", "n", "deviation", "whitened", "explained", "identity_error"]
_SCHEMA = "vec_id long, d int, component int, n long, deviation string, whitened double, explained double, identity_error double"


def _whitened(models: dict[int, Whitener], errors: dict[int, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in _by_length(batch):
                model, m, d = models[x.shape[1]], len(x), x.shape[1]
                centred = model.centred(x)
                ids, squares = batch.column(0).take(pa.array(at)), _squares(centred)
                for k, place in enumerate(model.project(centred)):
                    fixed = [pa.array(np.full(m, d), pa.int32()), pa.array(np.full(m, k + 1), pa.int32()), pa.array(np.full(m, model.n), pa.int64()), squares]
                    w = pa.nulls(m, pa.float64()) if place is None else pa.array(place)
                    yield pa.RecordBatch.from_arrays([ids, *fixed, w, pa.array(np.full(m, model.explained[k])), pa.array([errors.get(d)] * m, pa.float64())], _FIELDS)

    return run


def whiten(embeddings: DataFrame, components: int = COMPONENTS, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, d, component, n, deviation, whitened, explained, identity_error for each row and component.

    Rows whose vector is null or holds null or non-finite entries are left out.
    Vectors of other lengths d have a space of their own, with its own fit
    list; d below ``components`` gives d components, an empty vector none.
    ``deviation`` is the exact sum of (n x - S)**2 in decimal digits.  Where a
    component has no extent (fewer distinct vectors than dimensions, equal
    rows) ``whitened`` is null and ``explained`` 0; such components do not
    count for ``identity_error``, which is null if none is left.  Repeated rows
    are rows of their own but one vector of the fit list; a null id stays null.
    An empty table gives no rows.
    """
    rows = usable(embeddings, key, vector)
    fit = materialise(rows.select("x").distinct(), "fit")
    models = {d: whitener(m, components) for d, m in moments(fit).items()}
    return rows.mapInArrow(_whitened(models, identity_errors(fit, models, components)), _SCHEMA)


def scatter(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(d, i, j, n, scatter) of the fit list: the upper half of n XtX - S St in decimal digits, i and j from 0."""
    fit = materialise(usable(embeddings, key, vector).select("x").distinct(), "fit")
    cells = [(d, i, j, m.n, str(m.scatter[i, j])) for d, m in moments(fit).items() for i in range(d) for j in range(i, d)]
    return embeddings.sparkSession.createDataFrame(cells, "d int, i int, j int, n long, scatter string")
