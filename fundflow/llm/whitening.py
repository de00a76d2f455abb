"""Whitening of embeddings, with components refined from float32.

Vectors are put on an integer grid, ``x = floor(scale * c) + shift``.  The fit
runs over every distinct grid vector once; Spark sums them exactly, then sums
the outer products of the centred vectors.  Only those sums, whose size is set
by the number of dimensions, reach the driver.

The eigenvectors of the covariance come from a float32 decomposition.  Each
Ogita-Aishima step then corrects them in double precision by matrix products
alone: residuals of orthogonality and of the diagonal form give the correction
of every pair of columns whose eigenvalues are apart.  Columns whose
eigenvalues are too close for that span a subspace that is already right; a
decomposition of the shifted problem inside the subspace settles them.

Rules:

* A vector that is null or holds null or non-finite entries takes no part, nor
  does one whose length is not the commonest (ties: the longer); lengths of
  zero never count.  Null ids and repeated rows are rows like others.
* Entries beyond 2^55 on the grid are held at that.  ``deviation`` is null
  where it exceeds 64 bits.
* Directions without variance (under 10^-10 of the first) have no component:
  they cannot be scaled to one.  An empty table, or one whose vectors are all
  alike, gives no rows.
* Only the id and the vector are read.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundflow.session import materialise

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCALE, SHIFT = 64, 1_000_000
HELD = float(1 << 55)
NO_VARIANCE = 1e-10
STEPS = 30


@dataclass(frozen=True)
class Model:
    """What a fit learned; ``components`` has one unit column for each."""
    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray
    identity_error: float


def on_grid(vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(key, x): vectors that take part, as integers."""
    clean = vectors.select(key, F.col(column).cast("array<double>").alias("x")).filter(
        (F.size("x") > 0) & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c)
                                      & (F.abs(c) < float("inf"))))
    held = clean.select(key, F.transform("x", lambda c: F.floor(F.greatest(F.lit(-HELD), F.least(
        F.lit(HELD), c * SCALE))) + SHIFT).alias("x"))
    sizes = held.groupBy(F.size("x").alias("d")).count()
    commonest = sizes.orderBy(F.desc("count"), F.desc("d")).first()
    return held.filter(F.size("x") == (commonest["d"] if commonest else 0))


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    flat = batch.column("x").flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(batch.num_rows, -1)


def _sums(fit: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors and exact sum of every dimension."""
    schema = pa.schema([("i", pa.int32()), ("n", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64())])

    def run(batches):
        n, hi, lo = 0, 0, 0
        for batch in batches:
            if batch.num_rows:
                x = _rows(batch)
                n, hi, lo = n + len(x), hi + (x >> 32).sum(0), lo + (x & 0xFFFFFFFF).sum(0)
        if n:
            d = len(hi)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)),
                                              pa.array(np.full(d, n)), pa.array(hi), pa.array(lo)],
                                             schema=schema)
    wide = "decimal(38,0)"
    rows = fit.mapInArrow(run, "i int, n long, hi long, lo long").groupBy("i").agg(
        F.sum("n").alias("n"), F.sum(F.col("hi").cast(wide)).alias("hi"),
        F.sum(F.col("lo").cast(wide)).alias("lo")).orderBy("i").collect()
    return (rows[0]["n"] if rows else 0), [(int(r["hi"]) << 32) + int(r["lo"]) for r in rows]


def _centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """x - S/n; the whole part is taken off in integers."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s % n) / n for s in sums])
    return (x - whole) - rest


def _gram(fit: DataFrame, values) -> tuple[np.ndarray, np.ndarray]:
    """Sum and sum of outer products of ``values(x)`` over all rows."""
    schema = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("v", pa.float64())])

    def run(batches):
        total = outer = None
        for batch in batches:
            if batch.num_rows:
                z = values(_rows(batch))
                total = z.sum(0) + (0 if total is None else total)
                outer = z.T @ z + (0 if outer is None else outer)
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.r_[i, np.full(len(total), -1)].astype(np.int32)),
                 pa.array(np.r_[j, np.arange(len(total))].astype(np.int32)),
                 pa.array(np.r_[outer[i, j], total])], schema=schema)
    rows = fit.mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(
        F.sum("v").alias("v")).toPandas()
    d = int(rows["j"].max()) + 1
    total, outer = np.zeros(d), np.zeros((d, d))
    of_sum = rows["i"] < 0
    total[rows["j"][of_sum]] = rows["v"][of_sum]
    pairs = rows[~of_sum]
    outer[pairs["i"], pairs["j"]] = outer[pairs["j"], pairs["i"]] = pairs["v"]
    return total, outer


def refine(a: np.ndarray, x: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and eigenvectors of symmetric ``a`` from approximate vectors ``x``."""
    norm, size = np.linalg.norm(a, 2), len(a)
    best, idle = np.inf, 0
    for _ in range(steps):
        r = np.eye(size) - x.T @ x
        s = x.T @ a @ x
        values = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(np.diag(s))
        # closer than this, a correction would no longer be small
        delta = 100 * (np.linalg.norm(off, 2) + norm * np.linalg.norm(r, 2))
        error = np.linalg.norm(off, 2) / norm + np.linalg.norm(r, 2)
        idle = 0 if error < best / 2 else idle + 1
        if error < best:
            best, kept = error, x
        if idle > 2:  # as exact as double precision gets
            break
        gap = values[None, :] - values[:, None]
        apart = np.abs(gap) > delta
        e = np.where(apart, (s + values[None, :] * r) / np.where(apart, gap, 1), r / 2)
        x = x + x @ e
        order = np.argsort(values)
        x, values = x[:, order], values[order]
        for j in np.split(np.arange(size), np.flatnonzero(np.diff(values) > delta) + 1):
            if len(j) > 1:  # a cluster: solve the shifted problem inside its span
                v = np.linalg.qr(x[:, j])[0]
                inner = v.T @ ((a - values[j].mean() * np.eye(size)) @ v)
                x[:, j] = v @ np.linalg.eigh((inner + inner.T) / 2)[1]
    q, upper = np.linalg.qr(kept)  # what is left of non-orthogonality is rounding
    x = q * np.sign(np.diag(upper))
    return np.einsum("ij,ij->j", x, a @ x), x


def components(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The first eigenvalues, falling, and unit eigenvectors of a covariance."""
    top = np.abs(v).max()
    if not top > 0:
        return np.zeros(0), np.zeros((len(v), 0))
    a = v / top
    values, x = refine(a, np.linalg.eigh(a.astype(np.float32))[1].astype(np.float64))
    order = np.argsort(-values, kind="stable")[:most]
    values, x = values[order], x[:, order]
    held = values > NO_VARIANCE * values[0]
    values, x = values[held], x[:, held]
    sign = np.sign(x[np.abs(x).argmax(0), np.arange(x.shape[1])])
    return values * top, x * sign


def fit(grid: DataFrame, most: int = 16) -> Model | None:
    """Learn from the distinct vectors of ``on_grid``; None if there are none."""
    distinct = materialise(grid.select("x").distinct(), "fit", rebalance=False)
    n, sums = _sums(distinct)
    if not n:
        return None
    sums = tuple(sums)
    total, outer = _gram(distinct, lambda x: _centred(x, n, sums))
    v = outer / n - np.outer(total / n, total / n)  # the second term is rounding
    values, x = components(v, most)
    model = Model(n, sums, x, values, values / np.trace(v) if len(values) else values, 0.0)
    if not len(values):
        return model
    total, outer = _gram(distinct, lambda x: _project(x, model))
    error = np.abs(outer / n - np.outer(total / n, total / n) - np.eye(len(values))).max()
    return Model(n, sums, x, values, model.explained, float(error))


def _project(x: np.ndarray, model: Model) -> np.ndarray:
    return _centred(x, model.n, model.sums) @ model.components / np.sqrt(model.eigenvalues)


def _deviations(x: np.ndarray, model: Model) -> list[int | None]:
    """Sum over dimensions of (n*x - S)^2, exact."""
    whole = np.array([s // model.n for s in model.sums], np.int64)
    rest = [s % model.n for s in model.sums]
    y = x - whole
    widest = int(np.abs(y).max()) + 1
    if (widest * model.n) ** 2 * x.shape[1] < 1 << 63:
        return ((y * model.n - np.array(rest, np.int64)) ** 2).sum(1).tolist()
    exact = ((y.astype(object) * model.n - np.array(rest, object)) ** 2).sum(1)
    return [int(d) if d < 1 << 63 else None for d in exact]


def transform(grid: DataFrame, model: Model | None, key: str = "vec_id") -> DataFrame:
    """(key, deviation, whitened) of every row."""
    kinds = {f.name: f for f in grid.schema}
    ddl = f"{key} {kinds[key].dataType.simpleString()}, deviation long, whitened array<double>"

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = _rows(batch)
                w = _project(x, model)
                offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * w.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(key), pa.array(_deviations(x, model), pa.int64()),
                     pa.ListArray.from_arrays(offsets, pa.array(w.ravel()))],
                    names=[key, "deviation", "whitened"])
    return grid.filter(F.lit(model is not None)).mapInArrow(run, ddl)


def by_component(grid: DataFrame, model: Model | None) -> DataFrame:
    """One row for each vector and component."""
    explained = [float(e) for e in model.explained] if model else []
    shares = F.array(*map(F.lit, explained)) if explained else F.array().cast("array<double>")
    rows = transform(grid, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select("vec_id", (F.col("at") + 1).cast("int").alias("component"),
                       F.lit(model.n if model else 0).cast("long").alias("n"), "deviation", "whitened",
                       F.get(shares, F.col("at")).alias("explained"),
                       F.lit(model.identity_error if model else 0.0).alias("identity_error"))
