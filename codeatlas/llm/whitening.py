"""Embedding whitening: blockwise QR of centred rows, and a bidiagonal qd solver for the directions."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from codeatlas.llm.bidiagonal import leading_directions
from codeatlas.session import cut

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCALE = 256
BLOCK_BYTES = 8 << 20
"""Bytes of rows that a task reduces at once."""
FAN_BYTES = 64 << 20
"""Bytes of triangles that are reduced together."""


@dataclass(frozen=True)
class Whitening:
    """A fit: rows, sums by dimension, eigenvalues (falling), directions as columns, the trace, and the error over the fit list."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    directions: np.ndarray
    trace: float
    identity_error: float | None = None


def whole_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(key, x) of the rows with a usable vector, x being floor(scale * entry) as long.

    Dropped are vectors that are null or empty, or hold a null, an infinite or a not-a-number entry.  Extra columns are ignored.
    """
    v = F.col(f"`{vector}`")
    usable = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    whole = F.transform(v, lambda c: F.floor(c.cast("double") * scale))
    return rows.filter(usable).select(F.col(f"`{key}`").alias(key), whole.alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of an Arrow array of equally long lists."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def _centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """n * x - S, in whole numbers (of any size where 64 bits don't hold them)."""
    most = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
    if n * most + max(map(abs, sums)) < 1 << 62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _columns_sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (x) to one row of (n, sums as decimal strings) per task."""
    n, sums = 0, None
    for batch in batches:
        x = _matrix(batch.column(0))
        if len(x):
            most = max(abs(int(x.max())), abs(int(x.min())))
            part = x.sum(0).astype(object) if most * len(x) < 1 << 62 else x.astype(object).sum(0)
            sums, n = part if sums is None else sums + part, n + len(x)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([[str(s) for s in sums]])], names=["n", "sums"])


def _triangle(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r")


def _triangles(n: int, sums: tuple[int, ...]):
    """From (x) to one row of (part, r) per task: the triangle of its centred rows, block after block."""

    def run(batches):
        from pyspark import TaskContext

        d, r = len(sums), np.zeros((0, len(sums)))
        step = max(2 * d, BLOCK_BYTES // (8 * d))
        for batch in batches:
            rows = (_centred(_matrix(batch.column(0)), n, sums) / n).astype(float)
            for at in range(0, len(rows), step):
                r = _triangle(np.vstack((r, rows[at : at + step])))
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.ravel().tolist()])], names=["part", "r"])

    return run


def _merged(d: int):
    """From the triangles of a group to theirs."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        rows = np.vstack([np.array(r).reshape(-1, d) for r in frame.sort_values("part").r])
        return pd.DataFrame({"part": [int(frame.part.min())], "r": [_triangle(rows).ravel().tolist()]})

    return run


def _whitened(x: np.ndarray, fit: Whitening) -> tuple[np.ndarray, np.ndarray]:
    """Rows by components, and n * x - S.  Each row is summed in one order, so that equal rows give equal values in any batch."""
    whole = _centred(x, fit.n, fit.sums)
    rows, out = (whole / fit.n).astype(float), np.zeros((len(x), len(fit.values)))
    for j, direction in enumerate(fit.directions):
        out += rows[:, j : j + 1] * direction
    return out / np.sqrt(fit.values), whole


def _products(fit: Whitening):
    """From (x) to one row per task: the sums of the whitened rows and of their products."""

    def run(batches):
        k = len(fit.values)
        total = np.zeros((k + 1, k))
        for batch in batches:
            w, _ = _whitened(_matrix(batch.column(0)), fit)
            total += np.vstack((w.sum(0), w.T @ w))
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()])], names=["total"])

    return run


def fit_whitening(vectors: DataFrame, components: int, vector: str = "x") -> Whitening | None:
    """The fit over the distinct vectors of whole numbers; None where there is no vector or they are all alike.

    Vectors of another length than the commonest one (the shorter of equally common ones) take no part.  Each task reduces its centred rows to
    one triangle, block by block; triangles are reduced in groups, as many rounds as it takes, until a few are left for the driver, which
    makes the last one bidiagonal and finds the largest singular values (dqds) and their vectors (twisted factorisations).  The distinct vectors are
    written once and read three times: sums, triangles, and the covariance of the whitened rows.
    """
    listed = cut(vectors.select(F.col(f"`{vector}`").alias("x")).filter("x IS NOT NULL AND size(x) > 0").distinct())
    common = listed.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if common is None:
        return None
    d = int(common.d)
    listed = listed.filter(F.size("x") == d)
    partial = listed.mapInArrow(_columns_sum, "n long, sums array<string>").select("n", F.posexplode("sums").alias("at", "s"))
    columns = partial.groupBy("at").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("at").collect()
    n, sums = columns[0].n, tuple(int(c.s) for c in columns)
    triangles = cut(listed.mapInArrow(_triangles(n, sums), "part long, r array<double>"))
    fan, left = max(2, FAN_BYTES // (8 * d * d)), triangles.count()
    while left > fan:
        groups = -(-left // fan)
        triangles = cut(triangles.groupBy((F.col("part") % groups).alias("g")).applyInPandas(_merged(d), "part long, r array<double>"))
        left = triangles.count()
    r = _triangle(np.vstack([np.array(t.r).reshape(-1, d) for t in triangles.orderBy("part").collect()]))
    values, directions = leading_directions(r, components)
    if not len(values):
        return None
    fit = Whitening(n, sums, values / n, directions, float((r * r).sum() / n))
    k = len(values)
    totals = listed.mapInArrow(_products(fit), "total array<double>").select(F.posexplode("total").alias("at", "s")).groupBy("at").agg(F.sum("s").alias("s"))
    total = np.array([t.s for t in totals.orderBy("at").collect()]).reshape(k + 1, k) / n
    error = float(np.abs(total[1:] - np.outer(total[0], total[0]) - np.eye(k)).max())
    return Whitening(n, sums, fit.values, directions, fit.trace, error)


def apply_whitening(vectors: DataFrame, fit: Whitening | None, key: str = "vec_id", vector: str = "x") -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): a row for each vector and component.

    `deviation` is the exact sum of (n*x - S)^2, null where a long doesn't hold it.  Vectors that are null or not as long as the fit's give no rows,
    nor does anything without a fit; rows with a null or repeated key are handled like others; other columns are ignored.
    """
    kind = vectors.schema[key].dataType.simpleString()
    schema = "key KIND, component int, n long, deviation long, whitened double, explained double, identity_error double".replace("KIND", kind)
    named = vectors.select(F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").alias("x"))
    if fit is None:
        return named.sparkSession.createDataFrame([], schema).withColumnRenamed("key", key)

    def run(batches):
        k, part = len(fit.values), fit.values / fit.trace
        for batch in batches:
            w, whole = _whitened(_matrix(batch.column(1)), fit)
            if whole.dtype != object and (whole.astype(float) ** 2).sum(1).max(initial=0) < float(1 << 62):
                deviation = pa.array((whole * whole).sum(1)).cast(pa.int64())
            else:
                exact = [sum(int(v) ** 2 for v in row) for row in whole]
                deviation = pa.array([x if x < 1 << 63 else None for x in exact], pa.int64())
            rows = np.repeat(np.arange(len(w)), k)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)), pa.array(np.tile(np.arange(1, k + 1), len(w)), pa.int32()), pa.array(np.full(len(rows), fit.n)), deviation.take(pa.array(rows)),
                 pa.array(w.ravel()), pa.array(np.tile(part, len(w))), pa.array(np.full(len(rows), fit.identity_error))],
                names=["key", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return named.filter(F.size("x") == len(fit.sums)).mapInArrow(run, schema).withColumnRenamed("key", key)
