"""Whitening of embeddings by eigenvectors refined from single to double precision.

Entries become integers first. The fit list holds every distinct integer vector once; counts and sums over it are exact.
Its covariance is added up in tasks, centred before multiplying, one partial matrix per task. The eigenvectors of that
matrix are found in float32 and then corrected by the iteration of Ogita and Aishima, which needs matrix products only:
with R = I - X'X and S = X'AX, the correction of X is E with E_ij = (S_ij + l_j R_ij) / (l_j - l_i) where the eigenvalues
are apart, and R_ij / 2 where they are not. Eigenvalues that are too close for the current precision form a cluster, whose
vectors are turned among themselves by a small problem of their own in float64.

What is gathered is one matrix of dimension times dimension; vectors never leave the tasks. Vectors of several lengths
are fitted length by length. Rows whose vector is null or holds a null or a number that is not finite are dropped, all
other rows stay, repeated ones and those with null ids too. Empty vectors have no components. Components without variance
(a constant or dependent dimension, a single distinct vector) cannot be whitened and have no rows. Entries beyond 2^40 in
size count as that; ``deviation`` is null where it exceeds a long. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.llm import common
from freshet.session import store

#: Entries are cut to steps of 1 / SCALE and moved by SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Largest size of a scaled entry.
MOST = float(1 << 40)
#: Rounds of refinement at most; convergence is quadratic, so few are used.
ROUNDS = 30
LONG = (1 << 63) - 1


def integers(df: DataFrame, vector_col: str, id_col: str) -> DataFrame:
    """``vec_id, x, dim`` of the usable rows."""
    v = F.col(f"`{vector_col}`")
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    usable = df.where(v.isNotNull() & F.coalesce(F.forall(v.cast("array<double>"), finite), F.lit(False)))
    whole = lambda c: F.floor(F.greatest(F.least(c * SCALE, F.lit(MOST)), F.lit(-MOST))).cast("long") + F.lit(SHIFT).cast("long")
    return usable.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.transform(v.cast("array<double>"), whole).alias("x")).withColumn("dim", F.size("x"))


def _matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    """The vectors of a batch as rows."""
    return batch.column("x").flatten().to_numpy().reshape(batch.num_rows, dim)


def _slices(batch: pa.RecordBatch, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    for begin in range(0, batch.num_rows, rows):
        yield batch.slice(begin, rows)


def sums(fit: DataFrame, dim: int) -> tuple[int, np.ndarray]:
    """Rows of the fit list, and the exact sum of every dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dim, dtype=np.int64)
        for batch in batches:
            n += batch.num_rows
            total += _matrix(batch, dim).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([n] * (dim + 1)), pa.array(np.arange(dim + 1)), pa.array(np.append(total, n))], names=["n", "j", "part"])

    parts = fit.select("x").mapInArrow(run, "n bigint, j bigint, part bigint").groupBy("j").agg(F.sum("part").alias("total"))
    found = {r["j"]: r["total"] for r in parts.collect()}
    return found.get(dim, 0), np.array([found.get(j, 0) for j in range(dim)], dtype=np.int64)


def _centred(x: np.ndarray, n: int, total: np.ndarray) -> np.ndarray:
    """x - S / n, from exact integers where they fit 64 bits."""
    if n * (int(np.abs(x).max(initial=0)) + 1) < LONG // 2:
        return (n * x - total).astype(np.float64) / n
    quotient, rest = np.divmod(total, n)
    return (x - quotient).astype(np.float64) - rest / n


def products(fit: DataFrame, dim: int, rows_of, width: int) -> np.ndarray:
    """Sum over the fit list of the outer products of ``rows_of`` a block of vectors, which gives rows of ``width``.

    Tasks add up their own; a matrix row is then added over tasks, as many numbers as there are tasks and columns.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            for part in _slices(batch):
                y = rows_of(_matrix(part, dim))
                total += y.T @ y
        for i in range(width):
            yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([total[i]], type=pa.list_(pa.float64()))], names=["i", "part"])

    def add(rows: pa.Table) -> pa.Table:
        total = rows["part"].combine_chunks().flatten().to_numpy().reshape(rows.num_rows, width).sum(axis=0)
        return pa.table({"i": pa.array([rows["i"][0].as_py()]), "total": pa.array([total], type=pa.list_(pa.float64()))})

    parts = fit.select("x").mapInArrow(run, "i bigint, part array<double>")
    out = np.zeros((width, width))
    for r in parts.groupBy("i").applyInArrow(add, "i bigint, total array<double>").collect():
        out[r["i"]] = r["total"]
    return (out + out.T) / 2


def clusters(values: np.ndarray, gap: float) -> list[np.ndarray]:
    """Groups of two or more places whose values follow each other within ``gap``."""
    order = np.argsort(values)
    cuts = np.flatnonzero(np.diff(values[order]) > gap) + 1
    return [g for g in np.split(order, cuts) if len(g) > 1]


def refine(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and eigenvectors of the symmetric ``a`` to double precision from approximate vectors ``x``."""
    norm = np.linalg.norm(a, 2) if a.size else 0.0
    eye, before = np.eye(len(a)), np.inf
    for _ in range(ROUNDS):
        r = eye - x.T @ x
        s = x.T @ (a @ x)
        s = (s + s.T) / 2  # so that E_ij + E_ji is R_ij however close two values are
        values = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(values)
        gap = max(2 * (np.linalg.norm(off, 2) + norm * np.linalg.norm(r, 2)), 8 * len(a) * np.finfo(float).eps * norm)
        apart = values[None, :] - values[:, None]
        near = np.abs(apart) <= gap
        e = np.where(near, r / 2, (s + values[None, :] * r) / np.where(near, 1.0, apart))
        x = x + x @ e
        close = clusters(values, gap)
        for group in close:  # vectors of a cluster span the right space, but may be turned in it
            own, _ = np.linalg.qr(x[:, group])
            middle = values[group].mean()
            small = own.T @ (a @ own - middle * own)
            _, turn = np.linalg.eigh((small + small.T) / 2)
            x[:, group] = own @ turn
        change = np.abs(e).max(initial=0.0)
        if change < 4 * np.finfo(float).eps or (change >= before / 2 and change < 1e-12):
            break
        before = change
    x = x + x @ (eye - x.T @ x) / 2
    values = np.einsum("ij,ij->j", x, a @ x)
    order = np.argsort(-values, kind="stable")
    return values[order], x[:, order]


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All eigenvalues, falling, and unit eigenvectors: float32 first, then refined."""
    scale = np.abs(a).max(initial=0.0)
    if not scale:
        return np.zeros(len(a)), np.eye(len(a))
    _, rough = np.linalg.eigh((a / scale).astype(np.float32))
    values, x = refine(a / scale, rough.astype(np.float64))
    return values * scale, x


def deviations(x: np.ndarray, n: int, total: np.ndarray) -> list[int | None]:
    """Exact sum over dimensions of (n x - S)^2 of every row; None where it exceeds a long."""
    quotient, rest = np.divmod(total, n)
    near = x - quotient  # n x - S = n (x - quotient) - rest, and rest < n
    top = (float(np.abs(near).max(initial=0)) + 1) * n
    if top * top * x.shape[1] < LONG:
        d = n * near - rest
        return (d * d).sum(axis=1).tolist()
    d = n * near.astype(object) - rest.astype(object)
    return [v if v <= LONG else None for v in (d * d).sum(axis=1).tolist()]


SCHEMA = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def whiten(df: DataFrame, components: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for every usable row and component.

    Components are numbered from 1 by falling eigenvalue, at most ``components`` of them. ``identity_error`` is the
    largest entry of the whitened fit list's covariance minus the identity.
    """
    common.small_batches(df.sparkSession)
    rows = integers(df, vector_col, id_col)
    fit_all = store(rows.select("dim", "x").where("dim > 0").distinct(), "fit-list")
    out = None
    for dim in sorted(r["dim"] for r in fit_all.select("dim").distinct().collect()):
        part = _whiten_dim(rows.where(F.col("dim") == dim), fit_all.where(F.col("dim") == dim), dim, components)
        out = part if out is None else out.union(part)
    return df.sparkSession.createDataFrame([], SCHEMA) if out is None else out


def _whiten_dim(rows: DataFrame, fit: DataFrame, dim: int, components: int) -> DataFrame:
    n, total = sums(fit, dim)
    values, vectors = eigen(products(fit, dim, lambda x: _centred(x, n, total), dim) / n)
    # below this, an eigenvalue is rounding
    k = int((values[:components] > dim * np.finfo(float).eps * max(values[0], 0.0)).sum())
    trace = float(values.sum())
    weights = vectors[:, :k] / np.sqrt(values[:k])
    explained = values[:k] / trace if k else values[:0]
    # the fit list's own mean of x - S / n is zero, so the products are centred
    covariance = products(fit, dim, lambda x: _centred(x, n, total) @ weights, k) / n if k else np.zeros((0, 0))
    error = float(np.abs(covariance - np.eye(k)).max(initial=0.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                x, m = _matrix(part, dim), part.num_rows
                made = _centred(x, n, total) @ weights
                each = lambda v: pa.array(np.repeat(v, k))
                where = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("vec_id").take(where), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), each(np.full(m, n)),
                        pa.array(deviations(x, n, total), type=pa.int64()).take(where), pa.array(made.ravel()), pa.array(np.tile(explained, m)),
                        each(np.full(m, error)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.select("vec_id", "x").mapInArrow(run, SCHEMA)
