"""Mergeable co-moments: count, means and centred co-moments of several columns per series.

A state is ``n``, the mean of every column and the upper triangle of the sums of products of the deviations from
those means. Two states merge without cancellation: the triangle of the union is the sum of both plus one product
of the means' difference. So tasks fold their rows into one state per series, and only states are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet import fixed

#: Rows of a series that are folded by one task; a longer series is cut into parts by its dates' hash.
PART_ROWS = 1_000_000
#: Rows folded at once, which bounds a task's matrix.
FOLD_ROWS = 8192


class State:
    """Co-moments of the rows seen so far."""

    __slots__ = ("n", "mean", "square")

    def __init__(self, n: float, mean: np.ndarray, square: np.ndarray):
        self.n, self.mean, self.square = n, mean, square

    @classmethod
    def of(cls, x: np.ndarray) -> State:
        mean = x.mean(axis=0)
        return cls(float(len(x)), mean, (x - mean).T @ (x - mean))

    @classmethod
    def read(cls, n: float, mean: np.ndarray, triangle: np.ndarray) -> State:
        width = len(mean)
        square = np.zeros((width, width))
        square[np.triu_indices(width)] = triangle
        return cls(float(n), np.asarray(mean, dtype=float), square + np.triu(square, 1).T)

    def merge(self, other: State) -> State:
        n, apart = self.n + other.n, other.mean - self.mean
        square = self.square + other.square + np.outer(apart, apart) * (self.n * other.n / n)
        return State(n, self.mean + apart * (other.n / n), square)

    def triangle(self) -> np.ndarray:
        return self.square[np.triu_indices(len(self.mean))]


def merge_all(states: Sequence[State]) -> State:
    """Merge pairwise, so that rounding grows with the logarithm of their number."""
    states = list(states)
    while len(states) > 1:
        joined = [a.merge(b) for a, b in zip(states[::2], states[1::2])]
        states = joined + states[len(joined) * 2 :]
    return states[0]


def clustered(rows: DataFrame, length: str, key: str = fixed.KEY, time: str = fixed.TIME) -> DataFrame:
    """Rows of a series side by side, those of a series longer than ``PART_ROWS`` in several parts.

    ``length`` is the column that holds the number of rows of the series.
    """
    parts = F.ceil(F.col(length) / PART_ROWS)
    salt = F.pmod(F.xxhash64(time), F.greatest(parts, F.lit(1)).cast("bigint"))
    return rows.withColumn("_part", salt).repartition(key, "_part").sortWithinPartitions(key, "_part").drop("_part")


def states(rows: DataFrame, columns: Sequence[str], key: str = fixed.KEY) -> DataFrame:
    """``key, n, mean, triangle``: one state per run of rows of a series within a task.

    Rows should be clustered; others give the same sums in more states. A missing value counts as 0. At most
    ``FOLD_ROWS`` rows and one state are held.
    """
    columns = list(columns)
    names = [key, "n", "mean", "triangle"]
    reals = pa.list_(pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held = None, []  # partial states of the run that is open

        def out() -> pa.RecordBatch:
            one = merge_all(held)
            values = [pa.array([name], type=pa.string()), pa.array([one.n]), pa.array([one.mean], type=reals), pa.array([one.triangle()], type=reals)]
            return pa.RecordBatch.from_arrays(values, names=names)

        for batch in batches:
            for start in range(0, batch.num_rows, FOLD_ROWS):
                part = batch.slice(start, FOLD_ROWS)
                x = np.column_stack([np.nan_to_num(pc.fill_null(part.column(c), 0.0).to_numpy(zero_copy_only=False)) for c in columns])
                keys = part.column(key)
                cuts = [0, *(np.flatnonzero(pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)) + 1).tolist(), len(x)]
                for a, b in zip(cuts[:-1], cuts[1:]):
                    if held and keys[a].as_py() != name:
                        yield out()
                        held = []
                    name = keys[a].as_py()
                    held.append(State.of(x[a:b]))
                    if len(held) == 64:
                        held = [merge_all(held)]
        if held:
            yield out()

    doubles = [F.col(c).cast("double").alias(c) for c in columns]
    kept = rows.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias(key), *doubles)
    return kept.mapInArrow(run, f"{key} string, n double, mean array<double>, triangle array<double>")


def per_series(parts: DataFrame, finish: Callable[[str, State], tuple], schema: str, key: str = fixed.KEY) -> DataFrame:
    """Merge the states of every series and apply ``finish`` to its one state; ``schema`` names what that returns."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        held = [State.read(n, mean, triangle) for n, mean, triangle in zip(rows["n"], rows["mean"], rows["triangle"])]
        # a fixed order, so that a repeated task gives the same bits
        held.sort(key=lambda s: (s.n, *s.mean))
        return pd.DataFrame([finish(rows[key].iat[0], merge_all(held))], columns=names)

    return parts.groupBy(key).applyInPandas(run, schema)


def comoments(rows: DataFrame, columns: Sequence[str], key: str = fixed.KEY, time: str = fixed.TIME) -> DataFrame:
    """``key, n, mean, triangle`` of every series: the whole aggregate, clustering included."""
    lengths = rows.groupBy(key).agg(F.count("*").alias("_length"))
    near = clustered(rows.join(lengths, key), "_length", key, time)
    schema = f"{key} string, n double, mean array<double>, triangle array<double>"
    return per_series(states(near, columns, key), lambda name, s: (name, s.n, s.mean.tolist(), s.triangle().tolist()), schema, key)
