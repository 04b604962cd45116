"""Co-moments: merging, clustering and long series."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from freshet.operators import moments


def plain(x):
    return len(x), x.mean(axis=0), ((x - x.mean(axis=0)).T @ (x - x.mean(axis=0)))[np.triu_indices(x.shape[1])]


@pytest.fixture(scope="module")
def rows(spark):
    """Interleaved series of different lengths, with missing values and a large offset."""
    rng = np.random.default_rng(2)
    data = [(f"s{i % 7 if i % 3 else 0}", i, float(1e6 + rng.normal()), float(rng.normal()) if i % 5 else None, int(i % 4)) for i in range(4000)]
    return spark.createDataFrame(data + [(None, 1, 1.0, 1.0, 1)], "basin_id string, date long, a double, b double, c int").repartition(9)


def expected(rows):
    frame = rows.where("basin_id is not null").toPandas().fillna({"b": 0.0})
    return {name: plain(part[["a", "b", "c"]].to_numpy(dtype=float)) for name, part in frame.groupby("basin_id")}


def close(got, want):
    assert set(got) == set(want)
    for name, (n, mean, triangle) in want.items():
        assert got[name][0] == n
        assert np.allclose(got[name][1], mean, rtol=1e-12)
        # no cancellation: deviations of 1 around a million keep ten digits
        assert np.allclose(got[name][2], triangle, rtol=1e-9, atol=1e-6)


@pytest.mark.parametrize("part_rows", [1_000_000, 300])
def test_comoments(rows, monkeypatch, part_rows):
    monkeypatch.setattr(moments, "PART_ROWS", part_rows)
    got = {r["basin_id"]: (r["n"], r["mean"], r["triangle"]) for r in moments.comoments(rows, ["a", "b", "c"]).collect()}
    close(got, expected(rows))


def test_interleaved_rows_give_the_same_sums_in_more_states(rows):
    parts = moments.states(rows, ["a", "b", "c"])
    merged = moments.per_series(parts, lambda name, s: (name, s.n, s.mean.tolist(), s.triangle().tolist()), "basin_id string, n double, mean array<double>, triangle array<double>")
    close({r["basin_id"]: (r["n"], r["mean"], r["triangle"]) for r in merged.collect()}, expected(rows))


def test_clustered_rows_give_one_state_per_series_and_part(rows, monkeypatch):
    lengths = rows.groupBy("basin_id").agg(F.count("*").alias("n"))
    given = rows.where("basin_id is not null").join(lengths, "basin_id")
    assert moments.states(moments.clustered(given, "n"), ["a"]).count() == 7
    monkeypatch.setattr(moments, "PART_ROWS", 300)
    sizes = [r["n"] for r in lengths.where("basin_id is not null").collect()]
    held = moments.states(moments.clustered(given, "n"), ["a"]).collect()
    assert len(held) <= sum(-(-n // 300) for n in sizes) and sum(r["n"] for r in held) == 4000


def test_long_runs_are_folded_in_slices(rows, spark):
    long = spark.range(100_000).select(F.lit("x").alias("basin_id"), F.col("id").alias("date"), (F.col("id") % 97).cast("double").alias("a")).coalesce(1)
    (state,) = moments.states(long, ["a"]).collect()
    assert state["n"] == 100_000 and state["triangle"][0] == pytest.approx(np.var(np.arange(100_000) % 97) * 100_000)


def test_empty_input(rows):
    assert moments.comoments(rows.where("false"), ["a"]).collect() == []
