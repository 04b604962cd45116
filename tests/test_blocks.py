"""Windows over long series: cut into blocks or not, the values are the same."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from freshet import fixed
from freshet.operators import blocks
from freshet.operators.encode import train_medians
from freshet.operators.features import build_features
from freshet.operators.metrics import persistence
from freshet.operators.split import balanced_sample, cap_per_series, cap_total, size_summary


def panel(sizes: dict[str, int], seed: int = 0, gaps: float = 0.2) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    parts = []
    for name, n in sizes.items():
        days = pd.date_range("2000-01-01", periods=n, freq="D")
        part = pd.DataFrame({"basin_id": name, "date": days.date})
        for c in ("discharge_mm", "prcp_mm_cr2met", "tmin_c", "tmax_c", "pet_mm_hargreaves"):
            values = rng.integers(-5, 40, n).astype(float)
            values[rng.random(n) < gaps] = np.nan
            part[c] = values
        part["discharge_mm"] = part["discharge_mm"].fillna(1.0).abs()
        # Calendar gaps: lags count rows, not days.
        parts.append(part[rng.random(n) > 0.1])
    return pd.concat(parts, ignore_index=True)


def to_spark(spark, frame: pd.DataFrame):
    df = spark.createDataFrame(frame)
    return df.withColumns({c: F.nanvl(c, F.lit(None)) for c, t in df.dtypes if t == "double"})


def expected_features(frame: pd.DataFrame) -> pd.DataFrame:
    """The same features in pandas, series by series."""
    out = []
    for _, g in frame.sort_values("date").groupby("basin_id"):
        g = g.reset_index(drop=True)
        g["tmean_c"] = (g.tmin_c + g.tmax_c) / 2
        for c in ("prcp_mm_cr2met", "pet_mm_hargreaves"):
            g.loc[g[c] < 0, c] = np.nan
        g["deficit"] = g.pet_mm_hargreaves - g.prcp_mm_cr2met
        g["dd_above0"] = g.tmean_c.clip(lower=0)
        g["dd_above5"] = (g.tmean_c - 5).clip(lower=0)
        for v, ks in fixed.LAGS.items():
            for k in ks if v in g else []:
                g[f"{v}_lag{k}"] = g[v].shift(k)
        rolls = [("prcp_mm_cr2met", fixed.PRECIP_SUMS), ("deficit", [3, 7, 14]), ("dd_above0", [3, 7]), ("dd_above5", [3, 7])]
        for v, ns in rolls:
            for n in ns:
                g[f"{v}_sum_{n}d"] = g[v].shift(1).rolling(n, min_periods=1).sum()
        for n in fixed.PRECIP_MEANS:
            g[f"prcp_mm_cr2met_mean_{n}d"] = g.prcp_mm_cr2met.shift(1).rolling(n, min_periods=1).mean()
        g["y"] = g.discharge_mm
        g["y_log1p"] = np.log1p(g.y.clip(lower=0))
        out.append(g)
    return pd.concat(out, ignore_index=True)


def assert_same(df, want: pd.DataFrame) -> None:
    got = df.toPandas().sort_values(["basin_id", "date"], ignore_index=True)
    want = want.sort_values(["basin_id", "date"], ignore_index=True)[list(got.columns)]
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("block_rows", [10**6, 100, 7, 1])
def test_features_equal_pandas(spark, block_rows):
    """Also with blocks shorter than the 30 rows a lag reaches back."""
    frame = panel({"a": 400, "b": 90, "c": 1, "12": 31})
    got = build_features(to_spark(spark, frame), block_rows=block_rows)
    assert_same(got, expected_features(frame))


def test_blocks_over_hours_with_bursts(spark):
    """Timestamps crowded into few hours, with equal times: blocks follow the slots."""
    rng = np.random.default_rng(3)
    hours = np.sort(rng.choice([0, 1, 2, 50, 51, 400], 900, p=[0.5, 0.2, 0.1, 0.1, 0.05, 0.05]))
    frame = pd.DataFrame(
        {
            "k": "hot",
            "t": pd.Timestamp("2020-01-01") + pd.to_timedelta(hours, "h") + pd.to_timedelta(rng.integers(0, 3, 900), "s"),
            "i": np.arange(900),
            "v": rng.integers(0, 9, 900).astype(float),
        }
    )
    df = spark.createDataFrame(frame)

    def build(rows, w):
        return rows.withColumns({"l": F.lag("v", 40).over(w), "s": F.sum("v").over(w.rowsBetween(-40, -1))})

    long = df.select("k").distinct()
    assert [blocks._slot_counts(df, long, "k", "t", n)[1] for n in (1000, 400, 1)] == ["hour", "second", None]
    plan = dict(halo=40, key="k", time="t", order=("i",))
    whole = blocks.over_series(df, build, **plan)
    cut = blocks.over_series(df, build, **plan, block_rows=25)
    assert sorted(map(tuple, cut.collect()), key=lambda r: r[2]) == sorted(map(tuple, whole.collect()), key=lambda r: r[2])


def test_a_hot_series_spreads(spark):
    frame = panel({"hot": 3000, "b": 10}, gaps=0)
    df = to_spark(spark, frame)
    long = df.filter("basin_id = 'hot'").select("basin_id").distinct()
    counts, unit = blocks._slot_counts(df, long, "basin_id", "date", 100)
    assert unit is None
    slots = blocks._slot_blocks(counts, "basin_id", 30, 100)
    placed = df.join(slots.withColumnRenamed("_slot", "date"), ["basin_id", "date"])
    rows = placed.select(F.explode("blocks").alias("b")).groupBy("b").count().collect()
    assert len(rows) >= 25 and max(r["count"] for r in rows) <= 130


def test_rolls_do_not_look_ahead(spark):
    frame = panel({"a": 60}, gaps=0)
    changed = frame.copy()
    changed.loc[40:, ["prcp_mm_cr2met", "pet_mm_hargreaves"]] = 1000.0
    day = frame["date"].iloc[40]
    columns = [f"prcp_mm_cr2met_sum_{n}d" for n in fixed.PRECIP_SUMS] + ["deficit_sum_14d"]
    rows = [
        build_features(to_spark(spark, f)).filter(F.col("date") == day).select(*columns).first()
        for f in (frame, changed)
    ]
    assert rows[0] == rows[1]


@pytest.mark.parametrize("block_rows", [10**6, 5])
def test_persistence_scopes(spark, block_rows):
    d = [dt.date(2009, 1, 1) + dt.timedelta(i) for i in range(-3, 5)]
    y = [1.0, 2.0, 3.0, 4.0, None, 6.0, 7.0, 8.0]
    df = spark.createDataFrame([("a", a, b) for a, b in zip(d, y)], "basin_id string, date date, y double")
    series = persistence(df, "y", block_rows=block_rows).orderBy("date").collect()
    assert [r["yhat"] for r in series] == [3.0, 4.0, None, 6.0, 7.0]
    test = persistence(df, "y", scope="test", block_rows=block_rows).orderBy("date").collect()
    assert [(r["y"], r["yhat"]) for r in test] == [(4.0, None), (6.0, 4.0), (7.0, 6.0), (8.0, 7.0)]


@pytest.mark.parametrize("exact_rows", [10**6, 50, 200])
def test_medians_equal_pandas(spark, exact_rows):
    rng = np.random.default_rng(5)
    n = 1501
    frame = pd.DataFrame({"basin_id": np.where(np.arange(n) % 3 == 0, "hot", "b"), "x": rng.normal(size=n)})
    frame["ties"] = rng.integers(0, 3, n).astype(float)
    frame["zeros"] = np.where(rng.random(n) < 0.7, 0.0, rng.random(n))
    frame["rare"] = np.where(rng.random(n) < 0.02, rng.random(n), np.nan)
    frame["none"] = np.nan
    names = ["x", "ties", "zeros", "rare", "none"]
    got = train_medians(to_spark(spark, frame), names, exact_rows=exact_rows)
    got = got.select("basin_id", *names).toPandas().astype({c: float for c in names})
    want = frame.groupby("basin_id")[names].median().reset_index()
    pd.testing.assert_frame_equal(got.sort_values("basin_id", ignore_index=True), want)


def test_caps(spark):
    frame = panel({"a": 500, "b": 20, "c": 0}, gaps=0)
    df = to_spark(spark, frame).withColumn("side", F.when(F.col("date") < "2000-06-01", "train").otherwise("test"))
    sizes = {(r[0], r[1]): r[2] for r in df.groupBy("basin_id", "side").count().collect()}
    kept = cap_per_series(df, {"train": 40, "test": 15})
    got = {(r[0], r[1]): r[2] for r in kept.groupBy("basin_id", "side").count().collect()}
    limit = {"train": 40, "test": 15}
    assert got == {k: min(n, limit[k[1]]) for k, n in sizes.items()}
    again = cap_per_series(df.repartition(5), {"train": 40, "test": 15})
    assert set(map(tuple, again.collect())) == set(map(tuple, kept.collect()))
    assert balanced_sample(df, 30, 45).count() == 45


def test_total_cap_stops_when_both_are_reached(spark):
    rows = [("a", 5, 1), ("b", 5, 1), ("c", 5, 1), ("d", 5, 1), ("e", 0, 9)]
    df = spark.createDataFrame(rows, "basin_id string, n_train bigint, n_test bigint")
    taken = [r[0] for r in cap_total(df, 10, 3).orderBy("basin_id").collect()]
    assert taken == ["a", "b", "c"]


def test_total_cap_over_many_series(spark):
    df = spark.range(9000).select(
        F.format_string("%05d", "id").alias("basin_id"), F.lit(2).cast("bigint").alias("n_train"), F.lit(1).cast("bigint").alias("n_test")
    )
    assert cap_total(df, 5000, 1500).count() == 2500
    assert cap_total(df, 10, 8500).count() == 8500
    assert cap_total(df, 10**6, 10**6).count() == 9000
    assert cap_total(df, 6, 2).count() == 3


def test_size_summary(spark):
    frame = panel({"a": 100, "b": 40, "c": 7, "d": 60}, gaps=0)
    sizes = frame.groupby("basin_id").size()
    got = {r["point"]: r["rows"] for r in size_summary(to_spark(spark, frame)).collect()}
    assert got == {p: int(sizes.quantile(p)) for p in (0.1, 0.25, 0.5, 0.75, 0.9)}
