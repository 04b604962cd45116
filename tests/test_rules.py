"""Scores, diagnosis and policy rules on hand-made tables that reach every branch."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from freshet.functions import stats
from freshet.operators.columns import common_features, core_features, exclude_columns, feature_order
from freshet.operators.diagnose import diagnose, missing_rates, missing_top, near_zero_flag
from freshet.operators.encode import apply_target_encoding, fit_target_encoding, impute_rules, train_medians
from freshet.operators.metrics import augment_persistence, regression_metrics, report_metrics, review_list
from freshet.operators.policy import (
    apply_overrides,
    compare_retrained,
    gating_policy,
    policy_entries,
    serving_policy,
)
from freshet.operators.split import basin_gate, pick_target, temporal_split


def scores(spark, y, p):
    df = spark.createDataFrame(list(zip(y, p)), "y double, p double")
    row = df.agg(stats.nse("y", "p"), stats.nse_log1p("y", "p"), stats.kge("y", "p"), stats.mae("y", "p"), stats.rmse("y", "p")).first()
    return list(row)


def test_scores_equal_numpy(spark):
    rng = np.random.default_rng(1)
    y, p = rng.gamma(2, 3, 200), rng.gamma(2, 3, 200)
    got = scores(spark, y.tolist(), p.tolist())
    ly, lp = np.log1p(y), np.log1p(p)
    nse = lambda a, b: 1 - ((a - b) ** 2).sum() / ((a - a.mean()) ** 2).sum()
    r = np.corrcoef(y, p)[0, 1]
    kge = 1 - np.sqrt((r - 1) ** 2 + (p.std() / y.std() - 1) ** 2 + (p.mean() / y.mean() - 1) ** 2)
    want = [nse(y, p), nse(ly, lp), kge, np.abs(y - p).mean(), np.sqrt(((y - p) ** 2).mean())]
    assert got == pytest.approx(want, rel=1e-9)


def test_scores_without_spread(spark):
    assert scores(spark, [2.0, 2.0, 2.0], [1.0, 2.0, 3.0])[:3] == [None, None, None]
    assert scores(spark, [1.0, 2.0, 3.0], [2.0, 2.0, 2.0])[2] is None
    assert scores(spark, [-1.0, 0.0, 1.0], [1.0, 2.0, 3.0])[2] is None
    assert scores(spark, [1.0, 2.0, 4.0], [1.0, 2.0, 4.0])[:3] == pytest.approx([1.0, 1.0, 1.0])
    assert scores(spark, [1.0, 2.0, None], [1.0, 2.0, 9.0])[0] == 1.0


def test_log_score_only_for_log_target(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 2.0, 2.5)], "basin_id string, y double, yhat double")
    assert regression_metrics(df, "y", "yhat", target="y").first()["logNSE"] is None
    row = regression_metrics(df, "y", "yhat", target="y_log1p").first()
    assert row["logNSE"] == row["R2"] is not None


def series_frame(spark, sizes: dict[str, tuple[int, int]], value=lambda i: float(i % 7)):
    rows = []
    for name, (train, test) in sizes.items():
        days = list(pd.date_range(end="2008-12-31", periods=train)) + list(pd.date_range("2009-01-01", periods=test))
        rows += [(name, d.date(), value(i)) for i, d in enumerate(days)]
    return spark.createDataFrame(rows, "basin_id string, date date, y_log1p double")


def test_split_and_gates(spark):
    df = series_frame(spark, {"small": (800, 99), "edge": (800, 100), "notest": (950, 0), "notrain": (0, 950), "few": (900, 50)})
    df = df.withColumns({c: F.lit(1.0) for c in ("p", "q", "r")})
    df = df.withColumn("q", F.when(F.col("basin_id") != "few", F.col("q")))
    assert {r[0] for r in temporal_split(df, "y_log1p").select("basin_id").distinct().collect()} == {"small", "edge", "few"}
    gates = {r["basin_id"]: r["gate"] for r in basin_gate(df, "y_log1p", ["p", "q", "r"]).collect()}
    assert gates == {"small": "small", "edge": "ok", "notest": "split", "notrain": "split", "few": "no_feats"}
    left_out = spark.createDataFrame([("edge", "p")], "basin_id string, column string")
    gates = {r["basin_id"]: r["gate"] for r in basin_gate(df, "y_log1p", ["p", "q", "r"], left_out).collect()}
    assert gates["edge"] == "no_feats"
    assert pick_target(["y", "discharge_mm"]) == "y"
    with pytest.raises(ValueError):
        pick_target(["x"])


def test_encoding(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 10.0), ("c", None)], "basin_id string, y double")
    got = {r["basin_id"]: r for r in fit_target_encoding(df, "y", 2.0).collect()}
    g = 14 / 3
    assert set(got) == {"a", "b"}
    assert got["a"]["enc"] == pytest.approx((4 + 2 * g) / 4) and got["b"]["enc"] == pytest.approx((10 + 2 * g) / 3)
    applied = apply_target_encoding(df, fit_target_encoding(df, "y", 2.0), 0.5).collect()
    assert {r["basin_id"]: r["basin_te"] for r in applied}["c"] == 0.5


def test_imputation_and_exclusion(spark):
    rows = [("a", 1.0, None, None), ("a", 3.0, 5.0, None), ("a", None, None, None)]
    df = spark.createDataFrame(rows, "basin_id string, tmin_c double, x_lag1 double, empty double")
    filled = impute_rules(df, ["tmin_c", "x_lag1", "empty"], train_medians(df, ["tmin_c", "empty"]))
    got = sorted((r["tmin_c"], r["x_lag1"], r["empty"]) for r in filled.select("tmin_c", "x_lag1", "empty").collect())
    assert got == [(1.0, 0.0, None), (2.0, 0.0, None), (3.0, 5.0, None)]
    left_out = spark.createDataFrame([("a", "x_lag1"), ("z", "tmin_c")], "basin_id string, column string")
    zeroed = exclude_columns(df, left_out, ["tmin_c", "x_lag1"]).collect()
    assert {r["x_lag1"] for r in zeroed} == {0.0} and sorted(r["tmin_c"] or 0 for r in zeroed) == [0, 1.0, 3.0]


@pytest.mark.parametrize("seed", range(4))
def test_common_features_over_all_series(spark, seed):
    rng = np.random.default_rng(seed)
    names = [f"f{i}" for i in range(8)]
    ids = [f"s{i:02d}" for i in range(14)]
    rate = [1.0, 1.0, 0.97, 0.95, 0.9, 0.9, 0.5, 0.0]
    has = rng.random((14, 8)) < rate
    has[5] = False
    rows = [(s, *[1.0 if h else None for h in row]) for s, row in zip(ids, has)]
    df = spark.createDataFrame(rows, "basin_id string, " + ", ".join(f"{n} double" for n in names))
    want = set.intersection(*[{n for n, h in zip(names, row) if h} for row in has if any(row)])
    assert {r[0] for r in common_features(df, names).collect()} == want


def test_core_features_and_order():
    names = ["tmin_c", "tmin_c_lag1", "prcp_mm_cr2met_lag4", "elev_mean", "deficit", "discharge_mm_lag1", "deficit"]
    assert core_features(names) == ["tmin_c_lag1", "elev_mean", "deficit"]
    assert feature_order(names, ["deficit", "elev_mean", "x"]) == ["deficit", "elev_mean", "basin_te"]
    with pytest.raises(ValueError):
        feature_order(names, ["x"])


def test_diagnosis(spark):
    df = series_frame(spark, {"a": (30, 20), "flat": (5, 12), "short": (5, 6), "notest": (9, 0)})
    df = df.withColumn("y_log1p", F.when(F.col("basin_id") == "flat", 2.0).otherwise(F.col("y_log1p")))
    df = df.withColumn("p", F.when(F.dayofmonth("date") > 5, 1.0)).withColumn("q", F.lit(1.0))
    got = {r["basin_id"]: r for r in diagnose(df).collect()}
    assert got["a"]["near_zero_var_test"] is False and got["a"]["persistence_NSE"] is not None
    assert got["flat"]["near_zero_var_test"] is True and got["flat"]["persistence_NSE"] is None
    assert got["short"]["persistence_NSE"] is None and got["short"]["n_test"] == 6
    assert got["notest"]["n_test"] == 0 and got["notest"]["near_zero_var_test"] is False
    assert got["notest"]["avg_nan_rate_test"] == 0.0
    assert got["a"]["avg_nan_rate_test"] == pytest.approx(5 / 20 / 2)
    test = [float((30 + i) % 7) for i in range(20)]
    nse = 1 - sum((a - b) ** 2 for a, b in zip(test[1:], test)) / (np.var(test[1:]) * 19)
    assert got["a"]["persistence_NSE"] == pytest.approx(nse)
    top = missing_top(missing_rates(df), 1).collect()
    assert {r["column"] for r in top} == {"p"}


def test_near_zero_thresholds(spark):
    rows = [(0.0009, 0.0), (0.5, 100.0), (0.5, 10.0), (None, None), (0.5, -100.0)]
    df = spark.createDataFrame(rows, "std_test double, mean_test double")
    assert [r[0] for r in df.select(near_zero_flag()).collect()] == [True, True, False, False, True]


METRICS = "basin_id string, rows bigint, test_R2 double, test_RMSE double, test_MAE double"
SUMMARY = (
    "basin_id string, n_test bigint, std_test double, range_test double, near_zero_var_test boolean, "
    "avg_nan_rate_test double, persistence_NSE double"
)


def policy_tables(spark):
    metrics = spark.createDataFrame(
        [("a", 9, -0.5, 1.0, 1.0), ("b", 9, -0.5, 1.0, 1.0), ("c", 9, 0.5, 1.0, 1.0), ("d", 9, None, 1.0, 1.0)], METRICS
    )
    summary = spark.createDataFrame(
        [("a", 5, 1.0, 1.0, False, 0.30, 0.2), ("b", 5, 1.0, 1.0, True, 0.29, None), ("c", 5, 1.0, 1.0, False, None, 0.9)],
        SUMMARY,
    )
    return metrics, summary


def test_gating_policy(spark):
    metrics, summary = policy_tables(spark)
    days = pd.date_range("2009-01-01", periods=10)
    rows = [
        (b, d.date(), *[None if i < n else 1.0 for n in (8, 7, 4, 3)]) for b in "ab" for i, d in enumerate(days)
    ]
    features = spark.createDataFrame(rows, "basin_id string, date date, x_lag1 double, tmin_c double, y_lag2 double, z double")
    columns = ["x_lag1", "tmin_c", "y_lag2", "z"]
    policy = gating_policy(metrics, summary, features, columns)
    assert [tuple(r) for r in policy.exclusions.collect()] == [("a", "x_lag1")]
    assert [tuple(r) for r in policy.advice.collect()] == [("a", "tmin_c", "median"), ("a", "y_lag2", "zero")]
    assert [tuple(r) for r in policy.modes.collect()] == [("b", "rmse")]
    assert [tuple(r) for r in policy.overrides.collect()] == [("a", "global")]
    assert policy_entries(policy).count() == 2
    applied = {r["basin_id"]: r for r in apply_overrides(metrics, policy.modes, policy.overrides).collect()}
    assert (applied["a"]["metric_mode"], applied["a"]["serve_model"]) == ("r2", "global")
    assert (applied["b"]["metric_mode"], applied["b"]["serve_model"]) == ("rmse", "local")


def test_report_and_review(spark):
    schema = "basin_id string, metric_mode string, test_RMSE double, test_R2 double"
    rows = [("a", "r2", 9.0, 0.5), ("b", "rmse", 0.1, 0.9), ("c", "r2", 1.0, -0.2), ("d", "rmse", 0.05, 0.1), ("e", "r2", 1.0, None)]
    got = report_metrics(spark.createDataFrame(rows, schema)).collect()
    assert [r["basin_id"] for r in got] == ["c", "a", "e", "d", "b"]
    listed = review_list(spark.createDataFrame(rows, schema), 1, 0.1).collect()
    assert sorted(r["basin_id"] for r in listed) == ["c", "d"]
    listed = review_list(spark.createDataFrame(rows, schema), 5, -9.0).collect()
    assert len(listed) == 5


def test_augmented_metrics(spark):
    panel = series_frame(spark, {"a": (3, 30), "b": (3, 0)}, value=lambda i: float(i))
    metrics = spark.createDataFrame([("a", -1.0), ("b", -1.0), ("gone", -1.0)], "basin_id string, test_R2 double")
    got = {r["basin_id"]: r for r in augment_persistence(metrics, panel, "y_log1p").collect()}
    assert got["a"]["suggested_serving"] == "global" and got["a"]["persistence_N"] == 30
    assert got["b"]["suggested_serving"] == "local" and got["b"]["persistence_N"] == 0
    assert got["gone"]["persistence_NSE"] is None and got["gone"]["persistence_N"] == 0


def test_serving_policy(spark):
    metrics = spark.createDataFrame(
        [("global1", 0.9, "Global"), ("lite", -0.1, "local"), ("nofile", 0.2, "local"), ("worse", 0.2, "local"), ("bad", -0.1, "local"), ("local", 0.0, "local"), ("local", 0.4, "local")],
        "basin_id string, test_R2 double, suggested_serving string",
    )
    new = spark.createDataFrame(
        [("global1", 0.9, 0.95, "local_lite"), ("lite", -0.1, 0.2, "local_lite"), ("nofile", 0.2, 0.3, "local_lite"), ("worse", 0.2, 0.1, "local_lite"), ("orphan", None, 0.3, "local_lite"), ("bad", -0.1, 0.5, "global")],
        "basin_id string, test_R2_orig double, test_R2_lite double, suggested_serving string",
    )
    ids = ["global1", "lite", "nofile", "bad", "local", "onlyindex"]
    index = spark.createDataFrame([(i, f"basin/{i}") for i in ids], "basin_id string, model_path string")
    lite = spark.createDataFrame(
        [(i, f"lite/{i}", ["f"]) for i in ("global1", "lite", "worse", "orphan", "bad")],
        "basin_id string, model_path string, feature_order array<string>",
    )
    got = {r["basin_id"]: r for r in serving_policy(metrics, new, index, lite).collect()}
    assert {k: r["mode"] for k, r in got.items()} == {
        "global1": "global", "lite": "local_lite", "nofile": "local", "worse": "global", "orphan": "global",
        "bad": "global", "local": "local", "onlyindex": "global",
    }
    assert got["lite"]["feature_order"] == ["f"] and got["lite"]["model_path"] == "lite/lite"
    assert got["local"]["model_path"] == "basin/local" and got["local"]["feature_order"] is None
    assert len(got) == 8


def test_right_join_keeps_retrained(spark):
    schema = "basin_id string, test_R2 double, test_RMSE double, test_MAE double"
    old = spark.createDataFrame([("a", 0.1, 1.0, 1.0), ("b", 0.1, 1.0, 1.0)], schema)
    new = spark.createDataFrame([("a", 0.2, 1.0, 1.0), ("z", 0.2, 1.0, 1.0)], schema)
    new = new.withColumns({"persistence_NSE": F.lit(0.1), "suggested_serving": F.lit("local_lite")})
    got = {r["basin_id"]: r["test_R2_orig"] for r in compare_retrained(old, new).collect()}
    assert got == {"a": 0.1, "z": None}
