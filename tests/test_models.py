"""Model fits, scoring of batches and streams, and the whole flow from files to policy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from freshet import fixed
from freshet.operators import scoring
from freshet.operators.features import build_features
from freshet.operators.models import (
    fit_baseline,
    fit_global,
    global_rows,
    fit_linear_per_series,
    fit_per_series,
    named_importance,
    retrain_bottom,
    top_features,
)
from freshet.operators.scoring import assemble_request, resolve_mode, score
from freshet.plans.artifacts import load_serving, save_review, save_training
from freshet.plans.panel import feature_panel, master_from_files
from freshet.plans.review import review, train
from freshet.session import settle
from freshet.streaming.scoring import read_requests, score_stream, write_scores

SMALL = {"rounds": 12, "depth": 3, "rate": 0.3}
SPLIT = "2002-06-01"
COLUMNS = ["prcp_mm_cr2met_lag1", "prcp_mm_cr2met_sum_3d", "tmin_c", "pet_mm_hargreaves"]


@pytest.fixture(scope="module")
def panel(spark):
    """Discharge follows yesterday's rain, with a level that differs by series."""
    rng = np.random.default_rng(7)
    parts = []
    for b in range(5):
        n = 1100 if b < 4 else 300
        rain = rng.gamma(0.6, 8, n)
        frame = pd.DataFrame({"basin_id": str(b), "date": pd.date_range("2000-01-01", periods=n).date})
        frame["prcp_mm_cr2met"] = rain
        frame["discharge_mm"] = (b + 1) * 2 + 0.5 * np.concatenate([[0], rain[:-1]]) + rng.random(n)
        frame["tmin_c"] = rng.normal(5, 3, n)
        frame["tmax_c"] = frame["tmin_c"] + 8
        frame["pet_mm_hargreaves"] = rng.random(n) * 4
        parts.append(frame)
    return settle(build_features(spark.createDataFrame(pd.concat(parts, ignore_index=True))))


@pytest.fixture(scope="module")
def model(panel):
    return fit_global(panel, "y_log1p", [*COLUMNS, fixed.ENCODED], split_date=SPLIT, params=SMALL)


def test_global_rows_keep_every_series_and_all_test_rows(panel):
    options = {"split_date": "2001-01-01"}
    valid = panel.filter("y_log1p is not null").withColumn("side", F.when(F.col("date") < "2001-01-01", "train").otherwise("test"))
    test_rows = {r["basin_id"]: r["count"] for r in valid.filter("side = 'test'").groupBy("basin_id").count().collect()}
    assert max(test_rows.values()) > fixed.CAP_TEST
    for most, cap in ((10**6, 366), (40, 10)):
        rows, _ = global_rows(panel, "y_log1p", [*COLUMNS, fixed.ENCODED], max_train=most, **options)
        got = {(r["basin_id"], r["side"]): r["count"] for r in rows.groupBy("basin_id", "side").count().collect()}
        assert {b: n for (b, side), n in got.items() if side == "test"} == test_rows
        assert {b for b, side in got if side == "train"} == set(test_rows)
        assert all(n <= cap for (_, side), n in got.items() if side == "train")


def test_per_series_models(panel):
    fitted = fit_per_series(panel, "y_log1p", COLUMNS, split_date=SPLIT).collect()
    got = {r["basin_id"]: r for r in fitted}
    assert set(got) == {"0", "1", "2", "3"}
    for r in got.values():
        assert r["test_R2"] > 0.8 and r["test_logNSE"] == r["test_R2"] and r["rows"] == 1100
        assert r["features_used"] == COLUMNS and r["model_path"] == f"basin/{r['basin_id']}"


def test_ridge_equals_a_plain_solution(panel):
    """Also with a column that never changes, one with gaps and rows spread over many tasks."""
    rows = panel.withColumn("flat", F.lit(3000.0)).repartition(7)
    columns = [*COLUMNS, "flat"]
    fitted = {r["basin_id"]: r for r in fit_per_series(rows, "y_log1p", columns, split_date=SPLIT).collect()}
    for name in ("0", "3"):
        frame = panel.filter(F.col("basin_id") == name).filter("y_log1p is not null").orderBy("date").toPandas()
        train = pd.to_datetime(frame["date"]) < SPLIT
        x = frame[COLUMNS].fillna(0.0).to_numpy(dtype=float)
        y = frame["y_log1p"].to_numpy(dtype=float)
        mean, scale = x[train].mean(axis=0), x[train].std(axis=0)
        z = (x - mean) / scale
        n = train.sum()
        slope = np.linalg.solve(z[train].T @ z[train] / n + 0.01 * np.eye(4), z[train].T @ (y[train] - y[train].mean()) / n)
        got = fitted[name]["model"]
        assert got["coefficients"] == pytest.approx([*(slope / scale), 0.0], abs=1e-8)
        guess = y[train].mean() + z @ slope
        rmse = np.sqrt(((y - guess)[~train] ** 2).mean())
        assert fitted[name]["test_RMSE"] == pytest.approx(rmse, abs=1e-8)


def test_a_long_series_is_fitted_like_a_short_one(panel):
    """The rows of one series many times over weigh the same: same model, and other series do not change."""
    some = panel.filter("basin_id in ('2', '3')")
    hot = some.withColumn("k", F.explode(F.sequence(F.lit(1), F.when(F.col("basin_id") == "3", 20).otherwise(1)))).drop("k")
    once, often = ({r["basin_id"]: r for r in fit_per_series(df, "y_log1p", COLUMNS, split_date=SPLIT).collect()} for df in (some, hot))
    for name in ("2", "3"):
        assert often[name]["model"]["coefficients"] == pytest.approx(once[name]["model"]["coefficients"])
        assert often[name]["test_R2"] == pytest.approx(once[name]["test_R2"])


def test_excluded_columns_are_not_used(panel):
    left_out = panel.sparkSession.createDataFrame([("3", "tmin_c")], "basin_id string, column string")
    got = {r["basin_id"]: r for r in fit_per_series(panel, "y_log1p", COLUMNS, left_out, split_date=SPLIT).collect()}
    assert got["2"]["n_features"] == 4 and got["3"]["n_features"] == 3
    assert len(got["3"]["model"]["coefficients"]) == 3 and "tmin_c" not in got["3"]["features_used"]


def test_global_model(model, spark):
    got = {r["side"]: r for r in model.metrics.collect()}
    assert got["test"]["R2"] > 0.8 and got["train"]["R2"] > 0.8
    named = named_importance(spark, model.booster, model.order)
    assert "prcp_mm_cr2met_lag1" in top_features(named, 2)
    assert fixed.ENCODED not in top_features(named, 99)


def test_baseline_model(panel):
    """A boolean column counts as a feature."""
    rows = panel.withColumn("wet", F.col("prcp_mm_cr2met") > 5)
    _, scores = fit_baseline(rows, ["prcp_mm_cr2met", "tmin_c", "wet"], split_date=SPLIT, params=SMALL)
    assert {r["side"]: r["logNSE"] for r in scores.collect()} == {"train": None, "test": None}


def test_linear_fit(spark):
    rows = [("a", float(i), 2.0 * i + 1) for i in range(5)] + [("flat", 1.0, 2.0), ("flat", 1.0, 3.0)]
    df = spark.createDataFrame(rows, "basin_id string, x double, y double")
    got = {r["basin_id"]: r for r in fit_linear_per_series(df, "y", "x").collect()}
    assert (got["a"]["slope"], got["a"]["intercept"], got["a"]["r2"]) == pytest.approx((2, 1, 1))
    assert got["flat"]["slope"] is None


def test_retraining(panel):
    scores = panel.groupBy("basin_id").agg(F.lit(-1.0).alias("test_R2"))
    scores = scores.withColumn("test_R2", F.when(F.col("basin_id") == "1", -3.0).otherwise(F.col("test_R2")))
    out = retrain_bottom(panel, scores, [*COLUMNS, "absent"], "y_log1p", n=2, split_date=SPLIT)
    got = {r["basin_id"]: r for r in out.collect()}
    assert set(got) == {"0", "1"}
    assert {r["suggested_serving"] for r in got.values()} == {"local_lite"}
    assert got["1"]["persistence_N"] > 0 and got["1"]["model_path"] == "lite/1"


def requests_of(panel):
    entries = [x for c in COLUMNS for x in (F.lit(c), F.col(c))]
    recent = F.col("date") >= F.lit(SPLIT).cast("date")
    test = panel.filter(recent | ((F.col("basin_id") == "4") & (F.col("date") > "2000-03-15")))
    full = F.create_map(*entries)
    return settle(
        test.select("basin_id", F.when(F.dayofmonth("date") == 1, F.map_filter(full, lambda k, v: k != "tmin_c")).otherwise(full).alias("features"))
    )


@pytest.fixture(scope="module")
def lite(panel):
    some = panel.filter("basin_id in ('0', '1')")
    return settle(fit_per_series(some, "y_log1p", COLUMNS, split_date=SPLIT, prefix="lite"))


def policy_of(spark):
    rows = [
        ("0", "local_lite", "lite/0", COLUMNS),
        ("1", "LOCAL_LITE", "lite/1", COLUMNS),
        ("2", "local", "basin/2", None),
        ("3", "local_lite", "lite/3", COLUMNS),
    ]
    schema = "basin_id string, mode string, model_path string, feature_order array<string>"
    return spark.createDataFrame(rows, schema)


def test_scores_of_a_batch(spark, panel, model, lite):
    requests = requests_of(panel)
    requests = settle(requests.withColumn("request_id", F.monotonically_increasing_id()))
    out = score(requests, policy_of(spark), lite, model).cache()
    assert out.count() == requests.count() == out.select("request_id").distinct().count()
    used = {r["basin_id"]: r["model_used"] for r in out.select("basin_id", "model_used").distinct().collect()}
    assert used == {"0": "local_lite", "1": "local_lite", "2": "global", "3": "global", "4": "global"}
    assert out.filter("yhat_log is null or isnan(yhat_mm)").count() == 0
    row = out.filter("basin_id = '4' and size(features_missing) > 0").first()
    assert row["features_missing"] == ["tmin_c"] and row["basin_te"] is not None and row["notes"] == []
    assert out.filter("basin_id = '2'").first()["notes"] == [scoring.NOTE_LOCAL]
    assert out.filter("basin_id = '3'").first()["notes"] == [scoring.NOTE_ABSENT]
    assert out.filter("model_used = 'local_lite' and basin_te is not null").count() == 0


def test_series_can_share_a_model(spark, panel, model, lite):
    rows = [(b, "local_lite", "lite/1", COLUMNS) for b in ("0", "1")]
    policy = spark.createDataFrame(rows, "basin_id string, mode string, model_path string, feature_order array<string>")
    requests = requests_of(panel).filter("basin_id in ('0', '1')")
    out = score(requests, policy, lite, model)
    assert out.count() == requests.count() == out.filter("model_path = 'lite/1' and yhat_log is not null").count()


def test_request_vector(spark):
    df = spark.sql("select 'a' as basin_id, map('x', 1.0D, 'y', double('nan'), 'w', null) as features, 0.7D as te")
    row = assemble_request(df, ["y", "x", "z", "basin_te"], encoded=F.col("te")).first()
    assert row["vector"] == [0.0, 1.0, 0.0, 0.7] and row["features_missing"] == ["y", "z"]
    medians = F.create_map(F.lit("z"), F.lit(9.0))
    assert assemble_request(df, ["y", "z"], medians=medians).first()["vector"] == [0.0, 9.0]
    text = spark.sql("select 'a' as basin_id, map('x', '1.5', 'y', 'oops') as features")
    row = assemble_request(text, ["x", "y"]).first()
    assert row["vector"] == [1.5, 0.0] and row["features_missing"] == ["y"]


def test_incomplete_policy_entry(spark):
    rows = [("a", "local_lite", None, ["x"]), ("b", "local_lite", "m", []), ("c", "local_lite", "m", None), ("d", "local_lite", "m", ["x"])]
    policy = spark.createDataFrame(rows, "basin_id string, mode string, model_path string, feature_order array<string>")
    stored = spark.createDataFrame([("m",)], "model_path string")
    requests = spark.createDataFrame([(k,) for k in "abcde"], "basin_id string")
    got = {r["basin_id"]: (r["mode"], r["notes"]) for r in resolve_mode(requests, policy, stored).collect()}
    incomplete = ("global", [scoring.NOTE_INCOMPLETE])
    assert got == {"a": incomplete, "b": incomplete, "c": incomplete, "d": ("local_lite", []), "e": ("global", [])}


def test_stream_equals_batch(spark, panel, model, lite, tmp_path):
    requests = requests_of(panel)
    folder = str(tmp_path / "in")
    requests.repartition(3).write.json(folder)
    policy = settle(policy_of(spark))
    stored = spark.read.schema(requests.schema).json(folder)
    want = score(stored, policy, lite, model)

    stream = read_requests(spark, folder, files_per_trigger=1)
    run = write_scores(stream, policy, lite, model, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert run.awaitTermination(180)
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    key = lambda df: sorted(map(str, df.select("basin_id", "yhat_log", "model_used", "notes").collect()))
    assert key(got) == key(want)

    direct = score_stream(read_requests(spark, folder), policy, lite, model)
    run = direct.writeStream.format("memory").queryName("scored").trigger(availableNow=True).start()
    assert run.awaitTermination(180)
    assert key(spark.table("scored")) == key(want)


def test_from_files_to_policy(spark, panel, tmp_path):
    for name in ("discharge_mm", *fixed.FORCINGS):
        wide = panel.groupBy("date").pivot("basin_id", list("01234")).agg(F.max(name)).orderBy("date")
        frame = wide.toPandas()
        frame.to_csv(tmp_path / f"{name}.txt", sep="\t", index=False, na_rep="-9999")
    (tmp_path / "attrs.txt").write_text("gauge_id\t0\t1\t2\t3\t4\narea_km2\t1\t2\t3\t4\t5\n")
    master = master_from_files(
        spark,
        str(tmp_path / "discharge_mm"),
        {c: str(tmp_path / c) for c in fixed.FORCINGS},
        str(tmp_path / "attrs"),
    )
    stored = feature_panel(spark, master, str(tmp_path / "master"), str(tmp_path / "features"))
    assert stored.count() == panel.count() and "area_km2" in stored.columns
    params = {"rounds": 6, "depth": 4, "rate": 0.3}
    trained = train(stored, split_date=SPLIT, params=params)
    assert trained.target == "y_log1p" and trained.metrics.count() == 4
    assert trained.model.order[-1] == fixed.ENCODED and "area_km2" in trained.model.order
    done = review(stored, trained, split_date=SPLIT, n_bottom=2, top_k=5)
    assert done.summary.count() == 2 and done.lite.count() == 2
    modes = {r["basin_id"]: r["mode"] for r in done.serving.collect()}
    assert set(modes) == set("0123") and set(modes.values()) <= {"global", "local", "local_lite"}
    again = train(stored, done.gating, split_date=SPLIT, params=params)
    assert again.metrics.count() == 4

    folder = str(tmp_path / "models")
    save_training(trained, folder, done.gating.exclusions)
    save_review(done, folder)
    loaded = load_serving(spark, folder)
    lite = done.lite.select("basin_id", "model_path", "model")
    requests = requests_of(panel)
    want = score(requests, done.serving, lite, trained.model)
    key = lambda df: sorted(map(str, df.select("basin_id", "yhat_mm", "model_used", "mode").collect()))
    assert key(loaded.score(requests)) == key(want)
    assert sorted(r["side"] for r in spark.read.json(f"{folder}/metrics_hybrid").collect()) == ["test", "train"]
