"""Forecast scores, persistence, series statistics and missing rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet import fixed
from freshet.catalog import query
from freshet.catalog.fixture import (
    AUG,
    CHECKED,
    M,
    MT,
    SD,
    SM,
    SPLIT,
    STATS_SQL,
    SUM,
    TEST,
    kge_sql,
    mae_sql,
    master,
    metrics,
    nse_sql,
    r,
    rmse_sql,
    rounded,
    series,
    smooth,
    summary,
    table,
    with_,
)
from freshet.functions import stats
from freshet.operators.diagnose import (
    long_rates,
    mean_rate,
    missing_rates,
    missing_top,
    near_zero_flag,
    series_stats,
)
from freshet.operators.metrics import (
    augment_persistence,
    bottom_n,
    first_per_key,
    persistence,
    persistence_nse,
    regression_metrics,
    report_metrics,
    review_list,
)
from freshet.operators.split import side

KEYS = [fixed.KEY, fixed.TIME]


def _cols(names: list[str]) -> str:
    return ", ".join(r(c, c) for c in names)


@query(
    "regression_metrics",
    with_(
        *SM,
        select=f"""
SELECT basin_id, side, {r(mae_sql('y_log1p', 'yhat'), 'MAE')}, {r(rmse_sql('y_log1p', 'yhat'), 'RMSE')},
  {r(nse_sql('y_log1p', 'yhat'), 'R2')}, {r(nse_sql('y_log1p', 'yhat'), 'logNSE')}
FROM (SELECT *, CASE WHEN {TEST} THEN 'test' ELSE 'train' END AS side FROM sm) GROUP BY basin_id, side
""",
    ),
)
def forecast_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = smooth(spark, sf_dir).withColumn("side", side(split_date=SPLIT))
    return rounded(regression_metrics(rows, "y_log1p", "yhat", [fixed.KEY, "side"]))


METRIC_COLS = [f"{s}_{m}" for s in ("train", "test") for m in ("MAE", "RMSE", "R2")]


@query("series_metrics", with_(*MT, select=f"SELECT basin_id, rows, {_cols(METRIC_COLS)} FROM mt"))
def series_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics(smooth(spark, sf_dir))
    return rounded(rows.select(fixed.KEY, "rows", *METRIC_COLS))


@query(
    "efficiency_scores",
    with_(
        *SM,
        select=f"""
SELECT basin_id, {r(nse_sql('discharge_mm', 'guess'), 'nse')},
  {r(nse_sql('ln(1 + discharge_mm)', 'ln(1 + guess)'), 'lognse')}, {r(kge_sql('discharge_mm', 'guess'), 'kge')}
FROM (SELECT *, exp(yhat) - 1 AS guess FROM sm) GROUP BY basin_id
""",
    ),
)
def efficiency_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = smooth(spark, sf_dir).withColumn("guess", F.expm1("yhat"))
    return rounded(
        rows.groupBy(fixed.KEY).agg(
            stats.nse(fixed.TARGET, "guess").alias("nse"),
            stats.nse_log1p(fixed.TARGET, "guess").alias("lognse"),
            stats.kge(fixed.TARGET, "guess").alias("kge"),
        )
    )


SHORT_SQL = (
    "SELECT CAST(user_id AS STRING) AS basin_id, CAST(ts AS DATE) AS date, CAST(count(*) AS DOUBLE) AS y "
    "FROM events GROUP BY 1, 2"
)
SHORT_SPLIT = "2024-01-21"


def _short(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many short series: events per user and day."""
    events = table(spark, sf_dir, "events")
    return events.groupBy(
        F.col("user_id").cast("string").alias(fixed.KEY), F.col("ts").cast("date").alias(fixed.TIME)
    ).agg(F.count("*").cast("double").alias("y"))


@query(
    "persistence_in_test",
    with_(
        ("e", SHORT_SQL),
        select=f"""
SELECT basin_id, date, y, lag(y) OVER (PARTITION BY basin_id ORDER BY date) AS yhat
FROM e WHERE date >= DATE '{SHORT_SPLIT}'
""",
    ),
)
def persistence_in_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return persistence(_short(spark, sf_dir), "y", SHORT_SPLIT, scope="test", block_rows=8)


@query(
    "persistence_over_series",
    with_(
        SD,
        select=f"""
SELECT * FROM (SELECT basin_id, date, discharge_mm AS y,
    lag(discharge_mm) OVER (PARTITION BY basin_id ORDER BY date) AS yhat FROM sd) WHERE {TEST}
""",
    ),
)
def persistence_over_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a target keep their place in the series."""
    return persistence(series(spark, sf_dir), fixed.TARGET, SPLIT, block_rows=300)


@query(
    "persistence_nse",
    with_(
        *M,
        select=f"""
SELECT basin_id, {r(nse_sql('ly', 'lp'), 'persistence_NSE')}, count(*) AS persistence_N
FROM (SELECT basin_id, date, ln(1 + discharge_mm) AS ly,
    lag(ln(1 + discharge_mm)) OVER (PARTITION BY basin_id ORDER BY date) AS lp FROM m)
WHERE {TEST} AND lp IS NOT NULL GROUP BY basin_id
""",
    ),
)
def previous_value_nse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = master(spark, sf_dir).withColumn("y_log1p", F.log1p(fixed.TARGET))
    return rounded(persistence_nse(persistence(rows, "y_log1p", SPLIT)))


STAT_COLS = [f"{m}_{s}" for s in ("train", "test") for m in ("mean", "std", "var", "min", "max", "range")]


@query(
    "series_stats",
    with_(
        *SM, ("st", STATS_SQL),
        select=f"SELECT basin_id, n_train, n_test, {_cols(STAT_COLS)} FROM st",
    ),
)
def target_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = series_stats(smooth(spark, sf_dir), "y_log1p", SPLIT)
    return rounded(rows.select(fixed.KEY, "n_train", "n_test", *STAT_COLS))


@query(
    "near_zero_series",
    """
SELECT basin_id, coalesce(s < 1e-3 OR s / (abs(m) + 1e-6) < 0.01, FALSE) AS near_zero
FROM (SELECT basin_id, stddev_pop(v) AS s, avg(v) AS m
      FROM (SELECT event_type || '/' || CAST(user_id AS STRING) AS basin_id,
              CASE event_type WHEN 'error' THEN 7.0 WHEN 'signup' THEN 500 + value / 100 ELSE value END AS v
            FROM events) GROUP BY basin_id)
""",
)
def near_zero_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constant, nearly constant and varying series."""
    events = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    v = (
        F.when(kind == "error", 7.0)
        .when(kind == "signup", 500 + F.col("value") / 100)
        .otherwise(F.col("value"))
    )
    key = F.concat_ws("/", "event_type", F.col("user_id").cast("string")).alias(fixed.KEY)
    spread = events.groupBy(key).agg(
        F.stddev_pop(v).alias("std_test"), F.avg(v).alias("mean_test")
    )
    return spread.select(fixed.KEY, near_zero_flag().alias("near_zero"))


RATE_ROWS_SQL = " UNION ALL ".join(
    f"SELECT basin_id, '{c}' AS \"column\", avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) AS nan_rate "
    f"FROM sm WHERE {TEST} GROUP BY basin_id"
    for c in CHECKED
)


@query(
    "missing_rates",
    with_(
        *SM, ("k", RATE_ROWS_SQL),
        select=f'SELECT basin_id, "column", {r("nan_rate", "nan_rate")} FROM k',
    ),
)
def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(long_rates(missing_rates(smooth(spark, sf_dir), CHECKED, SPLIT)))


@query(
    "mean_missing_rate",
    with_(
        *SM, ("k", RATE_ROWS_SQL),
        select=f"SELECT basin_id, {r('avg(nan_rate)', 'avg_nan_rate_test')} FROM k GROUP BY basin_id",
    ),
)
def mean_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(mean_rate(missing_rates(smooth(spark, sf_dir), CHECKED, SPLIT)))


@query(
    "missing_top",
    with_(
        *SM,
        ("k", RATE_ROWS_SQL),
        (
            "n",
            'SELECT *, CAST(row_number() OVER (PARTITION BY basin_id ORDER BY nan_rate DESC, "column") AS INT) AS rank FROM k',
        ),
        select=f'SELECT basin_id, "column", {r("nan_rate", "nan_rate")}, rank FROM n WHERE rank <= 2',
    ),
)
def top_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(missing_top(missing_rates(smooth(spark, sf_dir), CHECKED, SPLIT), 2))


SUMMARY_COLS = [
    "mean_train", "std_train", "var_train", "mean_test", "std_test", "var_test", "range_test",
    "persistence_NSE", "persistence_logNSE", "persistence_KGE", "avg_nan_rate_test",
]


@query(
    "diagnosis",
    with_(
        *SUM,
        select=f"SELECT basin_id, n_train, n_test, near_zero_var_test, {_cols(SUMMARY_COLS)} FROM su",
    ),
)
def diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(summary(smooth(spark, sf_dir)))


AUG_COLS = ["test_R2", "test_RMSE", "persistence_NSE"]


@query(
    "persistence_augmented",
    with_(
        *AUG,
        select=f"SELECT basin_id, {_cols(AUG_COLS)}, persistence_N, suggested_serving FROM ag",
    ),
)
def persistence_augmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = smooth(spark, sf_dir)
    out = augment_persistence(metrics(rows), rows, "y_log1p", SPLIT)
    return rounded(out.select(fixed.KEY, *AUG_COLS, "persistence_N", "suggested_serving"))


@query(
    "worst_series",
    with_(
        *MT,
        select=f"SELECT basin_id, {r('test_R2', 'test_R2')} FROM mt ORDER BY mt.test_R2 ASC NULLS LAST, basin_id LIMIT 10",
    ),
)
def worst_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bottom_n(metrics(smooth(spark, sf_dir)), 10).select(fixed.KEY, "test_R2"))


REVIEW_COLS = ["test_R2", "test_RMSE", "train_R2", "train_RMSE"]


@query(
    "review_list",
    with_(
        *MT,
        ("n", "SELECT *, row_number() OVER (ORDER BY test_R2 ASC NULLS LAST, basin_id) AS rk FROM mt"),
        select=f"SELECT basin_id, rows, {_cols(REVIEW_COLS)} FROM n WHERE rk <= 5 OR test_R2 <= 0.5",
    ),
)
def listed_for_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(review_list(metrics(smooth(spark, sf_dir)), 5, 0.5))


@query(
    "reported_metric",
    with_(
        *MT,
        ("a", "SELECT *, CASE WHEN test_R2 < 0.8 THEN 'rmse' ELSE 'r2' END AS metric_mode FROM mt"),
        ("b", "SELECT *, CASE metric_mode WHEN 'rmse' THEN test_RMSE ELSE test_R2 END AS rm FROM a"),
        select=f"SELECT basin_id, metric_mode, {r('rm', 'reported_metric')} FROM b",
    ),
)
def reported_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics(smooth(spark, sf_dir)).withColumn(
        "metric_mode", F.when(F.col("test_R2") < 0.8, "rmse").otherwise("r2")
    )
    return rounded(report_metrics(rows).select(fixed.KEY, "metric_mode", "reported_metric"))


@query(
    "first_per_series",
    "SELECT CAST(o_custkey AS STRING) AS basin_id, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS o_orderkey "
    "FROM orders GROUP BY o_custkey",
)
def first_per_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias(fixed.KEY), "o_totalprice", "o_orderkey"
    )
    return first_per_key(orders, ["o_totalprice", "o_orderkey"]).drop("o_totalprice")
