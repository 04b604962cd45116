"""Per-series diagnosis: target statistics, missing rates, persistence scores, near-zero flag."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet import fixed
from freshet.functions import stats
from freshet.functions.scalars import unlog
from freshet.operators.blocks import BLOCK_ROWS
from freshet.operators.columns import numeric_features
from freshet.operators.master import require
from freshet.operators.metrics import persistence
from freshet.operators.split import side


def stat_columns(y: Column, suffix: str) -> list[Column]:
    return [
        F.count(y).alias(f"n_{suffix}"),
        F.avg(y).alias(f"mean_{suffix}"),
        F.stddev_pop(y).alias(f"std_{suffix}"),
        F.var_pop(y).alias(f"var_{suffix}"),
        F.min(y).alias(f"min_{suffix}"),
        F.max(y).alias(f"max_{suffix}"),
        (F.max(y) - F.min(y)).alias(f"range_{suffix}"),
    ]


def series_stats(
    df: DataFrame,
    target: str,
    split_date: str = fixed.SPLIT_DATE,
    *,
    key: str = fixed.KEY,
    time: str = fixed.TIME,
) -> DataFrame:
    """Count, mean, population spread and range of the target, train and test, in one aggregate."""
    where = side(time, split_date)
    y = F.col(target)
    return df.groupBy(key).agg(
        *stat_columns(F.when(where == "train", y), "train"),
        *stat_columns(F.when(where == "test", y), "test"),
    )


def near_zero_flag(std: str = "std_test", mean: str = "mean_test") -> Column:
    """Is the spread next to nothing, absolutely or against the mean? False without test rows."""
    ratio = F.col(std) / (F.abs(F.col(mean)) + F.lit(fixed.NEAR_ZERO_EPS))
    flag = (F.col(std) < fixed.NEAR_ZERO_STD) | (ratio < fixed.NEAR_ZERO_RATIO)
    return F.coalesce(flag, F.lit(False))


def missing_rates(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    split_date: str = fixed.SPLIT_DATE,
    *,
    key: str = fixed.KEY,
    time: str = fixed.TIME,
) -> DataFrame:
    """Share of missing cells per series and column over the test rows, one wide row per series."""
    columns = numeric_features(df) if columns is None else list(columns)
    test = df.filter(side(time, split_date) == "test")
    return test.groupBy(key).agg(
        *[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns]
    )


def long_rates(rates: DataFrame, *, key: str = fixed.KEY) -> DataFrame:
    columns = [c for c in rates.columns if c != key]
    return rates.unpivot(key, columns, "column", "nan_rate")


def mean_rate(rates: DataFrame, *, key: str = fixed.KEY) -> DataFrame:
    columns = [c for c in rates.columns if c != key]
    if not columns:
        return rates.select(key, F.lit(0.0).alias("avg_nan_rate_test"))
    total = sum((F.col(c) for c in columns[1:]), F.col(columns[0]))
    return rates.select(key, (total / len(columns)).alias("avg_nan_rate_test"))


def missing_top(rates: DataFrame, n: int = fixed.TOP_MISSING, *, key: str = fixed.KEY) -> DataFrame:
    """The n columns of each series with the highest missing rate; a group is one series' columns."""
    w = Window.partitionBy(key).orderBy(F.col("nan_rate").desc(), "column")
    ranked = long_rates(rates, key=key).withColumn("rank", F.row_number().over(w))
    return ranked.filter(F.col("rank") <= n)


def persistence_scores(
    df: DataFrame,
    target: str = "y_log1p",
    split_date: str = fixed.SPLIT_DATE,
    *,
    key: str = fixed.KEY,
    time: str = fixed.TIME,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """NSE, logNSE and KGE of the previous-value forecast inside the test rows.

    Series with five pairs or fewer have no scores. logNSE and KGE are taken in the original unit.
    """
    pairs = persistence(
        df, target, split_date, scope="test", key=key, time=time, block_rows=block_rows
    )
    pairs = pairs.filter(F.col("yhat").isNotNull()).withColumns(
        {"mm": unlog("y"), "mmhat": unlog("yhat")}
    )
    scored = pairs.groupBy(key).agg(
        F.count("*").alias("pairs"),
        stats.nse("y", "yhat").alias("persistence_NSE"),
        stats.nse_log1p("mm", "mmhat").alias("persistence_logNSE"),
        stats.kge("mm", "mmhat").alias("persistence_KGE"),
    )
    return scored.filter(F.col("pairs") >= fixed.MIN_VALID_PAIRS).drop("pairs")


def diagnose(
    features: DataFrame,
    target: str = "y_log1p",
    split_date: str = fixed.SPLIT_DATE,
    *,
    columns: Sequence[str] | None = None,
    key: str = fixed.KEY,
    time: str = fixed.TIME,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """One diagnosis row per series: target statistics and missing rates from one pass over the
    panel, persistence scores from a window over key, time and target."""
    rows = require(features, [time, key, target])
    columns = numeric_features(features) if columns is None else list(columns)
    scores = persistence_scores(rows, target, split_date, key=key, time=time, block_rows=block_rows)
    test = side(time, split_date) == "test"
    y = F.col(target)
    gaps = [F.avg(F.when(test, F.col(c).isNull().cast("double"))) for c in columns]
    mean_gap = sum(gaps[1:], gaps[0]) / len(gaps) if gaps else F.lit(0.0)
    table = rows.groupBy(key).agg(
        *stat_columns(F.when(side(time, split_date) == "train", y), "train"),
        *stat_columns(F.when(test, y), "test"),
        mean_gap.alias("avg_nan_rate_test"),
    )
    table = table.join(scores, key, "left")
    return table.select(
        key,
        "n_train",
        "n_test",
        *[f"{m}_{s}" for s in ("train", "test") for m in ("mean", "std", "var")],
        "range_test",
        near_zero_flag().alias("near_zero_var_test"),
        "persistence_NSE",
        "persistence_logNSE",
        "persistence_KGE",
        F.coalesce("avg_nan_rate_test", F.lit(0.0)).alias("avg_nan_rate_test"),
    )


def near_zero_report(metrics: DataFrame, summary: DataFrame, *, key: str = fixed.KEY) -> DataFrame:
    """Scores of the series with next to no spread, sorted by logNSE, missing last."""
    left = summary.filter("near_zero_var_test").select(key, "n_test", "std_test", "range_test")
    right = metrics.select(key, "test_MAE", "test_RMSE", F.col("test_R2").alias("logNSE_test"))
    out = left.join(right, key, "left").select(
        key, "test_MAE", "test_RMSE", "logNSE_test", "n_test", "std_test", "range_test"
    )
    return out.orderBy(F.col("logNSE_test").asc_nulls_last(), key)
