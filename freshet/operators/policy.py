"""Policy tables: which columns to leave out, how to report, which model serves a series."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet import fixed
from freshet.functions.scalars import is_zero_feature
from freshet.operators.diagnose import missing_rates
from freshet.operators.metrics import first_per_key
from freshet.session import broadcast_checked


def join_diagnostics(metrics: DataFrame, summary: DataFrame, *, key: str = fixed.KEY) -> DataFrame:
    """Metrics with the diagnosis columns the rules need."""
    left = [c for c in [key, "rows", "test_R2", "test_RMSE", "test_MAE"] if c in metrics.columns]
    wanted = ["n_test", "std_test", "range_test", "near_zero_var_test", "avg_nan_rate_test", "persistence_NSE"]
    right = [c for c in [key, *wanted] if c in summary.columns]
    return metrics.select(*left).join(summary.select(*right), key, "left")


def metric_modes(summary: DataFrame, *, key: str = fixed.KEY) -> DataFrame:
    """Series with next to no spread report RMSE."""
    return summary.filter("near_zero_var_test").select(key, F.lit("rmse").alias("metric_mode"))


def model_overrides(joined: DataFrame, *, key: str = fixed.KEY) -> DataFrame:
    """Series whose own model loses to the mean while persistence beats it go to the global one."""
    worse = (F.col("test_R2") < 0) & (F.col("persistence_NSE") > 0)
    return joined.filter(worse).select(key, F.lit("global").alias("serve_model"))


def missing_policy(
    features: DataFrame,
    joined: DataFrame,
    columns: Sequence[str],
    split_date: str = fixed.SPLIT_DATE,
    *,
    key: str = fixed.KEY,
    time: str = fixed.TIME,
) -> DataFrame:
    """(key, excluded, advice): columns to leave out and columns to check, of high-missing series.

    Rates are taken over all test rows, also those without a target. The lists come from one wide
    row per series, in column order.
    """
    listed = joined.filter(F.col("avg_nan_rate_test") >= fixed.HIGH_MISSING).select(key).distinct()
    rows = features.join(broadcast_checked(listed), key, "left_semi")
    rates = missing_rates(rows, columns, split_date, key=key, time=time)
    excluded = F.array_compact(
        F.array(*[F.when(F.col(c) >= fixed.EXCLUDE_RATE, F.lit(c)) for c in columns])
    )

    def advise(c: str) -> Column:
        band = (F.col(c) >= fixed.ADVISE_RATE) & (F.col(c) < fixed.EXCLUDE_RATE)
        how = "zero" if is_zero_feature(c) else "median"
        return F.when(band, F.struct(F.lit(c).alias("column"), F.lit(how).alias("suggestion")))

    advice = F.array_compact(F.array(*[advise(c) for c in columns]))
    return rates.select(key, excluded.alias("excluded"), advice.alias("advice"))


@dataclass
class GatingPolicy:
    """The four policy tables."""

    modes: DataFrame
    overrides: DataFrame
    exclusions: DataFrame
    advice: DataFrame


def gating_policy(
    metrics: DataFrame,
    summary: DataFrame,
    features: DataFrame,
    columns: Sequence[str],
    split_date: str = fixed.SPLIT_DATE,
    *,
    key: str = fixed.KEY,
    time: str = fixed.TIME,
) -> GatingPolicy:
    joined = join_diagnostics(metrics, summary, key=key)
    lists = missing_policy(features, joined, columns, split_date, key=key, time=time)
    return GatingPolicy(
        modes=metric_modes(summary, key=key),
        overrides=model_overrides(joined, key=key),
        exclusions=lists.select(key, F.explode("excluded").alias("column")),
        advice=lists.select(key, F.explode("advice").alias("a")).select(key, "a.*"),
    )


def policy_entries(policy: GatingPolicy, *, key: str = fixed.KEY) -> DataFrame:
    """The policy as one table: (key, metric_mode, serve_model, feature_exclude, feature_impute_check).

    One row per series with an entry, so the nested form is written by many tasks; lists are bounded
    by the number of columns.
    """
    excluded = policy.exclusions.groupBy(key).agg(
        F.sort_array(F.collect_list("column")).alias("feature_exclude")
    )
    checks = policy.advice.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("column", "suggestion"))).alias("feature_impute_check")
    )
    return (
        policy.modes.join(policy.overrides, key, "full")
        .join(excluded, key, "full")
        .join(checks, key, "full")
    )


def policy_summary(exclusions: DataFrame, *, key: str = fixed.KEY) -> DataFrame:
    return exclusions.groupBy(key).agg(F.count("*").alias("excluded_features"))


def apply_overrides(
    metrics: DataFrame, modes: DataFrame, overrides: DataFrame, *, key: str = fixed.KEY
) -> DataFrame:
    """Metric mode and serving model per series; without an entry ``r2`` and ``local``."""
    out = metrics.drop("metric_mode", "serve_model")
    out = out.join(modes, key, "left").join(overrides, key, "left")
    return out.withColumns(
        {
            "metric_mode": F.coalesce("metric_mode", F.lit("r2")),
            "serve_model": F.coalesce("serve_model", F.lit("local")),
        }
    )


def compare_retrained(metrics: DataFrame, retrained: DataFrame, *, key: str = fixed.KEY) -> DataFrame:
    """Scores before and after, for every retrained series, also one without old scores."""
    scores = ["test_R2", "test_RMSE", "test_MAE"]
    old = metrics.select(key, *[F.col(c).alias(f"{c}_orig") for c in scores])
    new = retrained.select(
        key, *[F.col(c).alias(f"{c}_lite") for c in scores], "persistence_NSE", "suggested_serving"
    )
    return old.join(new, key, "right")


def suggest_retrained(r2: str = "test_R2", nse: str = "persistence_NSE") -> Column:
    """``global`` where the retrained model loses to the mean and persistence beats it."""
    to_global = (F.col(r2) < 0) & (F.coalesce(F.col(nse), F.lit(-1.0)) > 0)
    return F.when(to_global, "global").otherwise("local_lite")


def serving_policy(
    metrics: DataFrame,
    compared: DataFrame,
    local_index: DataFrame,
    lite_models: DataFrame,
    r2_good: float = 0.0,
    *,
    key: str = fixed.KEY,
) -> DataFrame:
    """(key, mode, model_path, feature_order): one row per series of any input.

    First rule that holds: a suggestion for the global model; a better retrained model that exists;
    a local model that exists and scores well; else the global model.

    ``metrics``: key, test_R2, suggested_serving. ``compared``: key, test_R2_orig, test_R2_lite,
    suggested_serving. ``local_index``: key, model_path. ``lite_models``: key, model_path,
    feature_order.
    """
    first = first_per_key(
        metrics.select(key, "test_R2", F.lower("suggested_serving").alias("suggested")),
        ["test_R2", "suggested"],
        key=key,
    )
    lite = first_per_key(
        compared.select(
            key,
            (F.col("test_R2_lite") - F.col("test_R2_orig")).alias("gain"),
            F.lower("suggested_serving").alias("lite_suggested"),
        ),
        ["gain", "lite_suggested"],
        key=key,
    )
    local = local_index.select(key, F.col("model_path").alias("local_path"))
    lite_files = lite_models.select(key, F.col("model_path").alias("lite_path"), "feature_order")
    keys = first.select(key).union(local.select(key)).union(lite.select(key)).distinct()
    table = (
        keys.join(first, key, "left")
        .join(lite, key, "left")
        .join(local, key, "left")
        .join(lite_files, key, "left")
    )
    mode = (
        F.when(F.col("suggested") == "global", "global")
        .when(
            (F.col("lite_suggested") == "local_lite")
            & (F.col("gain") > 0)
            & F.col("lite_path").isNotNull(),
            "local_lite",
        )
        .when(F.col("local_path").isNotNull() & (F.col("test_R2") >= r2_good), "local")
        .otherwise("global")
    )
    table = table.withColumn("mode", mode)
    path = F.when(F.col("mode") == "local_lite", F.col("lite_path")).when(
        F.col("mode") == "local", F.col("local_path")
    )
    order = F.when(
        F.col("mode") == "local_lite",
        F.coalesce("feature_order", F.array().cast("array<string>")),
    )
    return table.select(key, "mode", path.alias("model_path"), order.alias("feature_order"))
