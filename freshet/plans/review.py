"""Training, diagnosis and serving policy from one feature panel."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet import fixed
from freshet.operators.columns import common_features, feature_order, numeric_features
from freshet.operators.diagnose import diagnose
from freshet.operators.metrics import augment_persistence, report_metrics, review_list
from freshet.operators.models import (
    GlobalModel,
    fit_global,
    fit_per_series,
    named_importance,
    retrain_bottom,
    top_features,
)
from freshet.operators.policy import (
    GatingPolicy,
    apply_overrides,
    compare_retrained,
    gating_policy,
    serving_policy,
)
from freshet.operators.split import pick_target, restrict_to
from freshet.session import settle, store


@dataclass
class Training:
    target: str
    registry: DataFrame
    metrics: DataFrame
    model: GlobalModel


def train(
    features: DataFrame,
    policy: GatingPolicy | None = None,
    *,
    split_date: str = fixed.SPLIT_DATE,
    min_rows: int = fixed.MIN_ROWS,
    params: dict | None = None,
) -> Training:
    """Per-series models, then the global one; an earlier policy feeds its exclusions back in."""
    target = pick_target(features.columns)
    numeric = numeric_features(features)
    common = [r[0] for r in common_features(features, numeric).collect()]
    exclusions = None if policy is None else policy.exclusions
    # Stored as columns, so that reading the scores leaves the models alone.
    registry = store(
        fit_per_series(
            features,
            target,
            sorted(common),
            exclusions,
            split_date=split_date,
            min_rows=min_rows,
        ),
        "registry",
    )
    metrics = registry.drop("model", "features_used")
    if policy is None:
        metrics = metrics.withColumns({"metric_mode": F.lit("r2"), "serve_model": F.lit("local")})
    else:
        metrics = apply_overrides(metrics, policy.modes, policy.overrides)
    order = feature_order(numeric, common)
    model = fit_global(features, target, order, exclusions, split_date=split_date, params=params)
    return Training(target, registry, report_metrics(metrics), model)


@dataclass
class Review:
    summary: DataFrame
    gating: GatingPolicy
    metrics: DataFrame
    lite: DataFrame
    serving: DataFrame


def review(
    features: DataFrame,
    training: Training,
    *,
    split_date: str = fixed.SPLIT_DATE,
    n_bottom: int = fixed.N_BOTTOM,
    top_k: int = fixed.TOP_K,
    r2_good: float = 0.0,
) -> Review:
    """Diagnose the weak series, set the gating policy, retrain the worst and merge what serves."""
    spark = features.sparkSession
    columns = numeric_features(features)
    listed = settle(review_list(training.metrics, n_bottom))
    weak = restrict_to(features, listed)
    summary = settle(diagnose(weak, split_date=split_date))
    gating = gating_policy(training.metrics, summary, features, columns, split_date)
    metrics = settle(augment_persistence(training.metrics, features, training.target, split_date))
    top = top_features(named_importance(spark, training.model.booster, training.model.order), top_k)
    lite = retrain_bottom(
        features,
        metrics,
        top,
        training.target,
        gating.exclusions,
        n=n_bottom,
        split_date=split_date,
    )
    lite = store(lite, "lite")
    compared = compare_retrained(metrics, lite)
    serving = serving_policy(
        metrics,
        compared,
        training.registry.select(fixed.KEY, "model_path"),
        lite.select(fixed.KEY, "model_path", F.col("features_used").alias("feature_order")),
        r2_good,
    )
    return Review(summary, gating, metrics, lite, settle(serving))
