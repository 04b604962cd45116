"""Model fitting: one global boosted-tree model, one linear model per series, retraining of the worst."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet import fixed
from freshet.operators.columns import ensure_columns, exclude_columns
from freshet.operators.encode import (
    apply_target_encoding,
    fit_target_encoding,
    impute_rules,
    median_columns,
    train_medians,
)
from freshet.operators.metrics import (
    bottom_n,
    persistence,
    persistence_nse,
    regression_metrics,
    score_columns,
)
from freshet.operators.moments import State, clustered, merge_all, states
from freshet.operators.policy import suggest_retrained
from freshet.operators.split import (
    cap_per_series,
    fitting_cap,
    pooled_split,
    restrict_to,
    series_use,
    temporal_split,
)
from freshet.session import BROADCAST_CELLS, broadcast_checked, settle, store


def _doubles(columns: Sequence[str]) -> list[Column]:
    """Features as numbers; integer and boolean ones count as numeric too."""
    return [F.col(c).cast("double").alias(c) for c in columns]


def _boosted(features: Sequence[str], target: str, params: dict, seed: int = fixed.SEED):
    assembler = VectorAssembler(inputCols=list(features), outputCol="_x", handleInvalid="keep")
    booster = GBTRegressor(
        featuresCol="_x",
        labelCol=target,
        predictionCol="yhat",
        maxIter=params["rounds"],
        stepSize=params["rate"],
        maxDepth=params["depth"],
        subsamplingRate=params["subsample"],
        featureSubsetStrategy=str(params["columns"]),
        cacheNodeIds=True,
        checkpointInterval=10,
        seed=seed,
    )
    return assembler, booster


def _fit_boosted(rows: DataFrame, features: Sequence[str], target: str, params: dict) -> PipelineModel:
    assembler, booster = _boosted(features, target, params)
    return PipelineModel([assembler, booster.fit(assembler.transform(rows))])


@dataclass
class GlobalModel:
    """The pooled model with all it needs at scoring time."""

    pipeline: PipelineModel
    order: list[str]
    encoding: DataFrame
    global_mean: float
    metrics: DataFrame

    @property
    def booster(self) -> GBTRegressionModel:
        return self.pipeline.stages[-1]


def global_rows(
    features: DataFrame,
    target: str,
    order: Sequence[str],
    exclusions: DataFrame | None = None,
    *,
    split_date: str = fixed.SPLIT_DATE,
    caps: dict[str, int] | None = None,
    max_train: int = fixed.MAX_TRAIN,
    key: str = fixed.KEY,
    time: str = fixed.TIME,
) -> tuple[DataFrame, DataFrame]:
    """Training table of the pooled model, and the encoding.

    Encoding and medians use all train rows. ``caps`` then bound the rows per series of the sides they name, by
    default of the train side only: all test rows stay. The train cap is lowered, for every series alike, until
    at most ``max_train`` train rows are left.
    Excluded columns are set to zero and take no part in imputation.
    """
    caps = caps or {"train": fixed.CAP_TRAIN}
    base = [c for c in order if c != fixed.ENCODED]
    rows = ensure_columns(temporal_split(features, target, split_date, key=key, time=time), base)
    rows = rows.select(key, time, "side", target, *_doubles(base))
    train = rows.filter("side = 'train'")
    encoding = settle(fit_target_encoding(train, target, key=key))
    middle = median_columns(base)
    medians = train_medians(train, middle, key=key) if middle else None
    if "train" in caps:
        counts = train.groupBy(key).agg(F.count("*").alias("n_train"))
        caps = {**caps, "train": fitting_cap(counts, caps["train"], max_train)}
    # Caps first: what follows works on the rows that stay.
    capped = F.col("side").isin(*caps)
    rows = cap_per_series(rows.filter(capped), caps, key=key, time=time).unionByName(rows.filter(~capped))
    if exclusions is not None:
        rows = exclude_columns(rows, exclusions, base, fill=0.0, key=key)
    rows = impute_rules(rows, base, medians, key=key)
    mean = encoding.agg(F.max("global_mean")).scalar()
    rows = apply_target_encoding(rows, encoding, mean, key=key)
    return rows.select(key, time, "side", target, *order), encoding


def fit_global(
    features: DataFrame,
    target: str,
    order: Sequence[str],
    exclusions: DataFrame | None = None,
    *,
    params: dict | None = None,
    **options,
) -> GlobalModel:
    """Boosted trees over the pooled, capped panel with the series encoding as a column."""
    params = {**fixed.BOOSTING, **(params or {})}
    rows, encoding = global_rows(features, target, order, exclusions, **options)
    # A column no training row has a value of stays missing; trees need a number.
    rows = store(rows.na.fill(0.0, subset=list(order)), "pooled")
    pipeline = _fit_boosted(rows.filter("side = 'train'"), order, target, params)
    scored = pipeline.transform(rows)
    metrics = regression_metrics(scored, target, "yhat", ["side"], target=target)
    mean = encoding.agg(F.max("global_mean")).first()[0]
    return GlobalModel(pipeline, list(order), encoding, float(mean or 0.0), settle(metrics))


def fit_baseline(
    master: DataFrame,
    features: Sequence[str],
    target: str = fixed.TARGET,
    *,
    split_date: str = fixed.SPLIT_DATE,
    params: dict | None = None,
    time: str = fixed.TIME,
) -> tuple[PipelineModel, DataFrame]:
    """Pooled baseline on the raw forcings: complete rows only; returns the model and its scores."""
    params = {**fixed.BOOSTING, "rounds": fixed.BASELINE_ROUNDS, **(params or {})}
    rows = store(
        pooled_split(master, features, target, split_date, time=time).select(
            "side", target, *_doubles(features)
        ),
        "baseline",
    )
    pipeline = _fit_boosted(rows.filter("side = 'train'"), features, target, params)
    return pipeline, regression_metrics(pipeline.transform(rows), target, "yhat", ["side"], target=target)


def named_importance(spark, model: GBTRegressionModel, order: Sequence[str]) -> DataFrame:
    """Importance per feature name, highest first; features the trees never use are left out."""
    names = list(order)
    vector = model.featureImportances
    rows = [
        (names[int(i)] if int(i) < len(names) else f"f{int(i)}", float(v))
        for i, v in zip(vector.indices, vector.values)
        if v > 0
    ]
    return spark.createDataFrame(rows, "feature string, gain double").orderBy(F.desc("gain"), "feature")


def top_features(importance: DataFrame, k: int = fixed.TOP_K) -> list[str]:
    """The k most important features without the encoding."""
    rows = importance.filter(F.col("feature") != fixed.ENCODED)
    return [r["feature"] for r in rows.orderBy(F.desc("gain"), "feature").limit(k).collect()]


#: A per-series model: the value of a row is the intercept plus its values times the coefficients.
MODEL_TYPE = "struct<intercept:double,coefficients:array<double>>"
#: Ridge penalty on standardised coefficients, as a share of the number of training rows.
RIDGE = 0.01
#: A column whose spread is below this share of its size counts as constant and gets no coefficient.
LEAST_SPREAD = 1e-7


def solve_ridge(state: State, used: Sequence[int], penalty: float) -> tuple[float, np.ndarray]:
    """Intercept and one coefficient per used column; the state's last column is the target."""
    mean, spread = state.mean, state.square / state.n
    scale = np.sqrt(np.maximum(np.diag(spread), 0.0))
    size = np.sqrt(scale**2 + mean**2)
    at = np.asarray(used, dtype=int)
    moving = at[scale[at] > LEAST_SPREAD * size[at]]
    slope = np.zeros(len(mean))
    if len(moving):
        r = spread[np.ix_(moving, moving)] / np.outer(scale[moving], scale[moving])
        slope[moving] = np.linalg.solve(r + penalty * np.eye(len(moving)), spread[moving, -1] / scale[moving]) / scale[moving]
    return float(mean[-1] - slope[at] @ mean[at]), slope[at]


def linear_value(model: Column, vector: Column) -> Column:
    """Value of a model for a vector of its features, in the order of its coefficients."""
    products = F.zip_with(vector, model["coefficients"], lambda x, w: x * w)
    return F.aggregate(products, model["intercept"], lambda total, v: total + v)


def fit_per_series(
    features: DataFrame,
    target: str,
    columns: Sequence[str],
    exclusions: DataFrame | None = None,
    *,
    split_date: str = fixed.SPLIT_DATE,
    min_rows: int = fixed.MIN_ROWS,
    min_features: int = fixed.MIN_FEATURES,
    penalty: float = RIDGE,
    prefix: str = "basin",
    key: str = fixed.KEY,
    time: str = fixed.TIME,
) -> DataFrame:
    """One ridge regression per series with its scores: the model registry.

    Series that pass the gate are fitted the same way whatever their length: rows are clustered by series once, tasks
    fold them into co-moments, and one small system is solved per series from its merged state. ``model`` holds the intercept and the coefficients of ``features_used``. ``features``
    should be stored, as it is read several times.
    """
    columns = list(columns)
    use = series_use(features, target, columns, exclusions, split_date=split_date, min_rows=min_rows, min_features=min_features, key=key, time=time)
    usable = settle(use.filter("gate = 'ok'").select(key, "rows", F.col("usable").alias("used")))
    rows = temporal_split(features, target, split_date, key=key, time=time)
    rows = rows.join(broadcast_checked(usable.select(key, "rows")), key).select(
        key, time, "side", "rows", F.col(target).cast("double").alias(target), *_doubles(columns)
    )
    if exclusions is not None:
        rows = exclude_columns(rows, exclusions, columns, fill=None, key=key)
    middle = median_columns(columns)
    medians = train_medians(rows.filter("side = 'train'"), middle, key=key) if middle else None
    rows = impute_rules(rows, columns, medians, key=key).na.fill(0.0, subset=columns)
    rows = store(clustered(rows, "rows", key, time).drop("rows"), "fit-rows")

    used = {c: i for i, c in enumerate(columns)}
    schema = f"{key} string, rows bigint, n_features bigint, features_used array<string>, model {MODEL_TYPE}, weights array<double>"
    parts = store(states(rows.filter("side = 'train'"), [*columns, target], key), "states").join(usable, key)

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        state = merge_all([State.read(*x) for x in sorted(zip(group["n"], map(tuple, group["mean"]), map(tuple, group["triangle"])))])
        names = list(group["used"].iat[0])
        intercept, found = solve_ridge(state, [used[c] for c in names], penalty)
        weights = np.zeros(len(columns))
        weights[[used[c] for c in names]] = found
        row = (group[key].iat[0], group["rows"].iat[0], len(names), names, {"intercept": intercept, "coefficients": found.tolist()}, weights.tolist())
        return pd.DataFrame([row], columns=[key, "rows", "n_features", "features_used", "model", "weights"])

    fitted = store(parts.groupBy(key).applyInPandas(solve, schema), "fits")
    whole = F.struct(F.col("model.intercept").alias("intercept"), F.col("weights").alias("coefficients"))
    weights = fitted.select(key, whole.alias("model"))
    limit = BROADCAST_CELLS // (len(columns) + 2)  # an array counts as its cells
    scored = rows.join(broadcast_checked(weights, 2 * limit), key).withColumn("yhat", linear_value(F.col("model"), F.array(*columns)))
    log = target == "y_log1p"
    scores = scored.groupBy(key).agg(
        *score_columns(target, "yhat", when=F.col("side") == "train", prefix="train_", log=log),
        *score_columns(target, "yhat", when=F.col("side") == "test", prefix="test_", log=log),
    )
    path = F.concat(F.lit(f"{prefix}/"), F.col(key)).alias("model_path")
    return fitted.drop("weights").join(scores, key).select(
        key, "rows", "n_features", "features_used", *[c for c in scores.columns if c != key], path, "model"
    )


def fit_linear_per_series(
    rows: DataFrame, y: str, x: str, *, key: str = fixed.KEY
) -> DataFrame:
    """Least-squares line per series: slope, intercept and R2, as plain aggregates."""
    return rows.groupBy(key).agg(
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"),
        F.regr_count(y, x).alias("n"),
    )


def retrain_bottom(
    features: DataFrame,
    metrics: DataFrame,
    top: Sequence[str],
    target: str,
    exclusions: DataFrame | None = None,
    *,
    n: int = fixed.N_BOTTOM,
    split_date: str = fixed.SPLIT_DATE,
    penalty: float = RIDGE,
    key: str = fixed.KEY,
    time: str = fixed.TIME,
) -> DataFrame:
    """Refit the n worst series on the most important features and suggest how to serve them."""
    worst = settle(bottom_n(metrics, n, key=key).select(key))
    rows = restrict_to(features, worst, key=key)
    fitted = store(
        fit_per_series(
            rows,
            target,
            [c for c in top if c in features.columns],
            exclusions,
            split_date=split_date,
            min_rows=0,
            penalty=penalty,
            prefix="lite",
            key=key,
            time=time,
        ),
        "lite-fits",
    )
    scores = persistence_nse(persistence(rows, target, split_date, key=key, time=time), key=key)
    out = fitted.join(scores, key, "left")
    return out.withColumns(
        {
            "persistence_N": F.coalesce("persistence_N", F.lit(0).cast("bigint")),
            "suggested_serving": suggest_retrained(),
        }
    )
