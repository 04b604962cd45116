"""Scoring of request tables: mode per request, feature vector in fixed order, prediction, provenance.

Nothing here groups or shuffles requests by series, so a series with a third of all requests is no
hot task. Requests are ``(basin_id, features map<string,double>)``; further columns go through.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet import fixed
from freshet.functions.scalars import unlog
from freshet.operators.models import GlobalModel, linear_value
from freshet.session import broadcast_checked

#: Cells of the table of model paths and models up to which it is broadcast; a model has some tens of numbers.
MODEL_CELLS = 100_000
GLOBAL_PATH = "global"

# Notes of the fallbacks.
NOTE_INCOMPLETE = "local_lite chosen but model_path or feature_order is missing; using global."
NOTE_ABSENT = "local_lite model not found; using global."
NOTE_LOCAL = "local chosen but no feature_order is known; using global."


def usable_value(features: Column, name: Column) -> Column:
    """Request value as a number; absent, NaN and unreadable ones are NULL."""
    return F.nanvl(features[name].try_cast("double"), F.lit(None).cast("double"))


def resolve_mode(
    requests: DataFrame, policy: DataFrame, lite_models: DataFrame, *, key: str = fixed.KEY
) -> DataFrame:
    """Add mode, model_path, feature_order and notes. Anything incomplete falls back to global."""
    entries = policy.select(
        key, F.lower("mode").alias("asked"), F.col("model_path").alias("asked_path"), "feature_order"
    )
    known = lite_models.select(F.col("model_path").alias("asked_path"), F.lit(True).alias("stored"))
    entries = entries.join(known.distinct(), "asked_path", "left")
    rows = requests.join(broadcast_checked(entries), key, "left")
    asked = F.coalesce("asked", F.lit("global"))
    lite = asked == "local_lite"
    incomplete = lite & (
        (F.coalesce("asked_path", F.lit("")) == "") | (F.coalesce(F.size("feature_order"), F.lit(0)) <= 0)
    )
    absent = lite & ~incomplete & F.col("stored").isNull()
    use_lite = lite & ~incomplete & ~absent
    notes = F.array_compact(
        F.array(
            F.when(incomplete, F.lit(NOTE_INCOMPLETE)),
            F.when(absent, F.lit(NOTE_ABSENT)),
            F.when(asked == "local", F.lit(NOTE_LOCAL)),
        )
    )
    return rows.select(
        *requests.columns,
        F.when(use_lite, "local_lite").otherwise("global").alias("mode"),
        F.when(use_lite, F.col("asked_path")).otherwise(GLOBAL_PATH).alias("model_path"),
        F.when(use_lite, F.col("feature_order")).alias("feature_order"),
        notes.alias("notes"),
    )


def assemble_request(
    rows: DataFrame,
    order: Sequence[str] | Column,
    *,
    features: str = "features",
    encoded: Column | None = None,
    medians: Column | None = None,
) -> DataFrame:
    """Add ``vector`` (values in ``order``) and ``features_missing``.

    A missing value becomes 0, or the entry of ``medians`` where that map is given. The encoding is
    filled in from ``encoded`` and never counts as missing.
    """
    names = order if isinstance(order, Column) else F.array(*[F.lit(c) for c in order])
    given = F.col(features)
    is_encoded = (lambda c: c == fixed.ENCODED) if encoded is not None else (lambda c: F.lit(False))
    instead = (lambda c: F.coalesce(medians[c], F.lit(0.0))) if medians is not None else (lambda c: F.lit(0.0))
    value = F.transform(
        names,
        lambda c: F.when(is_encoded(c), encoded if encoded is not None else F.lit(0.0)).otherwise(
            F.coalesce(usable_value(given, c), instead(c))
        ),
    )
    missing = F.filter(names, lambda c: ~is_encoded(c) & usable_value(given, c).isNull())
    return rows.withColumns({"vector": value, "features_missing": missing})


def _carried(rows: DataFrame, key: str) -> list[str]:
    """Columns of the request itself, such as an id: they go through to the response."""
    own = {key, "features", "mode", "model_path", "feature_order", "notes"}
    return [c for c in rows.columns if c not in own]


def _response(rows: DataFrame, used: str, encoded: Column, carried: list[str], key: str) -> DataFrame:
    return rows.select(
        key,
        *carried,
        "yhat_log",
        unlog("yhat_log").alias("yhat_mm"),
        F.lit(used).alias("model_used"),
        "mode",
        "model_path",
        "features_missing",
        encoded.alias(fixed.ENCODED),
        "notes",
    )


def score_global(rows: DataFrame, model: GlobalModel, *, key: str = fixed.KEY) -> DataFrame:
    """Score with the pooled model, on batch or streaming rows that have a mode."""
    carried = _carried(rows, key)
    table = model.encoding.select(key, F.col("enc").alias("_enc"))
    rows = rows.join(broadcast_checked(table), key, "left")
    value = F.coalesce("_enc", F.lit(model.global_mean))
    rows = assemble_request(rows, model.order, encoded=value)
    rows = rows.withColumn("_x", array_to_vector("vector"))
    scored = model.booster.transform(rows).withColumnRenamed("yhat", "yhat_log")
    return _response(scored, "global", value, carried, key)


def score_local(rows: DataFrame, lite_models: DataFrame, *, key: str = fixed.KEY) -> DataFrame:
    """Score with the retrained models, joined by path, so several series can share one.

    Batch and streaming rows take the same expressions. ``lite_models`` should be stored.
    """
    carried = _carried(rows, key)
    models = lite_models.filter(F.col("model").isNotNull()).select("model_path", "model").dropDuplicates(["model_path"])
    rows = rows.join(broadcast_checked(models, MODEL_CELLS), "model_path", "left")
    rows = assemble_request(rows, F.col("feature_order"))
    rows = rows.withColumn("yhat_log", linear_value(F.col("model"), F.col("vector")))
    return _response(rows, "local_lite", F.lit(None).cast("double"), carried, key)


def score(
    requests: DataFrame,
    policy: DataFrame,
    lite_models: DataFrame,
    model: GlobalModel,
    *,
    key: str = fixed.KEY,
) -> DataFrame:
    """Responses for a request table: retrained models where the policy says so, else the pooled one."""
    rows = resolve_mode(requests, policy, lite_models, key=key)
    local = score_local(rows.filter("mode = 'local_lite'"), lite_models, key=key)
    return score_global(rows.filter("mode = 'global'"), model, key=key).unionByName(local)
