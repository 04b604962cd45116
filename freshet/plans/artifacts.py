"""Everything a training and a review produce, written to one folder and read back for scoring."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet import fixed
from freshet.operators.models import MODEL_TYPE, GlobalModel
from freshet.operators.policy import policy_entries, policy_summary
from freshet.operators.scoring import score
from freshet.plans.review import Review, Training
from freshet.session import settle
from freshet.sources.artifacts import (
    encoding_entries,
    gating_entries,
    read_encoding,
    read_feature_order,
    read_serving_policy,
    serving_entries,
    write_artifact,
)
from freshet.sources.tables import write_csv

MODEL = "global_model"
ENCODING = "global_basin_te"
ORDER = "global_feature_order"
INDEX = "basin_models_index"
METRICS = "metrics_per_basin"
HYBRID = "metrics_hybrid"
GATING = "gating_policy"
SERVING = "serving_policy"
LITE = "retrained_models"


def save_training(training: Training, folder: str, exclusions: DataFrame | None = None) -> None:
    """Global model, encoding, feature order, model registry and metrics."""
    model = training.model
    spark = training.registry.sparkSession
    model.pipeline.write().save(f"{folder}/{MODEL}")
    write_artifact(encoding_entries(model.encoding), f"{folder}/{ENCODING}")
    order = spark.createDataFrame([(model.order,)], "feature_order array<string>")
    write_artifact(order, f"{folder}/{ORDER}")
    training.registry.write.parquet(f"{folder}/{INDEX}")
    write_csv(training.metrics, f"{folder}/{METRICS}")
    write_artifact(training_summary(training), f"{folder}/{HYBRID}")
    if exclusions is not None:
        write_artifact(policy_summary(exclusions), f"{folder}/policy_summary")


def training_summary(training: Training) -> DataFrame:
    """Scores of the global model per side, with the settings behind them."""
    count = training.registry.select(fixed.KEY).agg(F.count("*")).scalar()
    return training.model.metrics.withColumns(
        {
            "n_features": F.lit(len(training.model.order)),
            "num_basin_models": count,
            "target": F.lit(training.target),
            "cap_train": F.lit(fixed.CAP_TRAIN),
            "max_train": F.lit(fixed.MAX_TRAIN),
        }
    )


def save_review(review: Review, folder: str) -> None:
    """Diagnosis, gating policy, metrics with persistence, retrained models and serving policy."""
    write_csv(review.summary, f"{folder}/summary")
    write_artifact(gating_entries(policy_entries(review.gating)), f"{folder}/{GATING}")
    write_csv(review.metrics, f"{folder}/{METRICS}_with_persistence")
    review.lite.write.parquet(f"{folder}/{LITE}")
    write_artifact(serving_entries(review.serving), f"{folder}/{SERVING}")


@dataclass
class Serving:
    """What scoring needs."""

    model: GlobalModel
    policy: DataFrame
    lite: DataFrame

    def score(self, requests: DataFrame) -> DataFrame:
        return score(requests, self.policy, self.lite, self.model)


def load_serving(spark: SparkSession, folder: str) -> Serving:
    """Read the stored artifacts. Without a serving policy every series goes to the global model."""
    encoding, mean = read_encoding(spark, f"{folder}/{ENCODING}", lines=True)
    value = float(mean.first()[0] or 0.0)
    model = GlobalModel(
        PipelineModel.load(f"{folder}/{MODEL}"),
        read_feature_order(spark, f"{folder}/{ORDER}"),
        settle(encoding),
        value,
        spark.createDataFrame([], "side string"),
    )
    policy = settle(read_serving_policy(spark, f"{folder}/{SERVING}", lines=True))
    if policy.isEmpty():
        lite = spark.createDataFrame([], f"{fixed.KEY} string, model_path string, model {MODEL_TYPE}")
    else:
        lite = spark.read.parquet(f"{folder}/{LITE}").select(fixed.KEY, "model_path", "model")
    return Serving(model, policy, lite)
