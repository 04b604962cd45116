"""Scoring of a request stream.

A request carries its own features, so the job holds no state: the policy and the encoding are
static tables joined to the stream, and the rows of one micro-batch are scored as a batch is. Where
artifacts come in versions, each micro-batch keeps the version that it met first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from freshet import fixed
from freshet.operators.models import GlobalModel
from freshet.operators.scoring import score
from freshet.plans.artifacts import Serving, load_serving
from freshet.plans.versions import folder_of, versions
from freshet.session import listed

REQUEST_SCHEMA = f"{fixed.KEY} string, features map<string,double>"


def read_requests(spark: SparkSession, folder: str, *, files_per_trigger: int = 1000) -> DataFrame:
    """JSON requests as they arrive in a folder."""
    return (
        spark.readStream.schema(REQUEST_SCHEMA)
        .option("maxFilesPerTrigger", files_per_trigger)
        .json(folder)
    )


def score_stream(
    requests: DataFrame, policy: DataFrame, lite_models: DataFrame, model: GlobalModel
) -> DataFrame:
    """Streaming responses to every request, each in its own mode."""
    return score(requests, policy, lite_models, model)


def write_stream(rows: DataFrame, out: str, checkpoint: str, *, trigger: dict | None = None) -> StreamingQuery:
    """Append a stream to a parquet folder; its commit log makes each row appear once."""
    return (
        rows.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def write_scores(
    requests: DataFrame,
    policy: DataFrame,
    lite_models: DataFrame,
    model: GlobalModel,
    out: str,
    checkpoint: str,
    *,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Score every request with its own mode and write parquet.

    Each micro-batch goes to a folder of its own that a repeated batch overwrites, so a restart
    neither loses nor doubles responses.
    """

    def run(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            responses = score(batch, policy, lite_models, model)
            responses.write.mode("overwrite").parquet(f"{out}/batch={number}")
        finally:
            batch.unpersist()

    return (
        requests.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def pinned(spark: SparkSession, root: str, pins: str, number: int) -> int:
    """The artifact version of a micro-batch: the newest complete one when it first runs, the same one ever after."""
    pin = f"{pins}/batch={number}"
    if listed(spark, f"{pin}/_SUCCESS"):
        return spark.read.schema("version int").json(pin).first()["version"]
    found = versions(spark, root)
    if not found:
        raise FileNotFoundError(f"no complete version in {root}")
    spark.createDataFrame([(found[-1],)], "version int").write.mode("overwrite").json(pin)
    return found[-1]


def versioned_batch(
    root: str, out: str, load: Callable[[SparkSession, str], Serving] = load_serving
) -> Callable[[DataFrame, int], None]:
    """Score one micro-batch with the artifact version pinned to it; the rows go to a folder of that batch.

    The pin is written before anything is scored and the folder is overwritten, so a batch that is repeated after a
    failure gives the same rows once, even if a newer version has been published in between.
    """
    held: dict[int, Serving] = {}

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        version = pinned(spark, root, f"{out}/pins", number)
        if version not in held:
            held.clear()
            held[version] = load(spark, folder_of(root, version))
        batch.persist()
        try:
            responses = held[version].score(batch).withColumn("version", F.lit(version))
            responses.write.mode("overwrite").parquet(f"{out}/rows/batch={number}")
        finally:
            batch.unpersist()

    return run


def write_versioned_scores(
    requests: DataFrame,
    root: str,
    out: str,
    checkpoint: str,
    *,
    load: Callable[[SparkSession, str], Serving] = load_serving,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Score a request stream with the newest version of the artifacts under ``root``, taken anew for every micro-batch."""
    return (
        requests.writeStream.foreachBatch(versioned_batch(root, out, load))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_scores(spark: SparkSession, out: str) -> DataFrame:
    """All responses written so far, with their ``batch`` and ``version``."""
    return spark.read.parquet(f"{out}/rows")
