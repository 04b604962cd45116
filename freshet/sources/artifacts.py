"""JSON artifacts (policies, encodings, feature order) and the artifact manifest."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet import fixed

ENCODING_SCHEMA = "mapping map<string,double>, global_mean double"
ORDER_SCHEMA = "feature_order array<string>"
GATING_SCHEMA = (
    "metric_mode_overrides map<string,string>, model_overrides map<string,string>, "
    "feature_exclude map<string,array<string>>, "
    "feature_impute_check map<string,array<struct<column:string,suggestion:string>>>"
)
SERVING_SCHEMA = (
    "basins map<string,struct<mode:string,model_path:string,feature_order:array<string>>>"
)


def read_artifact(
    spark: SparkSession, path: str, schema: str, *, lines: bool = False
) -> DataFrame:
    """JSON artifact with a known schema; a missing or broken file gives an empty table.

    One document per file, or with ``lines`` one per line, as :func:`write_artifact` writes them.
    """
    reader = spark.read.schema(schema).option("multiLine", not lines)
    reader = reader.option("mode", "DROPMALFORMED")
    try:
        return reader.json(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return spark.createDataFrame([], schema)
        raise


def write_artifact(df: DataFrame, path: str, *, mode: str = "errorifexists") -> None:
    """JSON lines: entries of many series are written by many tasks, never as one document."""
    df.write.mode(mode).json(path)


def encoding_entries(encoding: DataFrame, *, key: str = fixed.KEY) -> DataFrame:
    """The encoding in its artifact form, one series per line."""
    return encoding.select(F.create_map(key, "enc").alias("mapping"), "global_mean")


def read_encoding(spark: SparkSession, path: str, *, lines: bool = False, key: str = fixed.KEY):
    """Encoding artifact -> (table (key, enc), one-row table (global_mean))."""
    whole = read_artifact(spark, path, ENCODING_SCHEMA, lines=lines)
    mean = whole.agg(F.max("global_mean").alias("global_mean"))
    return whole.select(F.explode("mapping").alias(key, "enc")), mean


def read_feature_order(spark: SparkSession, path: str) -> list[str]:
    rows = read_artifact(spark, path, ORDER_SCHEMA).head(1)
    order = rows[0]["feature_order"] if rows else None
    if not order or fixed.ENCODED not in order:
        raise ValueError(f"{path} holds no feature_order with {fixed.ENCODED}")
    return list(order)


def gating_entries(entries: DataFrame, *, key: str = fixed.KEY) -> DataFrame:
    """Policy entries in the artifact's nested form, one series per line."""

    def entry(column: str):
        return F.when(F.col(column).isNotNull(), F.create_map(key, column))

    return entries.select(
        entry("metric_mode").alias("metric_mode_overrides"),
        entry("serve_model").alias("model_overrides"),
        entry("feature_exclude").alias("feature_exclude"),
        entry("feature_impute_check").alias("feature_impute_check"),
    )


def read_overrides(spark: SparkSession, path: str, *, lines: bool = False, key: str = fixed.KEY):
    """Gating artifact -> (table (key, metric_mode), table (key, serve_model))."""
    gating = read_artifact(spark, path, GATING_SCHEMA, lines=lines)
    modes = gating.select(F.explode("metric_mode_overrides").alias(key, "metric_mode"))
    return modes, gating.select(F.explode("model_overrides").alias(key, "serve_model"))


def read_exclusions(
    spark: SparkSession, path: str, *, lines: bool = False, key: str = fixed.KEY
) -> DataFrame:
    """Gating artifact -> (key, column), one row per excluded column."""
    gating = read_artifact(spark, path, GATING_SCHEMA, lines=lines)
    lists = gating.select(F.explode("feature_exclude").alias(key, "columns"))
    return lists.select(key, F.explode("columns").alias("column"))


def serving_entries(policy: DataFrame, *, key: str = fixed.KEY) -> DataFrame:
    """The serving policy in its artifact form, one series per line."""
    entry = F.struct("mode", "model_path", "feature_order")
    return policy.select(F.create_map(F.col(key), entry).alias("basins"))


def read_serving_policy(
    spark: SparkSession, path: str, *, lines: bool = False, key: str = fixed.KEY
) -> DataFrame:
    """Serving artifact -> (key, mode, model_path, feature_order)."""
    policy = read_artifact(spark, path, SERVING_SCHEMA, lines=lines)
    return policy.select(F.explode("basins").alias(key, "entry")).select(key, "entry.*")


def artifact_manifest(spark: SparkSession, folder: str, artifacts: dict[str, str]) -> DataFrame:
    """One row per expected artifact: exists, sha256, size and last modification.

    An artifact is a file, or a folder as Spark writes it: then the digest is that of its parts' names and
    digests in order, and the size is their sum.
    """
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    base = files.makeQualified(place).toString()
    expected = spark.createDataFrame(
        [(n, f"{base}/{p}") for n, p in artifacts.items()], "artifact string, path string"
    )
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    # A file belongs to every expected artifact that it is or lies in.
    owners = [
        F.when((F.col("path") == p) | F.col("path").startswith(f"{p}/"), F.lit(p))
        for p in dict.fromkeys(f"{base}/{p}" for p in artifacts.values())
    ]
    parts = found.withColumn("owner", F.explode(F.array_compact(F.array(*owners))))
    part = F.struct(F.expr("substring(path, length(owner) + 1)").alias("name"), F.sha2("content", 256).alias("sha"))
    listed = F.array_sort(F.collect_list(part))
    whole = F.sha2(F.array_join(F.transform("parts", lambda x: F.concat_ws(":", x["name"], x["sha"])), ","), 256)
    single = F.get("parts", 0)
    told = (
        parts.groupBy("owner")
        .agg(listed.alias("parts"), F.sum("length").alias("size_bytes"), F.max("modificationTime").alias("mtime"))
        .withColumn("sha256", F.when(single["name"] == "", single["sha"]).otherwise(whole))
    )
    return expected.join(told, F.col("path") == F.col("owner"), "left").select(
        "artifact", "path", F.col("owner").isNotNull().alias("exists"), "sha256", "size_bytes", "mtime"
    )
