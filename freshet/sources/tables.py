"""Parquet and CSV tables: scans with key coercion, and skew-safe sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from freshet import fixed
from freshet.functions.scalars import nan_to_null, repair_id, to_number, to_time

_FLOATS = (T.FloatType, T.DoubleType)


def coerce_keys(
    df: DataFrame, *, key: str = fixed.KEY, time: str = fixed.TIME, time_type: str = "date"
) -> DataFrame:
    """Text key, date (or finer ``time_type``), NaN measures as NULL; rows without a key are dropped."""
    changed = {
        f.name: nan_to_null(f.name).cast(f.dataType)
        for f in df.schema.fields
        if isinstance(f.dataType, _FLOATS)
    }
    if key in df.columns:
        changed[key] = F.col(key).cast("string")
    if time in df.columns:
        changed[time] = to_time(time, time_type)
    out = df.withColumns(changed) if changed else df
    return out.filter(F.col(key).isNotNull()) if key in df.columns else out


def read_panel(
    spark: SparkSession,
    path: str | Sequence[str],
    *,
    key: str = fixed.KEY,
    time: str = fixed.TIME,
    time_type: str = "date",
    merge_schema: bool = False,
) -> DataFrame:
    """One table or a folder of parts as one panel. A key in the folder names is read as text."""
    paths = [path] if isinstance(path, str) else list(path)
    # Ids such as "0012" must not turn into numbers on the way in.
    reader = spark.read.option("mergeSchema", str(merge_schema).lower())
    if "=" in paths[0] or _has_partition_folders(spark, paths[0], key):
        plain = reader.parquet(*paths)
        fields = [
            T.StructField(f.name, T.StringType() if f.name == key else f.dataType)
            for f in plain.schema.fields
        ]
        reader = reader.schema(T.StructType(fields))
    return coerce_keys(reader.parquet(*paths), key=key, time=time, time_type=time_type)


def _has_partition_folders(spark: SparkSession, path: str, key: str) -> bool:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(f"{path}/{key}=*")
    found = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(place)
    return bool(found)


def write_panel(
    df: DataFrame,
    path: str,
    *,
    partition: bool = False,
    key: str = fixed.KEY,
    time: str = fixed.TIME,
    mode: str = "errorifexists",
) -> None:
    """Parquet sink, rows in (key, time) order; ``partition`` gives one folder per series.

    Range partitioning on (key, time) cuts a long series over several tasks and files, and keeps
    each task to the folders of its own key range.
    """
    ranged = df.repartitionByRange(F.col(key), F.col(time)).sortWithinPartitions(key, time)
    writer = ranged.write.mode(mode)
    (writer.partitionBy(key) if partition else writer).parquet(path)


def read_metrics(
    spark: SparkSession,
    path: str,
    *,
    key: str = fixed.KEY,
    numbers: Sequence[str] = (),
    schema: str | None = None,
) -> DataFrame:
    """CSV metric table: everything read as text, ids repaired, the named columns made numeric."""
    reader = spark.read.option("header", True).option("escape", '"')
    table = (reader.schema(schema) if schema else reader).csv(path)
    changed = {c: to_number(c) for c in numbers if c in table.columns}
    return table.withColumns({**changed, key: repair_id(key)})


def write_csv(df: DataFrame, path: str, *, sep: str = ",", mode: str = "errorifexists") -> None:
    """CSV sink; arrays are written as JSON text."""
    texts = {
        f.name: F.to_json(f.name)
        for f in df.schema.fields
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))
    }
    out = df.withColumns(texts) if texts else df
    out.write.mode(mode).csv(path, header=True, sep=sep, escape='"')
