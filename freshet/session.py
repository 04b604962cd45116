"""Session helpers: reliable materialisation, shared scratch folders and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_CELLS = 2_000_000


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the one named in ``spark.checkpoint.dir``.

    A folder of our own is set only where the session names none, as in local tests.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="freshet-"))
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def listed(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a pattern, in any file system that Spark reads, in order."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(place)
    return sorted(f.getPath().toString() for f in found or [])


def settle(df: DataFrame) -> DataFrame:
    """Compute once and keep on reliable storage, so later plans start from the stored rows."""
    spark = df.sparkSession
    shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def store(df: DataFrame, name: str = "table") -> DataFrame:
    """Write a table to the shared folder and read it back, keeping columnar scans and pruning."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_checked(small: DataFrame, max_cells: int = BROADCAST_CELLS) -> DataFrame:
    """Broadcast hint only where a bounded count proves the side small; else AQE chooses the join.

    Meant for stored or settled tables, where the count costs next to nothing. The limit is on
    rows times columns, so a wide table must have fewer rows.
    """
    max_rows = max_cells // max(1, len(small.columns))
    if small.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(small)
    return small
