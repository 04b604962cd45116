"""Panels in hash buckets: stored once by the columns that later joins or windows group by, which then need no exchange.

Buckets of (key, time) serve the joins of the master and spread a long series over all of them. Buckets of the key
serve the windows, but keep a series together, so a panel with long series stays in (key, time) buckets. The number
of files is the number of buckets, whatever the number of series.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from freshet import fixed

#: Folder inside the table that names its buckets; readers of the data pass over names with an underscore.
SPEC = "_buckets"


def write_buckets(
    df: DataFrame,
    path: str,
    *,
    by: Sequence[str] = (fixed.KEY, fixed.TIME),
    order: Sequence[str] = (fixed.KEY, fixed.TIME),
    buckets: int | None = None,
) -> DataFrame:
    """Write ``df`` to a new folder in buckets of ``by``, rows of a bucket in ``order``, and return the stored table.

    ``buckets`` is the session's number of shuffle partitions unless given. Each task writes one file.
    """
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = df.repartition(n, *by).sortWithinPartitions(*order)
    writer = held.write.format("parquet").bucketBy(n, *by).sortBy(*order).option("path", path)
    name = _name()
    writer.saveAsTable(name)
    spec = {"buckets": n, "by": list(by), "order": list(order), "schema": df.schema.json()}
    spark.createDataFrame([(json.dumps(spec),)], "value string").coalesce(1).write.text(f"{path.rstrip('/')}/{SPEC}")
    return spark.table(name)


def read_buckets(spark: SparkSession, path: str) -> DataFrame:
    """A table written by ``write_buckets``, also in another session, with its buckets known to the optimizer."""
    spec = json.loads(spark.read.text(f"{path.rstrip('/')}/{SPEC}").first()["value"])
    name = _name()
    quoted = lambda names: ", ".join(f"`{c}`" for c in names)
    fields = T.StructType.fromJson(json.loads(spec["schema"])).fields
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    spark.sql(
        f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({quoted(spec['by'])}) "
        f"SORTED BY ({quoted(spec['order'])}) INTO {spec['buckets']} BUCKETS LOCATION '{path}'"
    )
    return spark.table(name)


def pruned(df: DataFrame, keys: Sequence[str], key: str = fixed.KEY) -> DataFrame:
    """The rows of some series; buckets of the key alone let the scan skip all others."""
    return df.filter(F.col(key).isin(list(keys)))


def _name() -> str:
    return f"panel_{uuid.uuid4().hex[:12]}"
