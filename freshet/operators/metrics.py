"""Forecast scores per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet import fixed
from freshet.functions import stats
from freshet.operators.blocks import BLOCK_ROWS, over_series
from freshet.operators.split import side


def score_columns(y: str, yhat: str, *, when: Column | None = None, prefix: str = "", log: bool) -> list[Column]:
    """MAE, RMSE, R2 and logNSE (equal to R2 for a log target, else missing) over the rows ``when``."""
    a, b = F.col(y), F.col(yhat)
    if when is not None:
        a, b = F.when(when, a), F.when(when, b)
    r2 = stats.nse(a, b)
    return [
        stats.mae(a, b).alias(f"{prefix}MAE"),
        stats.rmse(a, b).alias(f"{prefix}RMSE"),
        r2.alias(f"{prefix}R2"),
        (r2 if log else F.lit(None).cast("double")).alias(f"{prefix}logNSE"),
    ]


def regression_metrics(
    df: DataFrame, y: str, yhat: str, by: Sequence[str] = (fixed.KEY,), *, target: str = "y_log1p"
) -> DataFrame:
    """Scores per group in one aggregate."""
    return df.groupBy(*by).agg(*score_columns(y, yhat, log=target == "y_log1p"))


def split_metrics(
    df: DataFrame, y: str, yhat: str, *, target: str = "y_log1p", key: str = fixed.KEY
) -> DataFrame:
    """Train and test scores side by side, one row per series, from one pass."""
    log = target == "y_log1p"
    return df.groupBy(key).agg(
        *score_columns(y, yhat, when=F.col("side") == "train", prefix="train_", log=log),
        *score_columns(y, yhat, when=F.col("side") == "test", prefix="test_", log=log),
    )


def persistence(
    df: DataFrame,
    target: str,
    split_date: str = fixed.SPLIT_DATE,
    *,
    scope: str = "series",
    key: str = fixed.KEY,
    time: str = fixed.TIME,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Test rows with the previous value as forecast (``yhat``).

    ``scope="series"`` shifts the whole series first, so the first test row sees the last train row
    and a missing target keeps its place; ``scope="test"`` shifts the usable test rows alone.
    """
    test = side(time, split_date) == "test"
    rows = df.select(key, time, F.col(target).alias("y"))
    if scope == "test":
        rows = rows.filter(test & F.col("y").isNotNull())

    def build(part: DataFrame, w) -> DataFrame:
        return part.withColumn("yhat", F.lag("y", 1).over(w))

    out = over_series(rows, build, halo=1, key=key, time=time, block_rows=block_rows)
    return out if scope == "test" else out.filter(test)


def persistence_nse(pairs: DataFrame, *, key: str = fixed.KEY) -> DataFrame:
    """NSE of the previous-value forecast and the number of its pairs."""
    both = pairs.filter(F.col("y").isNotNull() & F.col("yhat").isNotNull())
    return both.groupBy(key).agg(
        stats.nse("y", "yhat").alias("persistence_NSE"), F.count("*").alias("persistence_N")
    )


def augment_persistence(
    metrics: DataFrame,
    panel: DataFrame,
    target: str,
    split_date: str = fixed.SPLIT_DATE,
    *,
    key: str = fixed.KEY,
    time: str = fixed.TIME,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Metrics with the persistence score, and ``global`` suggested where the model is worse than
    the mean while persistence is better than it. A listed series without rows gets (missing, 0)."""
    scores = persistence_nse(
        persistence(panel, target, split_date, key=key, time=time, block_rows=block_rows), key=key
    )
    out = metrics.join(scores, key, "left").withColumn(
        "persistence_N", F.coalesce("persistence_N", F.lit(0).cast("bigint"))
    )
    if "test_R2" not in metrics.columns:
        return out
    to_global = (F.col("test_R2") < 0) & (F.col("persistence_NSE") > 0)
    return out.withColumn("suggested_serving", F.when(to_global, "global").otherwise("local"))


def report_metrics(metrics: DataFrame, *, key: str = fixed.KEY) -> DataFrame:
    """Metrics with the reported one (RMSE or R2, by mode), sorted by mode and that, ascending."""
    chosen = F.when(F.col("metric_mode") == "rmse", F.col("test_RMSE")).otherwise(F.col("test_R2"))
    return metrics.withColumn("reported_metric", chosen).orderBy(
        "metric_mode", F.col("reported_metric").asc_nulls_last(), key
    )


def bottom_n(metrics: DataFrame, n: int = fixed.N_BOTTOM, by: str = "test_R2", *, key: str = fixed.KEY):
    """The n worst series, missing scores last."""
    return metrics.orderBy(F.col(by).asc_nulls_last(), key).limit(n)


def first_per_key(df: DataFrame, order: Sequence[str], *, key: str = fixed.KEY) -> DataFrame:
    """One row per key: the first in ``order``, found by an aggregate, not by ranking the group."""
    rest = [c for c in df.columns if c != key]
    ranks = F.struct(*[F.struct(F.col(c).isNull(), F.col(c)) for c in order])
    best = df.groupBy(key).agg(F.min_by(F.struct(*rest), ranks).alias("_row"))
    return best.select(key, "_row.*")


def review_list(
    metrics: DataFrame,
    n: int = fixed.N_BOTTOM,
    threshold: float = 0.0,
    *,
    key: str = fixed.KEY,
) -> DataFrame:
    """The n worst series and all at or below the threshold, each once."""
    names = [key, "rows", "test_R2", "test_RMSE", "train_R2", "train_RMSE"]
    kept = [c for c in names if c in metrics.columns]
    listed = bottom_n(metrics, n, key=key).unionByName(metrics.filter(F.col("test_R2") <= threshold))
    return first_per_key(listed.select(*kept), [c for c in kept if c != key], key=key)

