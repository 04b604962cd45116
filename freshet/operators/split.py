"""Temporal split, per-series gates and caps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet import fixed
from freshet.operators.master import require
from freshet.session import broadcast_checked, settle


def side(time: str = fixed.TIME, split_date: str = fixed.SPLIT_DATE) -> Column:
    """``train`` before the split date, ``test`` from it on."""
    day = F.lit(split_date).cast("date")
    return F.when(F.col(time) < day, "train").when(F.col(time) >= day, "test")


def pick_target(columns: Sequence[str]) -> str:
    for name in fixed.TARGET_PRIORITY:
        if name in columns:
            return name
    raise ValueError(f"no target column; one of {fixed.TARGET_PRIORITY} is needed")


def split_counts(
    df: DataFrame,
    target: str,
    split_date: str = fixed.SPLIT_DATE,
    *,
    key: str = fixed.KEY,
    time: str = fixed.TIME,
) -> DataFrame:
    """Raw rows and usable train and test rows per series."""
    usable = F.col(target).isNotNull()
    where = side(time, split_date)
    return df.groupBy(key).agg(
        F.count("*").alias("rows"),
        F.count_if(usable & (where == "train")).alias("n_train"),
        F.count_if(usable & (where == "test")).alias("n_test"),
    )


def temporal_split(
    df: DataFrame,
    target: str,
    split_date: str = fixed.SPLIT_DATE,
    *,
    key: str = fixed.KEY,
    time: str = fixed.TIME,
) -> DataFrame:
    """Rows with a ``side`` column, for series that have rows on both sides.

    The valid series are counted first, from three columns; where they are few enough to broadcast,
    the panel itself is not shuffled.
    """
    rows = require(df, [target, time, key])
    counts = split_counts(rows, target, split_date, key=key, time=time)
    valid = settle(counts.filter((F.col("n_train") > 0) & (F.col("n_test") > 0)).select(key))
    rows = rows.join(broadcast_checked(valid), key, "left_semi")
    return rows.withColumn("side", side(time, split_date))


def pooled_split(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    split_date: str = fixed.SPLIT_DATE,
    *,
    time: str = fixed.TIME,
) -> DataFrame:
    """Split of the pooled table: rows with any missing feature, target or date are dropped."""
    rows = require(df, [*features, target, time])
    return rows.withColumn("side", side(time, split_date))


def basin_gate(
    df: DataFrame,
    target: str,
    features: Sequence[str],
    exclusions: DataFrame | None = None,
    *,
    split_date: str = fixed.SPLIT_DATE,
    min_rows: int = fixed.MIN_ROWS,
    min_features: int = fixed.MIN_FEATURES,
    key: str = fixed.KEY,
    time: str = fixed.TIME,
) -> DataFrame:
    """Why a series gets no model of its own: ``small``, ``split``, ``no_feats``, or ``ok``.

    The checks run in this order. Nothing can be empty after imputation, as rows without a target are
    not counted in the first place.
    """
    use = series_use(
        df, target, features, exclusions, split_date=split_date, min_rows=min_rows, min_features=min_features, key=key, time=time
    )
    return use.select(key, "rows", "n_train", "n_test", "n_features", "gate")


def series_use(
    df: DataFrame,
    target: str,
    features: Sequence[str],
    exclusions: DataFrame | None = None,
    *,
    split_date: str = fixed.SPLIT_DATE,
    min_rows: int = fixed.MIN_ROWS,
    min_features: int = fixed.MIN_FEATURES,
    key: str = fixed.KEY,
    time: str = fixed.TIME,
) -> DataFrame:
    """The gate of every series, as fits and reports apply it, with the names of its ``usable`` features.

    A feature is usable if the series has a value of it and the policy does not exclude it. One pass over ``df``.
    """
    usable = F.col(target).isNotNull()
    where = side(time, split_date)
    present = F.array_compact(
        F.array(*[F.when(F.count(c) > 0, F.lit(c)) for c in features])
    ).alias("present")
    table = df.groupBy(key).agg(
        F.count("*").alias("rows"),
        F.count_if(usable & (where == "train")).alias("n_train"),
        F.count_if(usable & (where == "test")).alias("n_test"),
        present,
    )
    left_out = F.array().cast("array<string>")
    if exclusions is not None:
        # At most one entry per feature name, so the list is bounded by the table's width.
        lists = exclusions.groupBy(key).agg(F.collect_set("column").alias("excluded"))
        table = table.join(lists, key, "left")
        left_out = F.coalesce("excluded", left_out)
    table = table.withColumn("usable", F.array_except("present", left_out))
    table = table.withColumn("n_features", F.size("usable").cast("bigint"))
    gate = (
        F.when(F.col("rows") < min_rows, "small")
        .when((F.col("n_train") == 0) | (F.col("n_test") == 0), "split")
        .when(F.col("n_features") < min_features, "no_feats")
        .otherwise("ok")
    )
    return table.select(key, "rows", "n_train", "n_test", "n_features", "usable", gate.alias("gate"))


def gate_counts(gates: DataFrame) -> DataFrame:
    return gates.groupBy("gate").agg(F.count("*").alias("series"))


def hash_order(columns: Sequence[str], seed: int = fixed.SEED) -> Column:
    """Pseudo-random but reproducible order of rows."""
    return F.sha2(F.concat_ws("#", *[F.col(c).cast("string") for c in columns], F.lit(str(seed))), 256)


def cap_per_series(
    df: DataFrame,
    caps: dict[str, int],
    *,
    by: str = "side",
    seed: int = fixed.SEED,
    key: str = fixed.KEY,
    time: str = fixed.TIME,
) -> DataFrame:
    """At most ``caps[value of by]`` rows of each series and side, taken in hash order.

    A draw with more leading zeros is smaller, and each further zero keeps one row in sixteen. Counts
    per number of zeros show how many a series can demand and still hold enough rows. So a hot series
    is thinned to some multiple of its cap before anything is ranked, and the rows kept are exactly
    the first ones.
    """
    rows = df.withColumn("_draw", hash_order([key, time], seed)).withColumn(
        "_zeros", F.length(F.regexp_extract("_draw", "^0*", 0))
    )
    cap = F.coalesce(*[F.when(F.col(by) == v, F.lit(n)) for v, n in caps.items()])
    down = Window.partitionBy(key, by).orderBy(F.desc("_zeros"))
    counts = rows.groupBy(key, by, "_zeros").agg(F.count("*").alias("n"))
    held = counts.withColumn("held", F.sum("n").over(down)).withColumn("_cap", cap)
    enough = F.max(F.when(F.col("held") >= F.col("_cap"), F.col("_zeros")))
    demand = held.groupBy(key, by, "_cap").agg(F.coalesce(enough, F.lit(0)).alias("_demand"))
    thinned = rows.join(broadcast_checked(settle(demand)), [key, by]).filter(
        F.col("_zeros") >= F.col("_demand")
    )
    ranked = thinned.withColumn(
        "_rank", F.row_number().over(Window.partitionBy(key, by).orderBy("_draw", time))
    )
    # The literal limit lets each task drop rows before the shuffle.
    kept = ranked.filter(F.col("_rank") <= max(caps.values()))
    return kept.filter(F.col("_rank") <= F.col("_cap")).select(*df.columns)


def capped_counts(counts: DataFrame, cap_train: int, cap_test: int) -> DataFrame:
    """Row counts that remain after the caps per series."""
    return counts.withColumns(
        {
            "n_train": F.least("n_train", F.lit(cap_train)),
            "n_test": F.least("n_test", F.lit(cap_test)),
        }
    )


def fitting_cap(counts: DataFrame, cap: int, total: int) -> int:
    """The largest cap per series, up to ``cap``, with which all series together have at most ``total`` rows; 1 at least."""
    sizes = settle(counts.groupBy(F.least("n_train", F.lit(cap)).alias("n")).agg(F.count("*").alias("series")))
    held = {r["n"]: r["series"] for r in sizes.collect()}  # one row per size up to the cap
    while cap > 1 and sum(min(n, cap) * series for n, series in held.items()) > total:
        cap -= 1
    return cap


def cap_total(
    counts: DataFrame,
    max_train: int = fixed.MAX_TRAIN,
    max_test: int = fixed.MAX_TEST,
    *,
    key: str = fixed.KEY,
) -> DataFrame:
    """Series to take, in id order, until both row totals are reached.

    The first series are looked at in growing numbers until they hold enough rows. Each adds at least
    one row to either side, so ``max(max_train, max_test)`` of them are always enough; no more ever
    reach the single ordered pass.
    """
    both = counts.filter((F.col("n_train") > 0) & (F.col("n_test") > 0))
    both = settle(both.select(key, "n_train", "n_test"))
    most = max(max_train, max_test)
    look = 1024
    while True:
        first = settle(both.orderBy(key).limit(min(look, most)))
        seen = first.agg(F.count("*"), F.sum("n_train"), F.sum("n_test")).first()
        if look >= most or seen[0] < look or (seen[1] >= max_train and seen[2] >= max_test):
            break
        look *= 8
    before = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    run = first.withColumns(
        {
            "train_before": F.coalesce(F.sum("n_train").over(before), F.lit(0)),
            "test_before": F.coalesce(F.sum("n_test").over(before), F.lit(0)),
        }
    )
    full = (F.col("train_before") >= max_train) & (F.col("test_before") >= max_test)
    return run.filter(~full)


def balanced_sample(
    train: DataFrame,
    per_series: int = fixed.SAMPLE_PER_SERIES,
    total: int = fixed.SAMPLE_TOTAL,
    *,
    seed: int = fixed.SEED,
    key: str = fixed.KEY,
    time: str = fixed.TIME,
) -> DataFrame:
    """At most ``per_series`` rows per series, then ``total`` in all, both in hash order."""
    kept = cap_per_series(
        train.withColumn("_all", F.lit("all")), {"all": per_series}, by="_all", seed=seed, key=key, time=time
    ).drop("_all")
    kept = kept.withColumn("_draw", hash_order([time, key], seed))
    return kept.orderBy("_draw", key, time).limit(total).drop("_draw").orderBy(key, time)


def size_summary(
    df: DataFrame,
    points: Sequence[float] = (0.1, 0.25, 0.5, 0.75, 0.9),
    *,
    key: str = fixed.KEY,
) -> DataFrame:
    """Quantiles of rows per series, linear interpolation, cut to whole rows.

    Sizes are counted before the quantile, so it sees each distinct size once.
    """
    sizes = df.groupBy(key).agg(F.count("*").alias("rows"))
    weighted = sizes.groupBy("rows").agg(F.count("*").alias("series"))
    quantiles = F.percentile("rows", F.array(*[F.lit(p) for p in points]), F.col("series"))
    out = weighted.agg(quantiles.alias("q"))
    return out.select(
        F.explode(
            F.arrays_zip(F.array(*[F.lit(p) for p in points]).alias("point"), F.col("q").alias("rows"))
        ).alias("z")
    ).select("z.point", F.col("z.rows").cast("bigint").alias("rows"))


def restrict_to(df: DataFrame, listed: DataFrame, *, key: str = fixed.KEY) -> DataFrame:
    """Rows of the listed series only. A list is a small stored table, so it is checked for size."""
    return df.join(broadcast_checked(listed.select(key).distinct()), key, "left_semi")


def missing_series(listed: DataFrame, df: DataFrame, *, key: str = fixed.KEY) -> DataFrame:
    """Listed series the panel has no rows of."""
    return listed.select(key).distinct().join(df.select(key).distinct(), key, "left_anti")


def basins(df: DataFrame, *, key: str = fixed.KEY) -> DataFrame:
    return df.select(key).distinct()


