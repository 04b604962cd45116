"""Target encoding of series, training medians and rule-based imputation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet import fixed
from freshet.functions.scalars import is_zero_feature
from freshet.operators.blocks import long_series
from freshet.session import broadcast_checked, settle

EXACT_ROWS = 200_000
_ACCURACY = 100_000


def fit_target_encoding(
    train: DataFrame, target: str, smoothing: float = fixed.SMOOTHING, *, key: str = fixed.KEY
) -> DataFrame:
    """Smoothed mean target per series: (key, n, enc, global_mean).

    The global mean weighs series by their rows, so it comes from the per-series sums.
    """
    sums = train.groupBy(key).agg(F.sum(target).alias("total"), F.count(target).alias("n"))
    sums = settle(sums.filter(F.col("n") > 0))
    mean = sums.agg(F.try_divide(F.sum("total"), F.sum("n"))).scalar()
    out = sums.withColumn("global_mean", F.coalesce(mean, F.lit(0.0)))
    enc = (F.col("total") + F.lit(smoothing) * F.col("global_mean")) / (F.col("n") + F.lit(smoothing))
    return out.select(key, "n", enc.alias("enc"), "global_mean")


def apply_target_encoding(
    df: DataFrame,
    encoding: DataFrame,
    global_mean: Column | float,
    *,
    key: str = fixed.KEY,
    name: str = fixed.ENCODED,
) -> DataFrame:
    """Look the encoding up; a series without one gets the global mean, or 0 if there is none."""
    value = global_mean if isinstance(global_mean, Column) else F.lit(float(global_mean))
    table = encoding.select(key, F.col("enc").alias("_enc"))
    found = df.join(broadcast_checked(table), key, "left")
    return found.withColumn(name, F.coalesce("_enc", value, F.lit(0.0))).drop("_enc")


def train_medians(
    train: DataFrame,
    columns: Sequence[str],
    *,
    key: str = fixed.KEY,
    exact_rows: int = EXACT_ROWS,
) -> DataFrame:
    """Exact median of each column per series, stored; missing values are left out.

    ``median`` holds the distinct values of a group in memory, which fits series up to
    ``exact_rows`` rows. Longer ones go through :func:`_long_medians`: same result, bounded state.
    """
    columns = list(columns)
    long = long_series(train, exact_rows, key=key)
    if long is None:
        return settle(train.groupBy(key).agg(*[F.median(c).alias(c) for c in columns]))
    side = broadcast_checked(long)
    short = train.join(side, key, "left_anti")
    direct = short.groupBy(key).agg(*[F.median(c).alias(c) for c in columns])
    rest = _long_medians(train.join(side, key, "left_semi"), columns, key, exact_rows)
    return settle(direct.unionByName(rest))


def _long_medians(rows: DataFrame, columns: list[str], key: str, exact_rows: int) -> DataFrame:
    """Medians of long series from a narrow bracket around the middle rank.

    A quantile sketch gives values just below and above the middle. Exact counts tell how many rows
    lie below the bracket; only the distinct values inside it are ranked. The bracket reaches
    further than the sketch's error and at least three ranks, so the middle is always inside. A
    column with few values in the series is ranked whole.
    """
    reach = min(0.5, max(2 / _ACCURACY, 4 / exact_rows))
    points = F.array(F.lit(0.5 - reach), F.lit(0.5 + reach))
    sketch = rows.groupBy(key).agg(
        *[
            F.struct(
                F.percentile_approx(c, points, F.lit(_ACCURACY)).alias("q"), F.count(c).alias("n")
            ).alias(c)
            for c in columns
        ]
    )
    bounds = settle(
        sketch.select(
            key,
            *[
                F.when(
                    F.col(c)["n"] > exact_rows,
                    F.struct(
                        F.col(c)["q"][0].cast("double").alias("lo"),
                        F.col(c)["q"][1].cast("double").alias("hi"),
                    ),
                )
                .otherwise(
                    F.struct(F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"))
                )
                .alias(f"_b{i}")
                for i, c in enumerate(columns)
            ],
        )
    )
    joined = rows.select(key, *columns).join(broadcast_checked(bounds), key)
    counts = joined.groupBy(key).agg(
        *[
            F.struct(
                F.count(c).alias("n"), F.count_if(F.col(c) < F.col(f"_b{i}")["lo"]).alias("below")
            ).alias(f"_c{i}")
            for i, c in enumerate(columns)
        ]
    )
    counts = counts.select(
        key,
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(i).alias("i"),
                        F.col(f"_c{i}")["n"].alias("n"),
                        F.col(f"_c{i}")["below"].alias("below"),
                    )
                    for i in range(len(columns))
                ]
            )
        ).alias("c"),
    ).select(key, "c.*")
    inside = F.array_compact(
        F.array(
            *[
                F.when(
                    (F.col(c) >= F.col(f"_b{i}")["lo"]) & (F.col(c) <= F.col(f"_b{i}")["hi"]),
                    F.struct(F.lit(i).alias("i"), F.col(c).cast("double").alias("v")),
                )
                for i, c in enumerate(columns)
            ]
        )
    )
    values = (
        joined.select(key, F.explode(inside).alias("p"))
        .groupBy(key, F.col("p.i").alias("i"), F.col("p.v").alias("v"))
        .agg(F.count("*").alias("times"))
        .join(counts, [key, "i"])
    )
    ordered = Window.partitionBy(key, "i").orderBy("v")
    last = F.col("below") + F.sum("times").over(ordered)
    ranked = values.withColumn("last", last).withColumn("first", F.col("last") - F.col("times") + 1)
    lower = F.floor((F.col("n") + 1) / 2)
    upper = F.floor((F.col("n") + 2) / 2)
    holds = lambda r: (F.col("first") <= r) & (r <= F.col("last"))
    mids = ranked.groupBy(key, "i").agg(
        ((F.max(F.when(holds(lower), F.col("v"))) + F.max(F.when(holds(upper), F.col("v")))) / 2).alias("m")
    )
    wide = mids.groupBy(key).agg(
        *[F.max(F.when(F.col("i") == i, F.col("m"))).alias(c) for i, c in enumerate(columns)]
    )
    return rows.select(key).distinct().join(wide, key, "left")


def impute_rules(
    df: DataFrame, columns: Sequence[str], medians: DataFrame | None, *, key: str = fixed.KEY
) -> DataFrame:
    """Missing lags, rolls, degree-days, deficit and snow become 0, the rest the series' training
    median; a column without any training value stays missing. ``medians`` should be stored."""
    zero = {c: F.coalesce(c, F.lit(0.0)) for c in columns if is_zero_feature(c)}
    rest = [c for c in columns if c not in zero]
    out = df.withColumns(zero) if zero else df
    if not rest or medians is None:
        return out
    table = medians.select(key, *[F.col(c).alias(f"_m_{c}") for c in rest])
    out = out.join(broadcast_checked(table), key, "left")
    return out.withColumns({c: F.coalesce(c, f"_m_{c}") for c in rest}).drop(
        *[f"_m_{c}" for c in rest]
    )


def median_columns(columns: Sequence[str]) -> list[str]:
    return [c for c in columns if not is_zero_feature(c)]
