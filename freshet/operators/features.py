"""Leak-free features of a daily panel: lags, rolling sums and means, deficit, degree-days, target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from freshet import fixed
from freshet.functions.scalars import degree_days, log_target, null_negative
from freshet.operators.blocks import BLOCK_ROWS, over_series
from freshet.operators.master import attach_static


def lag_columns(w: WindowSpec, column: str, lags: list[int]) -> list[Column]:
    """Value k surviving rows earlier (positions, not calendar days)."""
    return [F.lag(column, k).over(w).alias(f"{column}_lag{k}") for k in lags]


def roll_columns(w: WindowSpec, column: str, sizes: list[int], how: str = "sum") -> list[Column]:
    """Sum or mean of the ``size`` rows before the current one; missing cells are left out."""
    agg = {"sum": F.sum, "mean": F.avg}[how]
    return [
        agg(column).over(w.rowsBetween(-n, -1)).alias(f"{column}_{how}_{n}d") for n in sizes
    ]


def add_lags(
    df: DataFrame,
    lags: dict[str, list[int]] | None = None,
    *,
    target_lags: bool = True,
    key: str = fixed.KEY,
    time: str = fixed.TIME,
    order: tuple[str, ...] = (),
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Lags per series; variables that are absent are skipped."""
    table = _present_lags(df, fixed.LAGS if lags is None else lags, target_lags)

    def build(rows: DataFrame, w: WindowSpec) -> DataFrame:
        return rows.select("*", *[c for v, ks in table.items() for c in lag_columns(w, v, ks)])

    halo = max((k for ks in table.values() for k in ks), default=1)
    return over_series(
        df, build, halo=halo, key=key, time=time, order=order, block_rows=block_rows
    )


def add_rolls(
    df: DataFrame,
    column: str,
    sizes: list[int],
    how: str = "sum",
    *,
    key: str = fixed.KEY,
    time: str = fixed.TIME,
    order: tuple[str, ...] = (),
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    def build(rows: DataFrame, w: WindowSpec) -> DataFrame:
        return rows.select("*", *roll_columns(w, column, sizes, how))

    return over_series(
        df, build, halo=max(sizes), key=key, time=time, order=order, block_rows=block_rows
    )


def add_mean_temp(df: DataFrame) -> DataFrame:
    """Mean temperature from the extremes, where the panel has none."""
    if fixed.TMEAN in df.columns or not {fixed.TMIN, fixed.TMAX} <= set(df.columns):
        return df
    return df.withColumn(fixed.TMEAN, (F.col(fixed.TMIN) + F.col(fixed.TMAX)) / 2)


def null_negatives(df: DataFrame, columns: list[str] = fixed.NON_NEGATIVE) -> DataFrame:
    present = {c: null_negative(c) for c in columns if c in df.columns}
    return df.withColumns(present) if present else df


def add_deficit(df: DataFrame) -> DataFrame:
    """Evaporative demand minus precipitation; without a precipitation column, the demand alone."""
    if fixed.PET not in df.columns:
        return df
    rain = F.col(fixed.PRECIP) if fixed.PRECIP in df.columns else F.lit(0.0)
    return df.withColumn("deficit", F.col(fixed.PET) - rain)


def add_degree_days(df: DataFrame) -> DataFrame:
    if fixed.TMEAN not in df.columns:
        return df
    return df.withColumns(
        {f"dd_above{b}": degree_days(fixed.TMEAN, b) for b in fixed.DEGREE_DAY_BASES}
    )


def add_target(df: DataFrame, target: str = fixed.TARGET) -> DataFrame:
    if target not in df.columns:
        return df
    y = F.col(target).cast("double")
    return df.withColumns({"y": y, "y_log1p": log_target(y)})


def build_features(
    master: DataFrame,
    attrs: DataFrame | None = None,
    *,
    target_lags: bool = True,
    dup_suffix: bool = False,
    key: str = fixed.KEY,
    time: str = fixed.TIME,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Feature panel of a master panel.

    Derived columns are projected first, so that all lags and rolls share one window: one exchange
    and one sort for the whole feature set.
    """
    df = add_degree_days(add_deficit(null_negatives(add_mean_temp(master))))
    lags = _present_lags(df, fixed.LAGS, target_lags)
    rolls = [
        (fixed.PRECIP, fixed.PRECIP_SUMS, "sum"),
        (fixed.PRECIP, fixed.PRECIP_MEANS, "mean"),
        ("deficit", fixed.DEFICIT_SUMS, "sum"),
        *[(f"dd_above{b}", fixed.DEGREE_DAY_SUMS, "sum") for b in fixed.DEGREE_DAY_BASES],
    ]
    rolls = [r for r in rolls if r[0] in df.columns]

    def build(rows: DataFrame, w: WindowSpec) -> DataFrame:
        added = [c for v, ks in lags.items() for c in lag_columns(w, v, ks)]
        added += [c for v, sizes, how in rolls for c in roll_columns(w, v, sizes, how)]
        return rows.select("*", *added)

    reach = [k for ks in lags.values() for k in ks] + [n for _, sizes, _ in rolls for n in sizes]
    df = over_series(
        df, build, halo=max(reach, default=1), key=key, time=time, block_rows=block_rows
    )
    if attrs is not None:
        df = attach_static(df, attrs, key=key, dup_suffix=dup_suffix)
    return add_target(df)


def _present_lags(df: DataFrame, lags: dict[str, list[int]], target_lags: bool):
    return {
        v: ks
        for v, ks in lags.items()
        if v in df.columns and (target_lags or v != fixed.TARGET)
    }
