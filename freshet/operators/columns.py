"""Column-wise operators: which columns count as features, and in what order."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from freshet import fixed
from freshet.functions.scalars import is_core_name
from freshet.session import broadcast_checked, settle


def numeric_features(df: DataFrame, reserved: Sequence[str] = fixed.RESERVED) -> list[str]:
    """Numeric (or boolean) columns that are neither keys nor forms of the target."""
    return [
        f.name
        for f in df.schema.fields
        if f.name not in reserved and isinstance(f.dataType, (T.NumericType, T.BooleanType))
    ]


def present_features(columns: Sequence[str], candidates: Sequence[str] = fixed.CANDIDATES) -> list[str]:
    found = [c for c in candidates if c in columns]
    if not found:
        raise ValueError(f"none of the columns {list(candidates)} is present")
    return found


def core_features(columns: Sequence[str]) -> list[str]:
    """Names that match a core pattern, in their given order, once each."""
    return [c for c in dict.fromkeys(columns) if any(re.match(p, c) for p in fixed.CORE_PATTERNS)]


def feature_order(columns: Sequence[str], common: Sequence[str]) -> list[str]:
    """Fixed column order of the global model: sorted core ∩ common names, the encoding last."""
    base = sorted(set(core_features(columns)) & set(common))
    if not base:
        raise ValueError("no core feature is common to the series")
    return [*base, fixed.ENCODED]


def ensure_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Add the columns that are absent, as NULL."""
    lacking = {c: F.lit(None).cast("double") for c in columns if c not in df.columns}
    return df.withColumns(lacking) if lacking else df


def non_null_counts(df: DataFrame, columns: Sequence[str], *, key: str = fixed.KEY) -> DataFrame:
    """(key, column, n): values per series and column. Wide aggregate first, then one row unpivots."""
    wide = df.groupBy(key).agg(*[F.count(c).alias(c) for c in columns])
    return wide.unpivot(key, list(columns), "column", "n")


def common_features(df: DataFrame, columns: Sequence[str], *, key: str = fixed.KEY) -> DataFrame:
    """Features that every series has a value of, as (column) rows; series without any value don't count.

    One mark per series and column, combined before the shuffle, then one aggregate over the marks.
    """
    marks = df.groupBy(key).agg(*[F.coalesce(F.bool_or(F.col(c).isNotNull()), F.lit(False)).alias(c) for c in columns])
    any_value = F.lit(False)
    for c in columns:
        any_value = any_value | F.col(c)
    everywhere = marks.filter(any_value).agg(*[F.bool_and(c).alias(c) for c in columns])
    return everywhere.unpivot([], list(columns), "column", "everywhere").filter("everywhere").select("column")


def select_core(names: DataFrame, column: str = "column") -> DataFrame:
    """Rows of a name table that match a core pattern."""
    return names.filter(is_core_name(column))


def exclude_columns(
    df: DataFrame,
    exclusions: DataFrame,
    columns: Sequence[str],
    *,
    fill: float | None = 0.0,
    key: str = fixed.KEY,
) -> DataFrame:
    """Set the excluded columns of a series to ``fill``: 0 for the global model, NULL to drop them.

    ``exclusions`` holds (key, column). A series has at most one entry per column, so its list is
    bounded by the table's width.
    """
    lists = exclusions.groupBy(key).agg(F.collect_set("column").alias("_excluded"))
    out = df.join(broadcast_checked(settle(lists)), key, "left")
    hit = lambda c: F.coalesce(F.array_contains("_excluded", F.lit(c)), F.lit(False))
    value = F.lit(fill).cast("double")
    return out.withColumns(
        {c: F.when(hit(c), value).otherwise(F.col(c)) for c in columns}
    ).drop("_excluded")
