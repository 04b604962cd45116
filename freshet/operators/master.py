"""The master panel: target rows with their forcings and static attributes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from freshet import fixed
from freshet.functions.scalars import null_negative
from freshet.session import broadcast_checked


def require(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with no missing value in ``columns``."""
    return df.na.drop(subset=list(columns))


def attach_static(
    df: DataFrame, attrs: DataFrame, *, key: str = fixed.KEY, dup_suffix: bool = False
) -> DataFrame:
    """Left join of per-series attributes.

    A name present on both sides is kept from the left, or, with ``dup_suffix``, kept twice as
    ``name_x`` and ``name_y``. The attributes are broadcast if a count shows them small; else the
    join shuffles and AQE splits a hot series.
    """
    both = [c for c in attrs.columns if c != key and c in df.columns]
    if dup_suffix:
        df = df.withColumnsRenamed({c: f"{c}_x" for c in both})
        attrs = attrs.withColumnsRenamed({c: f"{c}_y" for c in both})
    else:
        attrs = attrs.drop(*both)
    return df.join(broadcast_checked(attrs), key, "left")


def build_master(
    target: DataFrame,
    forcings: Sequence[DataFrame],
    attrs: DataFrame | None = None,
    *,
    target_col: str = fixed.TARGET,
    key: str = fixed.KEY,
    time: str = fixed.TIME,
) -> DataFrame:
    """Target rows left-joined with each forcing on (key, time).

    The joins share their keys, so each input is shuffled once and a long series spreads by time.
    Rows without a target go before the joins: nothing joined could bring the target back, and lags
    count surviving rows only.
    """
    out = require(target, [target_col])
    for table in forcings:
        out = out.join(table, [key, time], "left")
    if attrs is not None:
        out = attach_static(out, attrs, key=key)
    cleaned = {c: null_negative(c) for c in fixed.NON_NEGATIVE[:2] if c in out.columns}
    return out.withColumns(cleaned) if cleaned else out


def union_parts(parts: Sequence[DataFrame]) -> DataFrame:
    """All parts as one table; columns a part lacks are NULL."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out
