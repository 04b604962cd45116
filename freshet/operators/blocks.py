"""Ordered windows over series of any length.

``lag`` and ``rowsBetween`` frames need the rows of one series in order, which in plain form puts a
whole series into one task. Here a series longer than ``block_rows`` is cut into consecutive blocks;
each block also carries the few rows before it that its frames reach back to. The window then runs
per (series, block), so one hot series spreads over many tasks and every value stays the same.

Planning reads only the key and time columns: a count per series, and, for long series alone, a
count per time slot. With no long series the plan is the plain one: one exchange, one window.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from freshet import fixed
from freshet.session import broadcast_checked, settle

BLOCK_ROWS = 200_000

_BLOCK = "_block"
_CARRIED = "_carried"
_SLOT = "_slot"


def long_series(df: DataFrame, rows: int, *, key: str = fixed.KEY) -> DataFrame | None:
    """Keys with more than ``rows`` rows, stored; None if there are none."""
    sizes = df.groupBy(key).agg(F.count("*").alias("n"))
    if (sizes.agg(F.max("n")).first()[0] or 0) <= rows:
        return None
    return settle(sizes.filter(F.col("n") > rows).select(key))


def window_columns(df: DataFrame, *, key: str = fixed.KEY, time: str = fixed.TIME, block_rows: int = BLOCK_ROWS) -> list[str]:
    """Columns to store a panel by for its windows: the key, or key and time where a series is too long for a task."""
    return [key] if long_series(df, block_rows, key=key) is None else [key, time]


def _slot(time: str, unit: str | None) -> Column:
    return F.col(time) if unit is None else F.date_trunc(unit, F.col(time))


def _slot_counts(df: DataFrame, long: DataFrame, key: str, time: str, block_rows: int):
    """Rows per (key, slot) of the long series, and the unit of the slots.

    A slot is the smallest piece a block is made of: for timestamps an hour, or a finer unit where
    an hour alone is longer than a block; for dates the day.
    """
    rows = df.select(key, time).join(broadcast_checked(long), key, "left_semi")
    fine = isinstance(df.schema[time].dataType, (T.TimestampType, T.TimestampNTZType))
    for unit in (["hour", "minute", "second"] if fine else []):
        counts = settle(rows.groupBy(key, _slot(time, unit).alias(_SLOT)).agg(F.count("*").alias("n")))
        if counts.agg(F.max("n")).first()[0] <= block_rows:
            return counts, unit
    return settle(rows.groupBy(key, F.col(time).alias(_SLOT)).agg(F.count("*").alias("n"))), None


def _slot_blocks(counts: DataFrame, key: str, halo: int, block_rows: int) -> DataFrame:
    """(key, slot) -> own block, and all blocks the slot's rows are needed in."""
    by_slot = Window.partitionBy(key).orderBy(_SLOT)
    slots = counts.withColumn("end", F.sum("n").over(by_slot))
    slots = slots.withColumn("own", F.floor((F.col("end") - F.col("n")) / F.lit(block_rows)))
    slots = slots.withColumn("next", F.lead("own").over(by_slot))
    # A later block starts where some slot ends; it needs every slot that ends less than `halo`
    # rows before that start.
    reach = Window.partitionBy(key).orderBy("end").rangeBetween(0, halo - 1)
    needed = F.array_union(F.array("own"), F.collect_set("next").over(reach))
    return slots.select(key, _SLOT, "own", needed.alias("blocks"))


def over_series(
    df: DataFrame,
    build: Callable[[DataFrame, WindowSpec], DataFrame],
    *,
    halo: int,
    key: str = fixed.KEY,
    time: str = fixed.TIME,
    order: tuple[str, ...] = (),
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Apply ``build(df, window)`` to ordered series.

    ``halo`` is how many earlier rows a frame may reach back to; ``order`` holds tie-break columns
    after ``time``. Rows with equal time always share a block.
    """
    long = long_series(df, block_rows, key=key)
    if long is None:
        return build(df, Window.partitionBy(key).orderBy(time, *order))
    counts, unit = _slot_counts(df, long, key, time, block_rows)
    slots = settle(_slot_blocks(counts, key, max(halo, 1), block_rows))
    rows = (
        df.withColumn(_SLOT, _slot(time, unit))
        .join(broadcast_checked(slots), [key, _SLOT], "left")
        .withColumn(_BLOCK, F.explode(F.coalesce("blocks", F.array(F.lit(0).cast("bigint")))))
        .withColumn(_CARRIED, F.coalesce(F.col(_BLOCK) != F.col("own"), F.lit(False)))
        .drop(_SLOT, "own", "blocks")
    )
    built = build(rows, Window.partitionBy(key, _BLOCK).orderBy(time, *order))
    return built.filter(~F.col(_CARRIED)).drop(_BLOCK, _CARRIED)
