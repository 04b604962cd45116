"""Raw files to feature panel, with the master panel stored in between.

Storing the master pays: the feature windows plan on counts of it, and every later stage reads it
with column pruning instead of repeating the joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from freshet import fixed
from freshet.operators.blocks import window_columns
from freshet.operators.features import build_features
from freshet.operators.master import build_master
from freshet.sources.buckets import write_buckets
from freshet.sources.ledger import Ledger
from freshet.sources.tables import read_panel, write_panel
from freshet.sources.wide import read_attributes, read_wide


def master_from_files(
    spark: SparkSession,
    target: str,
    forcings: dict[str, str],
    attributes: str | None = None,
    *,
    target_col: str = fixed.TARGET,
    sep: str = "\t",
    fallback: str | None = None,
    ledgers: dict[str, Ledger] | None = None,
) -> DataFrame:
    """Master panel of wide files; ``forcings`` maps a variable to its file.

    ``ledgers`` is filled with one ledger per file; they hold counts once the panel has been written.
    """
    ledgers = {} if ledgers is None else ledgers
    ledgers.update({name: Ledger(path) for name, path in {target_col: target, **forcings}.items()})
    read = lambda path, name: read_wide(spark, path, name, sep=sep, fallback=fallback, ledger=ledgers[name])
    attrs = None if attributes is None else read_attributes(spark, attributes, sep=sep)
    return build_master(
        read(target, target_col),
        [read(path, name) for name, path in forcings.items()],
        attrs,
        target_col=target_col,
    )


def feature_panel(
    spark: SparkSession,
    master: DataFrame,
    master_path: str,
    features_path: str,
    attrs: DataFrame | None = None,
    ledgers: dict[str, Ledger] | None = None,
) -> DataFrame:
    """Store the master, build the features from it, store them, and return the stored panel.

    With the ``ledgers`` of the files behind the master, a file without any readable date is an error.
    """
    write_panel(master, master_path)
    for ledger in (ledgers or {}).values():
        ledger.check()
    write_panel(build_features(read_panel(spark, master_path), attrs), features_path)
    return read_panel(spark, features_path)


def bucketed_feature_panel(
    inputs: Sequence[DataFrame], folder: str, attrs: DataFrame | None = None, *, target_col: str = fixed.TARGET, buckets: int | None = None
) -> DataFrame:
    """Feature panel of the target's table and the forcings' tables, with every step stored in buckets.

    Each input is exchanged once, when it is written. The joins of the master need no exchange, and neither do the
    windows unless a series is so long that it has to be cut into blocks.
    """
    stored = [write_buckets(t, f"{folder}/input-{i}", buckets=buckets) for i, t in enumerate(inputs)]
    master = build_master(stored[0], stored[1:], target_col=target_col)
    held = write_buckets(master, f"{folder}/master", by=window_columns(master), buckets=buckets)
    return build_features(held, attrs)
