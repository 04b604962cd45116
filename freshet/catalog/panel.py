"""Master panel, derived columns, lags and rolls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet import fixed
from freshet.catalog import query
from freshet.catalog.fixture import (
    ATTR_NAMES,
    ATTRS_SQL,
    DV,
    F_,
    FEATURE_NAMES,
    INEXACT,
    LAG_NAMES,
    M,
    P,
    SD_MANY,
    attributes,
    features,
    master,
    r,
    rounded,
    series,
    table,
    with_,
)
from freshet.functions.scalars import unlog
from freshet.operators.features import (
    add_deficit,
    add_degree_days,
    add_lags,
    add_mean_temp,
    add_rolls,
    add_target,
    lag_columns,
    roll_columns,
)
from freshet.operators.blocks import over_series
from freshet.operators.master import attach_static, build_master, require
from freshet.operators.split import basins
from freshet.plans.panel import bucketed_feature_panel
from freshet.session import scratch_path
from freshet.sources.buckets import write_buckets

KEYS = [fixed.KEY, fixed.TIME]


@query(
    "master_join",
    with_(
        *M, ("ats", ATTRS_SQL),
        select="SELECT m.*, area_sites, elev_gauge, slope_class FROM m LEFT JOIN ats USING (basin_id)",
    ),
)
def master_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target joined with one table per forcing, then with the attributes."""
    target, *forcings = _inputs(spark, sf_dir)
    return build_master(target, forcings, attributes(spark, sf_dir))


def _inputs(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The target's table and one table per forcing."""
    rows = series(spark, sf_dir)
    return [rows.select(*KEYS, fixed.TARGET), *[rows.select(*KEYS, c).filter(F.col(c).isNotNull()) for c in fixed.FORCINGS]]


@query(
    "bucketed_master_join",
    with_(
        *M, ("ats", ATTRS_SQL),
        select="SELECT m.*, area_sites, elev_gauge, slope_class FROM m LEFT JOIN ats USING (basin_id)",
    ),
)
def bucketed_master_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over tables stored in buckets, whose joins need no exchange."""
    folder = scratch_path(spark, "buckets")
    stored = [write_buckets(t, f"{folder}/{i}") for i, t in enumerate(_inputs(spark, sf_dir))]
    return build_master(stored[0], stored[1:], attributes(spark, sf_dir))


@query(
    "static_join_suffixes",
    with_(
        *M,
        ("ats", ATTRS_SQL),
        ("a", "SELECT m.basin_id, date, discharge_mm, area_sites, slope_class FROM m LEFT JOIN ats USING (basin_id)"),
        select="SELECT a.basin_id, date, discharge_mm, a.area_sites AS area_sites_x, a.slope_class AS slope_class_x, "
        "ats.area_sites AS area_sites_y, elev_gauge, ats.slope_class AS slope_class_y FROM a LEFT JOIN ats USING (basin_id)",
    ),
)
def static_join_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes attached twice, as the stored feature order of a released model expects."""
    attrs = attributes(spark, sf_dir)
    once = attach_static(master(spark, sf_dir), attrs.drop("elev_gauge")).select(
        *KEYS, fixed.TARGET, "area_sites", "slope_class"
    )
    return attach_static(once, attrs, dup_suffix=True)


@query(
    "derived_columns",
    with_(
        *DV,
        select="SELECT basin_id, date, prcp_mm_cr2met, pet_mm_hargreaves, "
        + ", ".join(r(c, c) for c in ("tmean_c", "deficit", "dd_above0", "dd_above5", "y", "y_log1p"))
        + f", {r('exp(y_log1p) - 1', 'y_back')} FROM dv",
    ),
)
def derived_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = add_target(add_degree_days(add_deficit(add_mean_temp(master(spark, sf_dir)))))
    rows = rows.withColumn("y_back", unlog("y_log1p"))
    return rounded(rows.drop(fixed.TARGET, fixed.TMIN, fixed.TMAX))


@query(
    "complete_rows",
    with_(
        *M,
        select="SELECT basin_id, date, prcp_mm_cr2met, pet_mm_hargreaves FROM m "
        "WHERE prcp_mm_cr2met IS NOT NULL AND pet_mm_hargreaves IS NOT NULL",
    ),
)
def complete_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = require(master(spark, sf_dir), [fixed.PRECIP, fixed.PET])
    return rows.select(*KEYS, fixed.PRECIP, fixed.PET)


@query("lags", with_(*P, select=f"SELECT basin_id, date, {', '.join(r(c, c) for c in LAG_NAMES)} FROM p"))
def lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = add_lags(add_mean_temp(master(spark, sf_dir)))
    return rows.select(*KEYS, *LAG_NAMES)


@query(
    "lags_without_target",
    with_(*P, select="SELECT basin_id, date, prcp_mm_cr2met_lag1, pet_mm_hargreaves_lag14 FROM p"),
)
def lags_without_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = add_lags(master(spark, sf_dir), target_lags=False)
    assert not any(c.startswith(f"{fixed.TARGET}_lag") for c in rows.columns)
    return rows.select(*KEYS, "prcp_mm_cr2met_lag1", "pet_mm_hargreaves_lag14")


def _names(column: str, sizes: list[int], how: str) -> list[str]:
    return [f"{column}_{how}_{n}d" for n in sizes]


@query(
    "rolling_sums",
    with_(
        *P,
        select="SELECT basin_id, date, " + ", ".join(r(c, c) for c in _names(fixed.PRECIP, fixed.PRECIP_SUMS, "sum")) + " FROM p",
    ),
)
def rolling_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = add_rolls(master(spark, sf_dir), fixed.PRECIP, fixed.PRECIP_SUMS, "sum")
    return rows.select(*KEYS, *_names(fixed.PRECIP, fixed.PRECIP_SUMS, "sum"))


@query(
    "rolling_means",
    with_(
        *P,
        select="SELECT basin_id, date, " + ", ".join(r(c, c) for c in _names(fixed.PRECIP, fixed.PRECIP_MEANS, "mean")) + " FROM p",
    ),
)
def rolling_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = add_rolls(master(spark, sf_dir), fixed.PRECIP, fixed.PRECIP_MEANS, "mean")
    return rounded(rows.select(*KEYS, *_names(fixed.PRECIP, fixed.PRECIP_MEANS, "mean")))


@query(
    "feature_panel",
    with_(
        *F_,
        select="SELECT basin_id, date, " + ", ".join(r(c, c) for c in [*FEATURE_NAMES, "y", "y_log1p"]) + " FROM f",
    ),
)
def feature_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features(spark, sf_dir).select(*KEYS, *FEATURE_NAMES, "y", "y_log1p")
    return rounded(rows, only=INEXACT)


@query(
    "bucketed_feature_panel",
    with_(
        *F_,
        select="SELECT basin_id, date, " + ", ".join(r(c, c) for c in [*FEATURE_NAMES, "y", "y_log1p"]) + " FROM f",
    ),
)
def bucketed_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From one table per variable to the features, every step stored in buckets."""
    rows = bucketed_feature_panel(_inputs(spark, sf_dir), scratch_path(spark, "buckets"), attributes(spark, sf_dir))
    return rounded(rows.select(*KEYS, *FEATURE_NAMES, "y", "y_log1p"), only=INEXACT)


MANY_NAMES = [n for n in FEATURE_NAMES if n not in ATTR_NAMES]


@query(
    "feature_panel_many_series",
    with_(
        SD_MANY,
        *P[1:],
        select="SELECT basin_id, date, " + ", ".join(r(c, c) for c in [*MANY_NAMES, "y", "y_log1p"]) + " FROM p",
    ),
)
def feature_panel_many_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All features over one series per supplier: many short series."""
    rows = features(spark, sf_dir, attrs=False, per="s_suppkey")
    return rounded(rows.select(*KEYS, *MANY_NAMES, "y", "y_log1p"), only=INEXACT)


EVENT_FRAME = "PARTITION BY event_type ORDER BY ts, event_id"


@query(
    "long_series_windows",
    f"""
SELECT event_id, event_type, {r('lag(value, 1) OVER w', 'value_lag1')}, {r('lag(value, 30) OVER w', 'value_lag30')},
  {r(f'sum(value) OVER ({EVENT_FRAME} ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING)', 'value_sum_14d', 4)},
  {r(f'avg(value) OVER ({EVENT_FRAME} ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)', 'value_mean_7d', 4)}
FROM events WINDOW w AS ({EVENT_FRAME})
""",
)
def long_series_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few series with a large share of all rows each, cut into blocks of a hundred rows."""

    def build(rows: DataFrame, w) -> DataFrame:
        return rows.select(
            "*",
            *lag_columns(w, "value", [1, 30]),
            *roll_columns(w, "value", [14], "sum"),
            *roll_columns(w, "value", [7], "mean"),
        )

    rows = over_series(
        table(spark, sf_dir, "events").select("event_id", "event_type", "ts", "value"),
        build,
        halo=30,
        key="event_type",
        time="ts",
        order=("event_id",),
        block_rows=100,
    )
    rows = rounded(rows.drop("ts", "value"))
    return rows.withColumns({c: F.round(c, 4) for c in ("value_sum_14d", "value_mean_7d")})


@query("sorted_panel", with_(*M, select="SELECT * FROM m ORDER BY basin_id, date"))
def sorted_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return master(spark, sf_dir).orderBy(*KEYS)


@query("distinct_series", with_(*M, select="SELECT DISTINCT basin_id FROM m"))
def distinct_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return basins(master(spark, sf_dir))
