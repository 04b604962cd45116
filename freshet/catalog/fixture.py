"""Daily series over the given tables, as DataFrames and as SQL texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet import fixed
from freshet.functions.scalars import log_target
from freshet.operators.blocks import over_series
from freshet.operators.diagnose import diagnose
from freshet.operators.features import build_features, null_negatives
from freshet.operators.master import require
from freshet.operators.metrics import (
    bottom_n,
    persistence,
    persistence_nse,
    regression_metrics,
    split_metrics,
)
from freshet.operators.policy import suggest_retrained
from freshet.operators.split import restrict_to, side
from freshet.session import settle, store

SPLIT = "1999-01-01"

SERIES_SQL = """
SELECT CAST(s.s_nationkey AS STRING) AS basin_id, CAST(l.l_shipdate AS DATE) AS date,
  CAST(sum(CAST(l.l_quantity AS BIGINT)) FILTER (WHERE l.l_linenumber <> 7) AS DOUBLE) AS discharge_mm,
  CAST(sum(CAST(l.l_quantity AS BIGINT)) FILTER (WHERE l.l_returnflag = 'R') - 5 AS DOUBLE) AS prcp_mm_cr2met,
  CAST(min(CAST(round(l.l_discount * 100) AS BIGINT)) - 2 AS DOUBLE) AS tmin_c,
  CAST(max(CAST(round(l.l_discount * 100) AS BIGINT)) + max(CAST(round(l.l_tax * 100) AS BIGINT)) AS DOUBLE) AS tmax_c,
  CAST(sum(CAST(round(l.l_tax * 100) AS BIGINT)) - 1 AS DOUBLE) AS pet_mm_hargreaves
FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey
GROUP BY s.s_nationkey, CAST(l.l_shipdate AS DATE)
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def series(spark: SparkSession, sf_dir: str, *, per: str = "s_nationkey") -> DataFrame:
    """One row per series and day: target and forcings, some missing, some negative."""
    lines, suppliers = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    rows = lines.join(suppliers, lines["l_suppkey"] == suppliers["s_suppkey"])
    quantity = F.col("l_quantity").cast("bigint")
    discount = F.rint(F.col("l_discount") * 100).cast("bigint")
    tax = F.rint(F.col("l_tax") * 100).cast("bigint")
    return rows.groupBy(
        F.col(per).cast("string").alias(fixed.KEY), F.col("l_shipdate").cast("date").alias(fixed.TIME)
    ).agg(
        F.sum(F.when(F.col("l_linenumber") != 7, quantity)).cast("double").alias(fixed.TARGET),
        (F.sum(F.when(F.col("l_returnflag") == "R", quantity)) - 5).cast("double").alias(fixed.PRECIP),
        (F.min(discount) - 2).cast("double").alias(fixed.TMIN),
        (F.max(discount) + F.max(tax)).cast("double").alias(fixed.TMAX),
        (F.sum(tax) - 1).cast("double").alias(fixed.PET),
    )


def master(spark: SparkSession, sf_dir: str, *, per: str = "s_nationkey") -> DataFrame:
    """Stored master panel: target rows only, impossible negatives missing."""
    return store(null_negatives(require(series(spark, sf_dir, per=per), [fixed.TARGET])), "master")


def attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per series: supplier count, mean balance in whole units, region."""
    suppliers, nations = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    rows = suppliers.join(nations, suppliers["s_nationkey"] == nations["n_nationkey"])
    return rows.groupBy(F.col("s_nationkey").cast("string").alias(fixed.KEY)).agg(
        F.count("*").cast("double").alias("area_sites"),
        F.floor(F.max("s_acctbal")).cast("double").alias("elev_gauge"),
        F.max("n_regionkey").cast("double").alias("slope_class"),
    )


def features(
    spark: SparkSession, sf_dir: str, *, attrs: bool = True, per: str = "s_nationkey"
) -> DataFrame:
    static = attributes(spark, sf_dir) if attrs else None
    return build_features(master(spark, sf_dir, per=per), static)


def smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Autocorrelated target (30-row sum) with a forecast of a quality that differs by series."""
    rows = store(require(series(spark, sf_dir), [fixed.TARGET]), "series")

    def build(part: DataFrame, w) -> DataFrame:
        part = part.withColumn(fixed.TARGET, F.sum(fixed.TARGET).over(w.rowsBetween(-29, 0)))
        part = part.withColumn("y_log1p", log_target(fixed.TARGET))
        pick = F.col(fixed.KEY).cast("int") % 3
        guess = (
            F.when(pick == 0, F.lag("y_log1p", 1).over(w))
            .when(pick == 1, F.avg("y_log1p").over(w.rowsBetween(-7, -1)))
            .otherwise(F.lag("y_log1p", 30).over(w))
        )
        snow = F.when(F.col(fixed.PRECIP) > 40, F.col(fixed.PRECIP))
        return part.withColumns({"yhat": guess, fixed.SWE: snow})

    return store(over_series(rows, build, halo=60), "smooth")


CHECKED = [fixed.PRECIP, fixed.PET, fixed.SWE]


def metrics(rows: DataFrame) -> DataFrame:
    """Train and test scores of the forecast, one row per series."""
    sided = rows.withColumn("side", side(split_date=SPLIT))
    counts = rows.groupBy(fixed.KEY).agg(F.count("*").alias("rows"))
    return settle(split_metrics(sided, "y_log1p", "yhat").join(counts, fixed.KEY))


def summary(rows: DataFrame) -> DataFrame:
    return settle(diagnose(rows, split_date=SPLIT, columns=CHECKED))


def retrained(rows: DataFrame, scores: DataFrame, n: int = 12) -> DataFrame:
    """Scores of a second forecast for the n worst series, with persistence and a suggestion."""
    worst = settle(bottom_n(scores, n).select(fixed.KEY))
    listed = restrict_to(rows, worst)
    previous = persistence(listed, "y_log1p", SPLIT)
    first = listed.select(fixed.KEY, fixed.TIME, F.col("yhat").alias("guess"))
    tested = previous.join(first, [fixed.KEY, fixed.TIME])
    tested = tested.withColumn("yhat2", (F.col("yhat") + F.col("guess")) / 2)
    new = regression_metrics(tested, "y", "yhat2").select(
        fixed.KEY, *[F.col(c).alias(f"test_{c}") for c in ("R2", "RMSE", "MAE")]
    )
    out = new.join(persistence_nse(previous), fixed.KEY, "left")
    return settle(out.withColumn("suggested_serving", suggest_retrained()))


def rounded(df: DataFrame, places: int = 6, only: list[str] | None = None) -> DataFrame:
    """Fractional columns rounded, so that sums taken in another order compare equal."""
    changed = {
        n: F.round(n, places)
        for n, kind in df.dtypes
        if kind == "double" and (only is None or n in only)
    }
    return df.withColumns(changed) if changed else df


# ---- SQL texts -------------------------------------------------------------------------------


def r(expr: str, name: str, places: int = 6) -> str:
    """Rounded column; the added zero turns a negative zero positive."""
    return f"round(CAST({expr} AS DOUBLE), {places}) + 0.0 AS {name}"


def with_(*parts: tuple[str, str], select: str) -> str:
    return "WITH " + ",\n".join(f"{n} AS ({body})" for n, body in parts) + "\n" + select


MASTER_SQL = """
SELECT basin_id, date, discharge_mm,
  CASE WHEN prcp_mm_cr2met < 0 THEN NULL ELSE prcp_mm_cr2met END AS prcp_mm_cr2met, tmin_c, tmax_c,
  CASE WHEN pet_mm_hargreaves < 0 THEN NULL ELSE pet_mm_hargreaves END AS pet_mm_hargreaves
FROM sd WHERE discharge_mm IS NOT NULL
"""

DERIVED_SQL = """
SELECT *, pet_mm_hargreaves - prcp_mm_cr2met AS deficit,
  CASE WHEN tmean_c < 0 THEN 0.0 ELSE tmean_c END AS dd_above0,
  CASE WHEN tmean_c - 5 < 0 THEN 0.0 ELSE tmean_c - 5 END AS dd_above5,
  discharge_mm AS y, ln(1 + greatest(discharge_mm, 0)) AS y_log1p
FROM (SELECT *, (tmin_c + tmax_c) / 2 AS tmean_c FROM m)
"""


def _lag_sql(v: str, k: int) -> str:
    return f"lag({v}, {k}) OVER (PARTITION BY basin_id ORDER BY date) AS {v}_lag{k}"


def _roll_sql(v: str, n: int, how: str) -> str:
    call = {"sum": "sum", "mean": "avg"}[how]
    frame = f"PARTITION BY basin_id ORDER BY date ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING"
    return f"{call}({v}) OVER ({frame}) AS {v}_{how}_{n}d"


ROLLS = [
    (fixed.PRECIP, fixed.PRECIP_SUMS, "sum"),
    (fixed.PRECIP, fixed.PRECIP_MEANS, "mean"),
    ("deficit", fixed.DEFICIT_SUMS, "sum"),
    ("dd_above0", fixed.DEGREE_DAY_SUMS, "sum"),
    ("dd_above5", fixed.DEGREE_DAY_SUMS, "sum"),
]
LAGGED = {v: ks for v, ks in fixed.LAGS.items() if v != fixed.SWE}
LAG_NAMES = [f"{v}_lag{k}" for v, ks in LAGGED.items() for k in ks]
ROLL_NAMES = [f"{v}_{how}_{n}d" for v, ns, how in ROLLS for n in ns]
ATTR_NAMES = ["area_sites", "elev_gauge", "slope_class"]
# Of the feature columns only these are not whole or half numbers.
INEXACT = [f"{fixed.PRECIP}_mean_{n}d" for n in fixed.PRECIP_MEANS] + ["y_log1p"]
RAW_NAMES = [fixed.PRECIP, fixed.TMIN, fixed.TMAX, fixed.PET]
FEATURE_NAMES = [
    *RAW_NAMES, fixed.TMEAN, "deficit", "dd_above0", "dd_above5", *LAG_NAMES, *ROLL_NAMES, *ATTR_NAMES
]

PANEL_SQL = (
    "SELECT *, "
    + ", ".join([_lag_sql(v, k) for v, ks in LAGGED.items() for k in ks])
    + ", "
    + ", ".join([_roll_sql(v, n, how) for v, ns, how in ROLLS for n in ns])
    + " FROM dv"
)

ATTRS_SQL = """
SELECT CAST(s_nationkey AS STRING) AS basin_id, CAST(count(*) AS DOUBLE) AS area_sites,
  CAST(floor(max(s_acctbal)) AS DOUBLE) AS elev_gauge, CAST(max(n_regionkey) AS DOUBLE) AS slope_class
FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY s_nationkey
"""

FEATURES_SQL = "SELECT p.*, area_sites, elev_gauge, slope_class FROM p LEFT JOIN ats USING (basin_id)"

SMOOTH_SQL = """
SELECT *, CASE WHEN prcp_mm_cr2met > 40 THEN prcp_mm_cr2met END AS swe_mm,
  CASE WHEN CAST(basin_id AS INT) % 3 = 0 THEN lag(y_log1p, 1) OVER w
  WHEN CAST(basin_id AS INT) % 3 = 1
    THEN avg(y_log1p) OVER (PARTITION BY basin_id ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)
  ELSE lag(y_log1p, 30) OVER w END AS yhat
FROM (
  SELECT * REPLACE (sm AS discharge_mm), ln(1 + greatest(sm, 0)) AS y_log1p
  FROM (SELECT *, sum(discharge_mm) OVER (PARTITION BY basin_id ORDER BY date
          ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS sm FROM sd WHERE discharge_mm IS NOT NULL))
WINDOW w AS (PARTITION BY basin_id ORDER BY date)
"""

SD = ("sd", SERIES_SQL)
SD_MANY = ("sd", SERIES_SQL.replace("s.s_nationkey", "s.s_suppkey"))
M = [SD, ("m", MASTER_SQL)]
DV = [*M, ("dv", DERIVED_SQL)]
P = [*DV, ("p", PANEL_SQL)]
F_ = [*P, ("ats", ATTRS_SQL), ("f", FEATURES_SQL)]
SM = [SD, ("sm", SMOOTH_SQL)]

TRAIN = f"date < DATE '{SPLIT}'"
TEST = f"date >= DATE '{SPLIT}'"


def nse_sql(y: str, p: str, cond: str = "TRUE") -> str:
    a = f"(CASE WHEN {cond} AND {y} IS NOT NULL AND {p} IS NOT NULL THEN {y} END)"
    b = f"(CASE WHEN {cond} AND {y} IS NOT NULL AND {p} IS NOT NULL THEN {p} END)"
    total = f"(var_pop({a}) * count({a}))"
    return f"CASE WHEN {total} > 0 THEN 1 - sum(({a} - {b}) * ({a} - {b})) / nullif({total}, 0) END"


def mae_sql(y: str, p: str, cond: str = "TRUE") -> str:
    return f"avg(CASE WHEN {cond} THEN abs({y} - {p}) END)"


def rmse_sql(y: str, p: str, cond: str = "TRUE") -> str:
    return f"sqrt(avg(CASE WHEN {cond} THEN ({y} - {p}) * ({y} - {p}) END))"


def kge_sql(y: str, p: str) -> str:
    both = f"{y} IS NOT NULL AND {p} IS NOT NULL"
    a, b = f"(CASE WHEN {both} THEN {y} END)", f"(CASE WHEN {both} THEN {p} END)"
    rr = f"covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0)"
    alpha = f"stddev_pop({b}) / nullif(stddev_pop({a}), 0)"
    beta = f"avg({b}) / nullif(avg({a}), 0)"
    return (
        f"CASE WHEN stddev_pop({a}) > 0 AND stddev_pop({b}) > 0 THEN "
        f"1 - sqrt(({rr} - 1) ** 2 + ({alpha} - 1) ** 2 + ({beta} - 1) ** 2) END"
    )


SCORES = ["MAE", "RMSE", "R2"]


def scores_sql(cond: str, prefix: str) -> str:
    y, p = "y_log1p", "yhat"
    texts = {"MAE": mae_sql(y, p, cond), "RMSE": rmse_sql(y, p, cond), "R2": nse_sql(y, p, cond)}
    return ", ".join(f"{texts[n]} AS {prefix}{n}" for n in SCORES)


METRICS_SQL = (
    f"SELECT basin_id, {scores_sql(TRAIN, 'train_')}, {scores_sql(TEST, 'test_')}, count(*) AS rows "
    "FROM sm GROUP BY basin_id"
)

_PAIRS_SQL = f"""
SELECT *, exp(y_log1p) - 1 AS mm, exp(yp) - 1 AS mmp FROM (
  SELECT *, lag(y_log1p) OVER (PARTITION BY basin_id ORDER BY date) AS yp FROM sm WHERE {TEST})
WHERE yp IS NOT NULL
"""

PERSIST_TEST_SQL = f"""
SELECT basin_id, {nse_sql('y_log1p', 'yp')} AS persistence_NSE,
  {nse_sql('ln(1 + greatest(mm, 0))', 'ln(1 + greatest(mmp, 0))')} AS persistence_logNSE,
  {kge_sql('mm', 'mmp')} AS persistence_KGE
FROM ({_PAIRS_SQL}) GROUP BY basin_id HAVING count(*) > 5
"""

RATES_SQL = "SELECT basin_id, " + ", ".join(
    f"avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) AS {c}" for c in CHECKED
) + f" FROM sm WHERE {TEST} GROUP BY basin_id"


def _stats_sql(cond: str, name: str) -> str:
    y = f"(CASE WHEN {cond} THEN y_log1p END)"
    return (
        f"count({y}) AS n_{name}, avg({y}) AS mean_{name}, stddev_pop({y}) AS std_{name}, "
        f"var_pop({y}) AS var_{name}, min({y}) AS min_{name}, max({y}) AS max_{name}, "
        f"max({y}) - min({y}) AS range_{name}"
    )


STATS_SQL = f"SELECT basin_id, {_stats_sql(TRAIN, 'train')}, {_stats_sql(TEST, 'test')} FROM sm GROUP BY basin_id"

SUMMARY_SQL = f"""
SELECT st.basin_id, n_train, n_test, mean_train, std_train, var_train, mean_test, std_test, var_test, range_test,
  coalesce(std_test < 1e-3 OR std_test / (abs(mean_test) + 1e-6) < 0.01, FALSE) AS near_zero_var_test,
  persistence_NSE, persistence_logNSE, persistence_KGE,
  coalesce(({' + '.join(CHECKED)}) / {len(CHECKED)}, 0) AS avg_nan_rate_test
FROM st LEFT JOIN ps USING (basin_id) LEFT JOIN mr USING (basin_id)
"""

PERSIST_SERIES_SQL = f"""
SELECT basin_id, {nse_sql('y_log1p', 'yp')} AS persistence_NSE, count(*) AS persistence_N
FROM (SELECT *, lag(y_log1p) OVER (PARTITION BY basin_id ORDER BY date) AS yp FROM sm)
WHERE {TEST} AND yp IS NOT NULL GROUP BY basin_id
"""

AUGMENTED_SQL = """
SELECT mt.*, persistence_NSE, coalesce(persistence_N, 0) AS persistence_N,
  CASE WHEN test_R2 < 0 AND persistence_NSE > 0 THEN 'global' ELSE 'local' END AS suggested_serving
FROM mt LEFT JOIN pv USING (basin_id)
"""

RETRAINED_SQL = f"""
SELECT a.*, persistence_NSE, persistence_N,
  CASE WHEN test_R2 < 0 AND coalesce(persistence_NSE, -1) > 0 THEN 'global' ELSE 'local_lite' END AS suggested_serving
FROM (
  SELECT basin_id, {nse_sql('y_log1p', 'y2')} AS test_R2, {rmse_sql('y_log1p', 'y2')} AS test_RMSE,
    {mae_sql('y_log1p', 'y2')} AS test_MAE
  FROM (SELECT *, (lag(y_log1p) OVER (PARTITION BY basin_id ORDER BY date) + yhat) / 2 AS y2 FROM sm)
  WHERE {TEST} AND basin_id IN (SELECT basin_id FROM mt ORDER BY test_R2 ASC NULLS LAST, basin_id LIMIT 12)
  GROUP BY basin_id) a LEFT JOIN pv USING (basin_id)
"""

COMPARED_SQL = """
SELECT rt.basin_id, mt.test_R2 AS test_R2_orig, mt.test_RMSE AS test_RMSE_orig, mt.test_MAE AS test_MAE_orig,
  rt.test_R2 AS test_R2_lite, rt.test_RMSE AS test_RMSE_lite, rt.test_MAE AS test_MAE_lite,
  persistence_NSE, suggested_serving
FROM mt RIGHT JOIN rt ON mt.basin_id = rt.basin_id
"""

MT = [*SM, ("mt", METRICS_SQL)]
SUM = [*MT, ("ps", PERSIST_TEST_SQL), ("mr", RATES_SQL), ("st", STATS_SQL), ("su", SUMMARY_SQL)]
AUG = [*MT, ("pv", PERSIST_SERIES_SQL), ("ag", AUGMENTED_SQL)]
CMP = [*AUG, ("rt", RETRAINED_SQL), ("cp", COMPARED_SQL)]
