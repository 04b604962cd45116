"""Policy tables derived from the scores and the diagnosis of the fixture's forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet import fixed
from freshet.catalog import query
from freshet.catalog.fixture import (
    CHECKED,
    CMP,
    SPLIT,
    SUM,
    metrics,
    r,
    retrained,
    rounded,
    smooth,
    summary,
    with_,
)
from freshet.operators.diagnose import near_zero_report
from freshet.operators.metrics import augment_persistence, review_list
from freshet.operators.policy import (
    apply_overrides,
    compare_retrained,
    gating_policy,
    join_diagnostics,
    metric_modes,
    missing_policy,
    model_overrides,
    policy_entries,
    policy_summary,
    serving_policy,
)
from freshet.operators.split import restrict_to
from freshet.session import scratch_path
from freshet.sources.artifacts import (
    gating_entries,
    read_exclusions,
    read_overrides,
    read_serving_policy,
    serving_entries,
    write_artifact,
)


def _cols(names: list[str]) -> str:
    return ", ".join(r(c, c) for c in names)


JOINED_COLS = ["test_R2", "test_RMSE", "test_MAE", "std_test", "range_test", "avg_nan_rate_test", "persistence_NSE"]
# Only the series of the review list are diagnosed, so the left join leaves gaps.
REVIEW_SQL = """
SELECT basin_id FROM (SELECT *, row_number() OVER (ORDER BY test_R2 ASC NULLS LAST, basin_id) AS rk FROM mt)
WHERE rk <= 12 OR test_R2 <= 0
"""
REVIEWED = f"basin_id IN ({REVIEW_SQL})"
JOINED_SQL = f"""
SELECT mt.basin_id, rows, test_R2, test_RMSE, test_MAE, n_test, std_test, range_test, near_zero_var_test,
  avg_nan_rate_test, persistence_NSE
FROM mt LEFT JOIN (SELECT * FROM su WHERE {REVIEWED}) u ON mt.basin_id = u.basin_id
"""
JOINED = [*SUM, ("j", JOINED_SQL)]


def _joined(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = smooth(spark, sf_dir)
    scores = metrics(rows)
    return rows, join_diagnostics(scores, summary(restrict_to(rows, review_list(scores, 12))))


@query(
    "metrics_with_diagnosis",
    with_(
        *JOINED,
        select=f"SELECT basin_id, rows, n_test, near_zero_var_test, {_cols(JOINED_COLS)} FROM j",
    ),
)
def metrics_with_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_joined(spark, sf_dir)[1])


@query(
    "model_overrides",
    with_(
        *JOINED,
        select="SELECT basin_id, 'global' AS serve_model FROM j WHERE test_R2 < 0 AND persistence_NSE > 0",
    ),
)
def overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model_overrides(_joined(spark, sf_dir)[1])


# The fixture's spread is never next to nothing, so the report is made for the steadier series.
STEADY_SQL = "SELECT * REPLACE (std_test < 0.11 AS near_zero_var_test) FROM su"


def _steady(rows: DataFrame) -> DataFrame:
    return summary(rows).withColumn("near_zero_var_test", F.col("std_test") < 0.11)


@query(
    "near_zero_report",
    with_(
        *SUM,
        ("w", STEADY_SQL),
        select="SELECT w.basin_id, "
        + ", ".join([r("test_MAE", "test_MAE"), r("test_RMSE", "test_RMSE"), r("test_R2", "logNSE_test")])
        + f", n_test, {r('std_test', 'std_test')}, {r('range_test', 'range_test')} "
        "FROM w LEFT JOIN mt ON w.basin_id = mt.basin_id WHERE near_zero_var_test",
    ),
)
def steady_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = smooth(spark, sf_dir)
    return rounded(near_zero_report(metrics(rows), _steady(rows)))


def _list_sql(cases: list[str]) -> str:
    return "concat_ws('|', " + ", ".join(cases) + ")"


LISTS_SQL = "SELECT basin_id, " + _list_sql(
    [f"CASE WHEN {c} >= 0.8 THEN '{c}' END" for c in CHECKED]
) + " AS excluded, " + _list_sql(
    [
        f"CASE WHEN {c} >= 0.4 AND {c} < 0.8 THEN '{c}:{'zero' if c == fixed.SWE else 'median'}' END"
        for c in CHECKED
    ]
) + " AS advice FROM mr WHERE basin_id IN (SELECT basin_id FROM j WHERE avg_nan_rate_test >= 0.3)"


@query("missing_policy", with_(*JOINED, ("l", LISTS_SQL), select="SELECT * FROM l"))
def missing_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, joined = _joined(spark, sf_dir)
    lists = missing_policy(rows, joined, CHECKED, SPLIT)
    advice = F.transform("advice", lambda a: F.concat(a["column"], F.lit(":"), a["suggestion"]))
    return lists.select(
        fixed.KEY,
        F.array_join("excluded", "|").alias("excluded"),
        F.array_join(advice, "|").alias("advice"),
    )


GATING_SQL = """
SELECT basin_id, CASE WHEN near_zero_var_test THEN 'rmse' END AS metric_mode,
  CASE WHEN test_R2 < 0 AND persistence_NSE > 0 THEN 'global' END AS serve_model,
  nullif(excluded, '') AS feature_exclude, nullif(advice, '') AS feature_impute_check
FROM j LEFT JOIN l USING (basin_id)
"""


@query(
    "gating_policy",
    with_(
        *SUM[:-1],
        ("su0", SUM[-1][1]),
        ("su", STEADY_SQL.replace("FROM su", "FROM su0")),
        ("j", JOINED_SQL.replace(f"WHERE {REVIEWED}", "")),
        ("l", LISTS_SQL),
        ("gp", GATING_SQL),
        select="SELECT * FROM gp WHERE coalesce(metric_mode, serve_model, feature_exclude, feature_impute_check) IS NOT NULL",
    ),
)
def gating(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = smooth(spark, sf_dir)
    entries = policy_entries(gating_policy(metrics(rows), _steady(rows), rows, CHECKED, SPLIT))
    checks = F.transform(
        "feature_impute_check", lambda a: F.concat(a["column"], F.lit(":"), a["suggestion"])
    )
    return entries.select(
        fixed.KEY,
        "metric_mode",
        "serve_model",
        F.array_join("feature_exclude", "|").alias("feature_exclude"),
        F.array_join(checks, "|").alias("feature_impute_check"),
    )




@query(
    "policy_summary",
    with_(
        *JOINED, ("l", LISTS_SQL),
        select="SELECT basin_id, length(excluded) - length(replace(excluded, '|', '')) + 1 AS excluded_features "
        "FROM l WHERE excluded <> ''",
    ),
)
def excluded_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, joined = _joined(spark, sf_dir)
    lists = missing_policy(rows, joined, CHECKED, SPLIT)
    return policy_summary(lists.select(fixed.KEY, F.explode("excluded").alias("column")))


@query(
    "applied_overrides",
    with_(
        *SUM,
        ("w", STEADY_SQL),
        select="""
SELECT mt.basin_id, CASE WHEN near_zero_var_test THEN 'rmse' ELSE 'r2' END AS metric_mode,
  CASE WHEN test_R2 < 0 AND persistence_NSE > 0 THEN 'global' ELSE 'local' END AS serve_model
FROM mt JOIN w USING (basin_id)
""",
    ),
)
def applied_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overrides written as the gating artifact, read back and applied to the metrics."""
    rows = smooth(spark, sf_dir)
    scores, steady = metrics(rows), _steady(rows)
    path = scratch_path(spark, "gating")
    policy = gating_policy(scores, steady, rows, CHECKED, SPLIT)
    write_artifact(gating_entries(policy_entries(policy)), path)
    modes, models = read_overrides(spark, path, lines=True)
    return apply_overrides(scores, modes, models).select(fixed.KEY, "metric_mode", "serve_model")


@query(
    "excluded_artifact",
    with_(
        *SUM,
        ("j", JOINED_SQL.replace(f"WHERE {REVIEWED}", "")),
        ("l", LISTS_SQL),
        select="SELECT basin_id, unnest(string_split(excluded, '|')) AS \"column\" FROM l WHERE excluded <> ''",
    ),
)
def excluded_artifact(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = smooth(spark, sf_dir)
    path = scratch_path(spark, "gating")
    policy = gating_policy(metrics(rows), summary(rows), rows, CHECKED, SPLIT)
    write_artifact(gating_entries(policy_entries(policy)), path)
    return read_exclusions(spark, path, lines=True)


COMPARED_COLS = [f"test_{m}_{s}" for s in ("orig", "lite") for m in ("R2", "RMSE", "MAE")] + ["persistence_NSE"]


@query(
    "retrained_comparison",
    with_(
        *CMP,
        select=f"SELECT basin_id, suggested_serving, {_cols(COMPARED_COLS)} FROM cp",
    ),
)
def retrained_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = smooth(spark, sf_dir)
    scores = metrics(rows)
    return rounded(compare_retrained(scores, retrained(rows, scores)))


LOCAL_SQL = "SELECT basin_id, 'basin/' || basin_id AS model_path FROM mt WHERE rows >= 1200"
LITE_SQL = "SELECT basin_id, 'lite/' || basin_id AS model_path FROM rt WHERE persistence_N >= 500"
SERVING_SQL = """
SELECT basin_id, mode, CASE mode WHEN 'local_lite' THEN lt WHEN 'local' THEN lo END AS model_path,
  CASE mode WHEN 'local_lite' THEN 'prcp_mm_cr2met|swe_mm' END AS feature_order
FROM (
  SELECT k.basin_id, lt.model_path AS lt, lo.model_path AS lo,
    CASE WHEN ag.suggested_serving = 'global' THEN 'global'
      WHEN cp.suggested_serving = 'local_lite' AND test_R2_lite - test_R2_orig > 0 AND lt.model_path IS NOT NULL THEN 'local_lite'
      WHEN lo.model_path IS NOT NULL AND test_R2 >= 0.5 THEN 'local' ELSE 'global' END AS mode
  FROM (SELECT basin_id FROM ag UNION SELECT basin_id FROM lo UNION SELECT basin_id FROM cp) k
  LEFT JOIN ag USING (basin_id) LEFT JOIN cp USING (basin_id) LEFT JOIN lo USING (basin_id) LEFT JOIN lt USING (basin_id))
"""


def _serving(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = smooth(spark, sf_dir)
    scores = metrics(rows)
    augmented = augment_persistence(scores, rows, "y_log1p", SPLIT)
    again = retrained(rows, scores)
    local = scores.filter("rows >= 1200").select(
        fixed.KEY, F.concat(F.lit("basin/"), fixed.KEY).alias("model_path")
    )
    lite = again.filter("persistence_N >= 500").select(
        fixed.KEY,
        F.concat(F.lit("lite/"), fixed.KEY).alias("model_path"),
        F.array(F.lit(fixed.PRECIP), F.lit(fixed.SWE)).alias("feature_order"),
    )
    return serving_policy(augmented, compare_retrained(scores, again), local, lite, 0.5)


@query("serving_policy", with_(*CMP, ("lo", LOCAL_SQL), ("lt", LITE_SQL), select=SERVING_SQL))
def serving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The policy, written as its artifact and read back."""
    path = scratch_path(spark, "serving")
    write_artifact(serving_entries(_serving(spark, sf_dir)), path)
    policy = read_serving_policy(spark, path, lines=True)
    return policy.withColumn("feature_order", F.array_join("feature_order", "|"))


@query(
    "metric_modes",
    with_(
        *SUM, ("w", STEADY_SQL),
        select="SELECT basin_id, 'rmse' AS metric_mode FROM w WHERE near_zero_var_test",
    ),
)
def modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_modes(_steady(smooth(spark, sf_dir)))
