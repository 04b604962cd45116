"""Model fits and scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet import fixed
from freshet.catalog import query
from freshet.catalog.fixture import (
    DV,
    P,
    SPLIT,
    TRAIN,
    features,
    master,
    nse_sql,
    r,
    rmse_sql,
    rounded,
    table,
    with_,
)
from freshet.operators.encode import apply_target_encoding, fit_target_encoding
from freshet.operators.metrics import regression_metrics
from freshet.operators.models import (
    RIDGE,
    GlobalModel,
    fit_baseline,
    fit_global,
    fit_linear_per_series,
    fit_per_series,
    named_importance,
    retrain_bottom,
    top_features,
)
from freshet.operators.scoring import assemble_request, resolve_mode, score
from freshet.operators.split import restrict_to, temporal_split
from freshet.plans.artifacts import Serving
from freshet.plans.versions import publish
from freshet.session import scratch_path, settle, store
from freshet.streaming.scoring import read_scores, write_stream, write_versioned_scores

# Small settings: the queries check the flow; the defaults are in ``fixed.BOOSTING``.
SMALL = {"rounds": 5, "depth": 3, "rate": 0.3}
LITE = [f"{fixed.PRECIP}_lag1", f"{fixed.TARGET}_lag1", fixed.TMAX, fixed.PET]
ORDER = [*LITE, fixed.ENCODED]


@query(
    "linear_fits",
    with_(
        *P,
        select=f"""
SELECT basin_id, {r('CASE WHEN var_pop(x) > 0 THEN regr_slope(y, x) END', 'slope')},
  {r('CASE WHEN var_pop(x) > 0 THEN regr_intercept(y, x) END', 'intercept')},
  {r('CASE WHEN var_pop(x) > 0 THEN regr_r2(y, x) END', 'r2')}, regr_count(y, x)::BIGINT AS n
FROM (SELECT basin_id, y_log1p AS y, prcp_mm_cr2met_sum_7d AS x FROM p
      WHERE y_log1p IS NOT NULL AND prcp_mm_cr2met_sum_7d IS NOT NULL) GROUP BY basin_id
""",
    ),
)
def linear_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features(spark, sf_dir, attrs=False).select(
        fixed.KEY, F.col("y_log1p").alias("y"), F.col(f"{fixed.PRECIP}_sum_7d").alias("x")
    )
    return rounded(fit_linear_per_series(rows.na.drop(), "y", "x"))


#: Today's rain (with gaps, filled by the median), last week's rain and yesterday's target (gaps become 0).
THREE = [fixed.PRECIP, f"{fixed.PRECIP}_sum_7d", f"{fixed.TARGET}_lag1"]


def _ridge_sql(a: str) -> dict[str, str]:
    """Coefficients of the ridge on three standardised columns by cofactors; ``a`` stands on the diagonal."""
    det = f"({a} * {a} * {a} + 2 * r12 * r13 * r23 - {a} * (r12 * r12 + r13 * r13 + r23 * r23))"
    rows = [
        (f"({a} * {a} - r23 * r23)", f"(r13 * r23 - {a} * r12)", f"(r12 * r23 - {a} * r13)"),
        (f"(r13 * r23 - {a} * r12)", f"({a} * {a} - r13 * r13)", f"(r12 * r13 - {a} * r23)"),
        (f"(r12 * r23 - {a} * r13)", f"(r12 * r13 - {a} * r23)", f"({a} * {a} - r12 * r12)"),
    ]
    return {f"b{i}": f"CASE WHEN s{i} > 0 THEN ({' + '.join(f'c{j} * {x}' for j, x in enumerate(row, 1))}) / {det} / s{i} ELSE 0 END" for i, row in enumerate(rows, 1)}


_pair = lambda i, j: f"CASE WHEN stddev_pop(x{i}) > 0 AND stddev_pop(x{j}) > 0 THEN covar_pop(x{i}, x{j}) / (stddev_pop(x{i}) * stddev_pop(x{j})) ELSE 0 END AS r{i}{j}"


@query(
    "per_series_models",
    with_(
        *P,
        ("n", f"SELECT basin_id, count(*)::BIGINT AS total FROM p GROUP BY basin_id HAVING count(*) >= {fixed.MIN_ROWS} "
              f"AND count({THREE[0]}) > 0 AND count({THREE[1]}) > 0 AND count({THREE[2]}) > 0"),
        ("g0", f"SELECT basin_id, {TRAIN} AS tr, y_log1p AS y, {THREE[0]} AS x1, coalesce({THREE[1]}, 0) AS x2, coalesce({THREE[2]}, 0) AS x3 "
               "FROM p WHERE y_log1p IS NOT NULL"),
        ("md", "SELECT basin_id, median(x1) AS mid FROM g0 WHERE tr GROUP BY basin_id"),
        ("s", "SELECT g0.* REPLACE (coalesce(x1, mid, 0) AS x1) FROM g0 LEFT JOIN md USING (basin_id)"),
        ("v", "SELECT basin_id FROM s GROUP BY basin_id HAVING count(*) FILTER (WHERE tr) > 0 AND count(*) FILTER (WHERE NOT tr) > 0"),
        ("c", "SELECT basin_id, avg(y) AS my, " + ", ".join(
                  [f"avg(x{i}) AS m{i}, stddev_pop(x{i}) AS s{i}, CASE WHEN stddev_pop(x{i}) > 0 THEN covar_pop(x{i}, y) / stddev_pop(x{i}) ELSE 0 END AS c{i}" for i in (1, 2, 3)]
                  + [_pair(1, 2), _pair(1, 3), _pair(2, 3)]) + " FROM s WHERE tr GROUP BY basin_id"),
        ("b", "SELECT *, " + ", ".join(f"{x} AS {name}" for name, x in _ridge_sql(f"(1 + {RIDGE})").items()) + " FROM c"),
        ("g", "SELECT s.*, b1, b2, b3, my - b1 * m1 - b2 * m2 - b3 * m3 AS b0, my - b1 * m1 - b2 * m2 - b3 * m3 + b1 * x1 + b2 * x2 + b3 * x3 AS yhat "
              "FROM s JOIN b USING (basin_id)"),
        select=f"""
SELECT basin_id, any_value(total) AS "rows", 3::BIGINT AS n_features, {', '.join(r(f'any_value(b{i})', f'slope{i}', 4) for i in (1, 2, 3))},
  {r('any_value(b0)', 'intercept', 4)}, {r(rmse_sql('y', 'yhat', 'tr'), 'train_RMSE', 4)}, {r(rmse_sql('y', 'yhat', 'NOT tr'), 'test_RMSE', 4)},
  {r(nse_sql('y', 'yhat', 'NOT tr'), 'test_R2', 4)}
FROM g JOIN v USING (basin_id) JOIN n USING (basin_id) GROUP BY basin_id
""",
    ),
)
def per_series_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One linear model per series on three features, two of them with gaps."""
    registry = fit_per_series(features(spark, sf_dir, attrs=False), "y_log1p", THREE, split_date=SPLIT)
    slopes = {f"slope{i + 1}": F.col("model.coefficients")[i] for i in range(3)}
    shown = registry.withColumns({**slopes, "intercept": F.col("model.intercept")})
    return rounded(shown.select(fixed.KEY, "rows", "n_features", *slopes, "intercept", "train_RMSE", "test_RMSE", "test_R2"), 4)


def _global(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, GlobalModel]:
    panel = features(spark, sf_dir, attrs=False)
    return panel, fit_global(panel, "y_log1p", ORDER, split_date=SPLIT, params=SMALL)


@query("global_model_metrics")
def global_model_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_global(spark, sf_dir)[1].metrics, 4)


@query("baseline_model_metrics")
def baseline_model_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = master(spark, sf_dir)
    _, scores = fit_baseline(rows, fixed.FORCINGS, split_date=SPLIT, params=SMALL)
    return rounded(scores, 4)


@query("global_feature_importance")
def global_feature_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = _global(spark, sf_dir)[1]
    return rounded(named_importance(spark, model.booster, model.order), 4)


def _naive_scores(panel: DataFrame) -> DataFrame:
    rows = temporal_split(panel, "y_log1p", SPLIT).filter("side = 'test'")
    naive = rows.withColumn("yhat", F.log1p(f"{fixed.TARGET}_lag1"))
    scores = regression_metrics(naive, "y_log1p", "yhat")
    return scores.select(fixed.KEY, *[F.col(c).alias(f"test_{c}") for c in ("R2", "RMSE", "MAE")])


@query("retrained_worst")
def retrained_worst(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel, model = _global(spark, sf_dir)
    scores = _naive_scores(panel)
    top = top_features(named_importance(spark, model.booster, model.order), 3)
    out = retrain_bottom(panel, scores, top, "y_log1p", n=6, split_date=SPLIT)
    return rounded(out.select(fixed.KEY, "n_features", "test_R2", "persistence_NSE", "suggested_serving"), 4)


VECTOR = [fixed.PRECIP, fixed.TMIN, "swe_mm", fixed.PET, fixed.ENCODED]


def _requests(rows: DataFrame) -> DataFrame:
    """Each row as a request: missing rain is sent as NaN, a missing PET is not sent."""
    rain = F.coalesce(fixed.PRECIP, F.lit(float("nan")))
    sent = F.create_map(F.lit(fixed.PRECIP), rain, F.lit(fixed.TMIN), F.col(fixed.TMIN))
    more = F.map_concat(sent, F.create_map(F.lit(fixed.PET), F.col(fixed.PET)))
    return rows.withColumn("features", F.when(F.col(fixed.PET).isNull(), sent).otherwise(more))


VECTOR_SQL = with_(
    *DV,
    ("te", "SELECT basin_id, sum(discharge_mm) AS t, count(*) AS n FROM m GROUP BY basin_id HAVING count(*) >= 1200"),
    ("g", "SELECT coalesce(sum(t) / sum(n), 0) AS g FROM te"),
    ("q", "SELECT basin_id, date, prcp_mm_cr2met AS p, tmin_c, pet_mm_hargreaves AS pet FROM m"),
    select=f"""
SELECT q.basin_id, date, {r('coalesce(p, 0)', 'v0')}, {r('coalesce(tmin_c, 0)', 'v1')}, {r('0', 'v2')}, {r('coalesce(pet, 0)', 'v3')},
  {r('coalesce((t + 100 * g) / (n + 100), g)', 'v4')},
  concat_ws('|', CASE WHEN p IS NULL THEN 'prcp_mm_cr2met' END, CASE WHEN tmin_c IS NULL THEN 'tmin_c' END, 'swe_mm',
    CASE WHEN pet IS NULL THEN 'pet_mm_hargreaves' END) AS missing
FROM q LEFT JOIN te USING (basin_id), g
""",
)


@query("request_vectors", VECTOR_SQL)
def request_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature vectors in fixed order; missing entries become 0 and are listed."""
    rows = master(spark, sf_dir)
    return rounded(_vectors(_requests(rows), rows))


def _vectors(requests: DataFrame, rows: DataFrame) -> DataFrame:
    """Vectors of batch or streaming requests; series with few rows have no encoding."""
    known = rows.groupBy(fixed.KEY).agg(F.count("*").alias("n")).filter("n >= 1200")
    encoding = settle(fit_target_encoding(restrict_to(rows, known), fixed.TARGET))
    # One number, as the stored encoding artifact holds it.
    mean = encoding.agg(F.max("global_mean")).first()[0] or 0.0
    encoded = apply_target_encoding(requests, encoding, mean)
    out = assemble_request(encoded, VECTOR, encoded=F.col(fixed.ENCODED))
    return out.select(
        fixed.KEY,
        fixed.TIME,
        *[F.col("vector")[i].alias(f"v{i}") for i in range(len(VECTOR))],
        F.array_join("features_missing", "|").alias("missing"),
    )


@query("streamed_request_vectors", VECTOR_SQL)
def streamed_request_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same vectors from a stream of requests, run until its input is used up."""
    rows = master(spark, sf_dir)
    folder = scratch_path(spark, "requests")
    requests = _requests(rows).select(fixed.KEY, fixed.TIME, "features")
    requests.write.json(folder, ignoreNullFields=False)
    schema = f"{fixed.KEY} string, {fixed.TIME} date, features map<string,double>"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).json(folder)
    return rounded(_drained(_vectors(stream, rows)))


def _drained(stream: DataFrame) -> DataFrame:
    spark = stream.sparkSession
    out = scratch_path(spark, "stream")
    write_stream(stream, f"{out}/rows", f"{out}/log").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


MODE_SQL = """
SELECT o_orderkey, basin_id, CASE k WHEN 'BUILDING' THEN 'local_lite' ELSE 'global' END AS mode,
  CASE k WHEN 'BUILDING' THEN 'lite/' || basin_id ELSE 'global' END AS model_path,
  CASE k WHEN 'FURNITURE' THEN 'local_lite chosen but model_path or feature_order is missing; using global.'
    WHEN 'HOUSEHOLD' THEN 'local_lite model not found; using global.'
    WHEN 'MACHINERY' THEN 'local chosen but no feature_order is known; using global.' ELSE '' END AS notes
FROM (SELECT o_orderkey, CAST(o_custkey AS STRING) AS basin_id, CASE WHEN c_acctbal >= 0 THEN c_mktsegment END AS k
      FROM orders LEFT JOIN customer ON o_custkey = c_custkey)
"""


@query("serving_mode", MODE_SQL)
def serving_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests meet a policy with every kind of entry, one per market segment; customers in debt
    have none."""
    return _modes(spark, sf_dir, table(spark, sf_dir, "orders"))


def _modes(spark: SparkSession, sf_dir: str, orders: DataFrame) -> DataFrame:
    requests = orders.select("o_orderkey", F.col("o_custkey").cast("string").alias(fixed.KEY))
    kind = F.col("c_mktsegment")
    path = F.concat(F.lit("lite/"), F.col("c_custkey").cast("string"))
    policy = (
        table(spark, sf_dir, "customer")
        .filter("c_acctbal >= 0")
        .select(
            F.col("c_custkey").cast("string").alias(fixed.KEY),
            F.when(kind == "MACHINERY", "local")
            .when(kind == "AUTOMOBILE", "global")
            .otherwise("LOCAL_LITE")
            .alias("mode"),
            path.alias("model_path"),
            F.when(kind != "FURNITURE", F.array(F.lit(fixed.TMIN))).alias("feature_order"),
            kind.alias("kind"),
        )
    )
    stored = policy.filter("kind <> 'HOUSEHOLD'").select(fixed.KEY, "model_path")
    out = resolve_mode(requests, policy.drop("kind"), stored)
    return out.select(
        "o_orderkey", fixed.KEY, "mode", "model_path", F.array_join("notes", "|").alias("notes")
    )


@query("streamed_serving_mode", MODE_SQL)
def streamed_serving_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for a stream of requests against static policy tables."""
    schema = table(spark, sf_dir, "orders").schema
    orders = spark.readStream.schema(schema).option("pathGlobFilter", "orders.parquet").parquet(sf_dir)
    return _drained(_modes(spark, sf_dir, orders))


@query("scored_requests")
def scored_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All test rows as requests, some series served by retrained models, the rest by the global one."""
    panel, model = _global(spark, sf_dir)
    scores = _naive_scores(panel)
    lite = store(retrain_bottom(panel, scores, LITE, "y_log1p", n=4, split_date=SPLIT), "lite")
    policy = lite.select(
        fixed.KEY, F.lit("local_lite").alias("mode"), "model_path", F.col("features_used").alias("feature_order")
    )
    test = panel.filter(F.col(fixed.TIME) >= F.lit(SPLIT).cast("date"))
    entries = [x for c in LITE for x in (F.lit(c), F.col(c))]
    requests = test.select(fixed.KEY, F.create_map(*entries).alias("features"))
    out = score(requests, policy, lite.select(fixed.KEY, "model_path", "model"), model)
    return out.groupBy(fixed.KEY, "model_used", "mode").agg(
        F.count("*").alias("requests"),
        F.count_if(F.col("yhat_mm").isNull() | F.isnan("yhat_mm")).alias("without_value"),
        F.round(F.avg("yhat_log"), 4).alias("mean_log"),
    )


WEEK = f"{fixed.PRECIP}_sum_7d"


@query(
    "streamed_scores",
    with_(
        *P,
        ("l", f"SELECT basin_id, CASE WHEN var_pop(x) > 0 THEN regr_slope(y, x) END AS b, CASE WHEN var_pop(x) > 0 THEN regr_intercept(y, x) END AS a "
              f"FROM (SELECT basin_id, y_log1p AS y, {WEEK} AS x FROM p WHERE y_log1p IS NOT NULL AND {WEEK} IS NOT NULL) GROUP BY basin_id"),
        ("q", f"SELECT basin_id, CAST(basin_id AS INT) AS k, CASE WHEN {TRAIN} THEN 1 ELSE 2 END AS version, coalesce({WEEK}, 0) AS x FROM p WHERE y_log1p IS NOT NULL"),
        ("w", "SELECT q.*, a, b, CASE WHEN version = 1 THEN k % 2 = 0 ELSE k % 3 = 0 END AND b IS NOT NULL AS lite, "
              "CASE WHEN version = 1 THEN k % 2 = 0 ELSE k % 3 = 0 END AND b IS NULL AS absent, version = 2 AND k % 3 = 1 AS gap FROM q LEFT JOIN l USING (basin_id)"),
        select=f"""
SELECT basin_id, version, CASE WHEN lite THEN 'local_lite' ELSE 'global' END AS mode, CASE WHEN lite THEN 'local_lite' ELSE 'global' END AS model_used,
  CASE WHEN gap THEN 'local_lite chosen but model_path or feature_order is missing; using global.'
    WHEN absent THEN 'local_lite model not found; using global.' ELSE '' END AS notes,
  count(*)::BIGINT AS requests, 0::BIGINT AS without_value, {r('avg(CASE WHEN lite THEN a + b * x END)', 'mean_log', 4)}
FROM w GROUP BY basin_id, version, lite, gap, absent
""",
    ),
)
def streamed_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request stream meets two versions of the artifacts, the second published while it rests.

    Series with a line of their own are served by it where the version's policy says so; values of the global trees
    are counted only, as SQL has none.
    """
    panel = features(spark, sf_dir, attrs=False)
    lines = fit_linear_per_series(panel.select(fixed.KEY, F.col("y_log1p").alias("y"), F.col(WEEK).alias("x")).na.drop(), "y", "x")
    model = F.struct(F.col("intercept"), F.array("slope").alias("coefficients"))
    lite = store(lines.filter("slope IS NOT NULL").select(fixed.KEY, F.concat(F.lit("lite/"), fixed.KEY).alias("model_path"), model.alias("model")), "lines")
    trees = fit_global(panel, "y_log1p", [WEEK, fixed.ENCODED], split_date=SPLIT, params={"rounds": 1, "depth": 2})
    number = F.col(fixed.KEY).cast("int")
    keys = panel.select(fixed.KEY).distinct()
    path, order = F.concat(F.lit("lite/"), fixed.KEY).alias("model_path"), F.array(F.lit(WEEK))
    first = keys.filter(number % 2 == 0).select(fixed.KEY, F.lit("local_lite").alias("mode"), path, order.alias("feature_order"))
    second = keys.filter(number % 3 < 2).select(fixed.KEY, F.lit("local_lite").alias("mode"), path, F.when(number % 3 == 0, order).alias("feature_order"))

    base = scratch_path(spark, "versioned")
    schema = f"{fixed.KEY} string, features map<string,double>"
    load = lambda spark, folder: Serving(trees, spark.read.parquet(f"{folder}/policy"), lite)
    requests = panel.filter("y_log1p IS NOT NULL").select(fixed.KEY, fixed.TIME, F.create_map(F.lit(WEEK), F.col(WEEK)).alias("features"))
    before = F.col(fixed.TIME) < F.lit(SPLIT).cast("date")
    for policy, rows in ((first, requests.filter(before)), (second, requests.filter(~before))):
        publish(spark, f"{base}/artifacts", lambda folder, policy=policy: policy.write.parquet(f"{folder}/policy"))
        rows.select(fixed.KEY, "features").write.mode("append").json(f"{base}/requests", ignoreNullFields=False)
        stream = spark.readStream.schema(schema).json(f"{base}/requests")
        write_versioned_scores(stream, f"{base}/artifacts", f"{base}/scores", f"{base}/log", load=load).awaitTermination()
    local = F.when(F.col("model_used") == "local_lite", F.col("yhat_log"))
    out = read_scores(spark, f"{base}/scores").groupBy(fixed.KEY, "version", "mode", "model_used", F.array_join("notes", "|").alias("notes")).agg(
        F.count("*").alias("requests"),
        F.count_if(F.col("yhat_mm").isNull() | F.isnan("yhat_mm")).alias("without_value"),
        F.avg(local).alias("mean_log"),
    )
    return rounded(out, 4, ["mean_log"])
