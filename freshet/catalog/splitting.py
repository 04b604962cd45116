"""Split, gates, caps, encoding, medians, imputation and feature lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet import fixed
from freshet.catalog import query
from freshet.catalog.fixture import (
    F_,
    FEATURE_NAMES,
    M,
    P,
    SPLIT,
    TEST,
    TRAIN,
    features,
    master,
    r,
    rounded,
    table,
    with_,
)
from freshet.functions.scalars import is_core_name, is_zero_name
from freshet.operators.columns import (
    common_features,
    core_features,
    ensure_columns,
    exclude_columns,
    feature_order,
    non_null_counts,
    numeric_features,
    present_features,
    select_core,
)
from freshet.operators.encode import (
    apply_target_encoding,
    fit_target_encoding,
    impute_rules,
    train_medians,
)
from freshet.operators.models import global_rows
from freshet.operators.split import (
    balanced_sample,
    basin_gate,
    cap_per_series,
    cap_total,
    capped_counts,
    gate_counts,
    missing_series,
    pick_target,
    pooled_split,
    restrict_to,
    size_summary,
    split_counts,
    temporal_split,
)

KEYS = [fixed.KEY, fixed.TIME]
SIDE_SQL = f"CASE WHEN {TRAIN} THEN 'train' ELSE 'test' END"
COUNTS_SQL = (
    f"SELECT basin_id, count(*) AS rows, count(*) FILTER (WHERE {TRAIN}) AS n_train, "
    f"count(*) FILTER (WHERE {TEST}) AS n_test FROM m GROUP BY basin_id"
)
SPLIT_SQL = (
    f"SELECT m.*, {SIDE_SQL} AS side FROM m WHERE basin_id IN "
    "(SELECT basin_id FROM c WHERE n_train > 0 AND n_test > 0)"
)
C = [*M, ("c", COUNTS_SQL)]
S = [*C, ("s", SPLIT_SQL)]


@query("temporal_split", with_(*S, select="SELECT basin_id, date, discharge_mm, side FROM s"))
def split_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = master(spark, sf_dir)
    split = temporal_split(rows, pick_target(rows.columns), SPLIT)
    return split.select(*KEYS, fixed.TARGET, "side")


@query(
    "pooled_split",
    with_(
        *M,
        select=f"SELECT basin_id, date, discharge_mm, {SIDE_SQL} AS side FROM m "
        "WHERE prcp_mm_cr2met IS NOT NULL AND pet_mm_hargreaves IS NOT NULL",
    ),
)
def pooled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = master(spark, sf_dir)
    split = pooled_split(rows, present_features(rows.columns), fixed.TARGET, SPLIT)
    return split.select(*KEYS, fixed.TARGET, "side")


GATE_SQL = f"""
SELECT basin_id, rows, n_train, n_test, n_features, CASE WHEN rows < 1200 THEN 'small'
  WHEN n_train = 0 OR n_test = 0 THEN 'split' WHEN n_features < 3 THEN 'no_feats' ELSE 'ok' END AS gate
FROM (
  SELECT c.basin_id, rows, n_train, n_test, CAST(CASE WHEN c.basin_id IN (FROM gp) THEN 2 ELSE 4 END AS BIGINT) AS n_features
  FROM c)
"""
GAPPY_SQL = (
    "SELECT basin_id FROM m GROUP BY basin_id "
    "HAVING avg(CASE WHEN prcp_mm_cr2met IS NULL THEN 1.0 ELSE 0.0 END) >= 0.58"
)
G = [*C, ("gp", GAPPY_SQL)]


def _gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = master(spark, sf_dir)
    left_out = _left_out(rows, [fixed.PRECIP, fixed.PET])
    return basin_gate(
        rows, fixed.TARGET, [*fixed.FORCINGS], left_out, split_date=SPLIT, min_rows=1200
    )


def _left_out(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Exclusions: a series with many gaps in its precipitation loses the columns."""
    gaps = F.avg(F.col(fixed.PRECIP).isNull().cast("double"))
    gappy = rows.groupBy(fixed.KEY).agg(gaps.alias("gaps")).filter("gaps >= 0.58")
    return gappy.select(fixed.KEY, F.explode(F.array(*[F.lit(c) for c in columns])).alias("column"))


@query("series_gates", with_(*G, select=GATE_SQL))
def series_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gates(spark, sf_dir)


@query(
    "gate_counts",
    with_(
        *G, ("g", GATE_SQL),
        select="SELECT gate, count(*) AS series FROM g GROUP BY gate",
    ),
)
def gate_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate_counts(_gates(spark, sf_dir))


def _cap_sql(source: str, caps: str, order: str = "basin_id, CAST(date AS VARCHAR)") -> str:
    parts = " || '#' || ".join(order.split(", "))
    return f"""
SELECT basin_id, date, side FROM (
  SELECT *, row_number() OVER (PARTITION BY basin_id, side ORDER BY sha256({parts} || '#42'), date) AS rn FROM {source})
WHERE rn <= {caps}
"""


@query("cap_per_series", with_(*S, select=_cap_sql("s", "CASE side WHEN 'train' THEN 150 ELSE 50 END")))
def capped_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = temporal_split(master(spark, sf_dir), fixed.TARGET, SPLIT).select(*KEYS, "side")
    return cap_per_series(rows, {"train": 150, "test": 50})


@query(
    "cap_total",
    with_(
        *C,
        select="""
SELECT basin_id, n_train, n_test, train_before, test_before FROM (
  SELECT *, coalesce(sum(n_train) OVER w, 0)::BIGINT AS train_before, coalesce(sum(n_test) OVER w, 0)::BIGINT AS test_before
  FROM (SELECT basin_id, least(n_train, 150) AS n_train, least(n_test, 50) AS n_test FROM c WHERE n_train > 0 AND n_test > 0)
  WINDOW w AS (ORDER BY basin_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
WHERE NOT (train_before >= 2000 AND test_before >= 600)
""",
    ),
)
def total_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = split_counts(master(spark, sf_dir), fixed.TARGET, SPLIT).drop("rows")
    return cap_total(capped_counts(counts, 150, 50), 2000, 600)


@query(
    "balanced_sample",
    with_(
        *M,
        ("t", f"SELECT basin_id, date, 'all' AS side FROM m WHERE {TRAIN}"),
        ("k", _cap_sql("t", "60")),
        select="SELECT basin_id, date FROM (SELECT * FROM k ORDER BY sha256(CAST(date AS VARCHAR) || '#' || basin_id || '#42') LIMIT 1000)",
    ),
)
def balanced_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = master(spark, sf_dir).filter(F.col(fixed.TIME) < F.lit(SPLIT).cast("date"))
    return balanced_sample(train, 60, 1000).select(*KEYS)


@query(
    "size_summary",
    with_(
        *C,
        select="SELECT CAST(point AS DOUBLE) AS point, CAST(trunc(q) AS BIGINT) AS rows FROM ("
        + " UNION ALL ".join(
            f"SELECT {p} AS point, quantile_cont(CAST(rows AS DOUBLE), {p}) AS q FROM c" for p in (0.1, 0.25, 0.5, 0.75, 0.9)
        )
        + ")",
    ),
)
def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return size_summary(master(spark, sf_dir))


TE_SQL = f"SELECT basin_id, sum(discharge_mm) AS t, count(*) AS n FROM s WHERE {TRAIN} GROUP BY basin_id"


@query(
    "target_encoding",
    with_(
        *S,
        ("te", TE_SQL),
        ("g", "SELECT sum(t) / sum(n) AS g FROM te"),
        select=f"SELECT basin_id, n, {r('(t + 100 * g) / (n + 100)', 'enc')}, {r('g', 'global_mean')} FROM te, g",
    ),
)
def target_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = temporal_split(master(spark, sf_dir), fixed.TARGET, SPLIT)
    return rounded(fit_target_encoding(split.filter("side = 'train'"), fixed.TARGET))


@query(
    "encoded_rows",
    with_(
        *S,
        ("te", TE_SQL + " HAVING count(*) >= 700"),
        ("g", "SELECT coalesce(sum(t) / sum(n), 0) AS g FROM te"),
        select=f"SELECT m.basin_id, date, {r('coalesce((t + 100 * g) / (n + 100), g)', 'basin_te')} FROM m LEFT JOIN te USING (basin_id), g",
    ),
)
def encoded_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series too short for the encoding get the global mean."""
    rows = master(spark, sf_dir)
    train = temporal_split(rows, fixed.TARGET, SPLIT).filter("side = 'train'")
    known = train.groupBy(fixed.KEY).agg(F.count("*").alias("n")).filter("n >= 700")
    encoding = fit_target_encoding(restrict_to(train, known), fixed.TARGET)
    mean = encoding.agg(F.max("global_mean")).scalar()
    return rounded(apply_target_encoding(rows, encoding, mean).select(*KEYS, fixed.ENCODED))


MEDIAN_COLUMNS = [fixed.PRECIP, fixed.TMIN, fixed.TMAX, fixed.PET]
MEDIAN_SQL = (
    "SELECT basin_id, "
    + ", ".join(f"median({c}) AS {c}" for c in MEDIAN_COLUMNS)
    + f" FROM s WHERE {TRAIN} GROUP BY basin_id"
)


@query(
    "train_medians",
    with_(
        *S, ("md", MEDIAN_SQL),
        select="SELECT basin_id, " + ", ".join(r(c, c) for c in MEDIAN_COLUMNS) + " FROM md",
    ),
)
def medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = temporal_split(master(spark, sf_dir), fixed.TARGET, SPLIT)
    return rounded(train_medians(split.filter("side = 'train'"), MEDIAN_COLUMNS))


EVENT_MEDIAN = [f"value_{n}" for n in ("all", "small")]


@query(
    "long_series_medians",
    f"""
SELECT event_type, {r('median(value)', 'value_all')}, {r('median(CASE WHEN value < 5 THEN value END)', 'value_small')},
  CAST(median(user_id) AS DOUBLE) AS user FROM events GROUP BY event_type
""",
)
def long_series_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact medians of series too long to hold: the bracketed way, forced by a low limit."""
    events = table(spark, sf_dir, "events").select(
        "event_type",
        F.col("value").alias("value_all"),
        F.when(F.col("value") < 5, F.col("value")).alias("value_small"),
        F.col("user_id").cast("double").alias("user"),
    )
    columns = [*EVENT_MEDIAN, "user"]
    return rounded(train_medians(events, columns, key="event_type", exact_rows=150))


IMPUTED = [fixed.PRECIP, fixed.PET, f"{fixed.PRECIP}_lag1", f"{fixed.PRECIP}_sum_3d", "deficit"]


@query(
    "rule_imputation",
    with_(
        *P,
        ("c", COUNTS_SQL),
        ("s", SPLIT_SQL),
        ("md", MEDIAN_SQL),
        select=f"""
SELECT p.basin_id, date, {r('coalesce(p.prcp_mm_cr2met, md.prcp_mm_cr2met)', fixed.PRECIP)},
  {r('coalesce(p.pet_mm_hargreaves, md.pet_mm_hargreaves)', fixed.PET)},
  {r('coalesce(prcp_mm_cr2met_lag1, 0)', IMPUTED[2])}, {r('coalesce(prcp_mm_cr2met_sum_3d, 0)', IMPUTED[3])},
  {r('coalesce(deficit, 0)', 'deficit')}
FROM p JOIN md USING (basin_id)
""",
    ),
)
def imputed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = temporal_split(features(spark, sf_dir, attrs=False), fixed.TARGET, SPLIT)
    middle = train_medians(rows.filter("side = 'train'"), [fixed.PRECIP, fixed.PET])
    return rounded(impute_rules(rows, IMPUTED, middle).select(*KEYS, *IMPUTED))


@query(
    "excluded_columns",
    with_(
        *G,
        select="SELECT basin_id, date, CASE WHEN basin_id IN (FROM gp) THEN 0 ELSE prcp_mm_cr2met END AS prcp_mm_cr2met, "
        "tmin_c, CASE WHEN basin_id IN (FROM gp) THEN 0 ELSE pet_mm_hargreaves END AS pet_mm_hargreaves FROM m",
    ),
)
def excluded_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = master(spark, sf_dir)
    left_out = _left_out(rows, [fixed.PRECIP, fixed.PET])
    columns = [fixed.PRECIP, fixed.TMIN, fixed.PET]
    return exclude_columns(rows, left_out, columns).select(*KEYS, *columns)


# Which of the fixture's feature names are core, and which are imputed with zero.
CORE = [
    n
    for n in FEATURE_NAMES
    if n not in (fixed.PRECIP, fixed.TMIN, fixed.TMAX, fixed.PET, fixed.TMEAN)
    and not n.startswith("discharge_mm")
]
ZERO = [n for n in FEATURE_NAMES if n.endswith("d") and ("_sum_" in n or "_mean_" in n)] + [
    n for n in FEATURE_NAMES if "_lag" in n
] + ["deficit", "dd_above0", "dd_above5"]
COUNTED_SQL = " UNION ALL ".join(
    f"SELECT '{n}' AS \"column\", count({n}) AS n FROM f" for n in FEATURE_NAMES
)


def _in(names: list[str]) -> str:
    return ", ".join(f"'{n}'" for n in names)


@query(
    "feature_name_rules",
    with_(
        *F_,
        ("k", COUNTED_SQL),
        select=f'SELECT "column", n, "column" IN ({_in(CORE)}) AS core, "column" IN ({_in(ZERO)}) AS zero FROM k',
    ),
)
def feature_name_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric features with their number of values, core flag and zero-imputation flag."""
    rows = features(spark, sf_dir)
    names = numeric_features(rows)
    counted = non_null_counts(rows, names).groupBy("column").agg(F.sum("n").alias("n"))
    return counted.select("column", "n", is_core_name("column").alias("core"), is_zero_name("column").alias("zero"))


@query(
    "common_features",
    with_(
        *F_,
        ("ids", "SELECT DISTINCT basin_id FROM f"),
        (
            "k",
            " UNION ALL ".join(
                f"SELECT '{n}' AS \"column\", basin_id FROM f GROUP BY basin_id HAVING count({n}) > 0"
                for n in FEATURE_NAMES
            ),
        ),
        select='SELECT "column" FROM k WHERE basin_id IN (FROM ids) GROUP BY "column" '
        "HAVING count(*) = (SELECT count(*) FROM ids)",
    ),
)
def shared_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features(spark, sf_dir)
    return common_features(rows, numeric_features(rows))


@query(
    "core_feature_order",
    with_(
        *F_,
        ("k", COUNTED_SQL),
        select=f"""
SELECT "column", row_number() OVER (ORDER BY "column") - 1 AS pos FROM k WHERE n > 0 AND "column" IN ({_in(CORE)})
""",
    ),
)
def core_feature_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of the core features in the global model's fixed order."""
    rows = features(spark, sf_dir)
    names = numeric_features(rows)
    common = select_core(common_features(rows, names))
    order = feature_order(names, [r[0] for r in common.collect()])
    assert order[-1] == fixed.ENCODED and set(order[:-1]) <= set(core_features(names))
    places = F.array(*[F.lit(c) for c in order])
    return common.select("column", (F.array_position(places, F.col("column")) - 1).alias("pos"))


@query(
    "fixed_schema",
    with_(*M, select="SELECT basin_id, date, tmin_c, CAST(NULL AS DOUBLE) AS swe_mm FROM m"),
)
def fixed_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ensure_columns(master(spark, sf_dir), [fixed.TMIN, fixed.SWE])
    return rows.select(*KEYS, fixed.TMIN, fixed.SWE)


LISTED_SQL = "SELECT DISTINCT CAST(c_nationkey * 2 AS STRING) AS basin_id FROM customer"


@query(
    "listed_series",
    with_(
        *M, ("li", LISTED_SQL),
        select="SELECT basin_id, date, discharge_mm FROM m WHERE basin_id IN (FROM li)",
    ),
)
def listed_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = table(spark, sf_dir, "customer").select((F.col("c_nationkey") * 2).cast("string").alias(fixed.KEY))
    return restrict_to(master(spark, sf_dir), listed).select(*KEYS, fixed.TARGET)


@query(
    "listed_series_without_rows",
    with_(
        *M, ("li", LISTED_SQL),
        select="SELECT basin_id FROM li WHERE basin_id NOT IN (SELECT basin_id FROM m)",
    ),
)
def listed_without_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = table(spark, sf_dir, "customer").select((F.col("c_nationkey") * 2).cast("string").alias(fixed.KEY))
    return missing_series(listed, master(spark, sf_dir))


ORDER = [fixed.PET, f"{fixed.PRECIP}_lag1", "tmax_c", fixed.ENCODED]


@query(
    "pooled_training_rows",
    with_(
        *P,
        ("c", COUNTS_SQL),
        ("s", SPLIT_SQL),
        ("gp", GAPPY_SQL),
        ("md", MEDIAN_SQL),
        ("te", TE_SQL),
        ("g", "SELECT sum(t) / sum(n) AS g FROM te"),
        ("k", _cap_sql("s", "CASE side WHEN 'train' THEN 150 ELSE 50 END")),
        select=f"""
SELECT k.basin_id, k.date, side, {r('p.discharge_mm', 'discharge_mm')},
  {r('CASE WHEN k.basin_id IN (FROM gp) THEN 0 ELSE coalesce(p.pet_mm_hargreaves, md.pet_mm_hargreaves) END', fixed.PET)},
  {r('coalesce(p.prcp_mm_cr2met_lag1, 0)', ORDER[1])}, {r('coalesce(p.tmax_c, md.tmax_c)', 'tmax_c')},
  {r('(t + 100 * g) / (n + 100)', 'basin_te')}
FROM k JOIN p ON p.basin_id = k.basin_id AND p.date = k.date JOIN md ON md.basin_id = k.basin_id
JOIN te ON te.basin_id = k.basin_id, g
""",
    ),
)
def pooled_training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The capped, imputed and encoded table the global model is fitted on."""
    rows = features(spark, sf_dir, attrs=False)
    left_out = _left_out(rows, [fixed.PET])
    pooled, _ = global_rows(
        rows, fixed.TARGET, ORDER, left_out, split_date=SPLIT, caps={"train": 150, "test": 50}
    )
    return rounded(pooled)
