"""Sources, sinks, reshaping and tolerant parsing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet import fixed
from freshet.catalog import query
from freshet.catalog.fixture import (
    ATTRS_SQL,
    M,
    SD,
    attributes,
    master,
    r,
    rounded,
    series,
    table,
    with_,
)
from freshet.functions.scalars import normal_name, parse_list, repair_id, to_number, to_time
from freshet.operators.encode import fit_target_encoding
from freshet.operators.master import union_parts
from freshet.session import scratch_path
from freshet.sources.buckets import read_buckets, write_buckets
from freshet.sources.artifacts import (
    artifact_manifest,
    encoding_entries,
    read_encoding,
    write_artifact,
)
from freshet.sources.ledger import Ledger
from freshet.sources.tables import read_metrics, read_panel, write_csv, write_panel
from freshet.sources.wide import (
    clean_lines,
    melt_wide,
    pivot_attributes,
    read_attributes,
    read_lines,
    read_wide,
)


def _series_ids(spark: SparkSession, sf_dir: str) -> list[str]:
    """The 25 nations: the columns of the wide files."""
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string"))
    return sorted((r[0] for r in rows.collect()), key=int)


def _wide(spark: SparkSession, sf_dir: str, column: str) -> DataFrame:
    ids = _series_ids(spark, sf_dir)
    return series(spark, sf_dir).groupBy(fixed.TIME).pivot(fixed.KEY, ids).agg(F.max(column))


GRID_SQL = """
SELECT CAST(n_nationkey AS STRING) AS basin_id, d.date, sd.discharge_mm
FROM nation CROSS JOIN (SELECT DISTINCT date FROM sd) d
LEFT JOIN sd ON sd.basin_id = CAST(n_nationkey AS STRING) AND sd.date = d.date
"""


@query("wide_file_scan", with_(SD, select=GRID_SQL))
def wide_file_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wide TAB file with missing-cell marks and trailing comments, written and read back."""
    wide = _wide(spark, sf_dir, fixed.TARGET)
    marks = F.array(*[F.lit(m) for m in ("-9999", "-9999.0", "NaN", "NA", "")])
    mark = marks[F.pmod(F.datediff(fixed.TIME, F.lit("1990-01-01")), F.lit(5))]
    cells = [F.coalesce(F.col(c).cast("string"), mark).alias(c) for c in wide.columns[1:-1]]
    last = F.concat(
        F.coalesce(F.col(wide.columns[-1]).cast("string"), F.lit("NA")),
        F.when(F.dayofmonth(fixed.TIME) == 1, " # month start").otherwise(""),
    )
    path = scratch_path(spark, "wide") + ".txt"
    lines = wide.select(F.col(fixed.TIME).alias("Date"), *cells, last.alias(wide.columns[-1]))
    lines.write.csv(path, sep="\t", header=True, emptyValue="")
    return read_wide(spark, path[: -len(".txt")], fixed.TARGET)


#: Options of a CSV writer that leave a line as it is.
PLAIN = {"sep": "\u0001", "quote": "\u0000", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
LINES_SQL = "SELECT o_orderkey AS k, o_orderdate::DATE AS d, o_totalprice AS v, o_orderpriority AS p FROM orders"


@query(
    "reading_ledger",
    f"""
SELECT 'orders' AS source, count(*)::BIGINT AS lines, 0::BIGINT AS damaged_lines, count(*) FILTER (WHERE k % 11 = 0)::BIGINT AS unreadable_dates,
  count(*) FILTER (WHERE k % 7 = 0)::BIGINT AS short_lines, (2 * count(*) FILTER (WHERE k % 11 <> 0))::BIGINT AS cells,
  count(*) FILTER (WHERE k % 11 <> 0 AND k % 7 <> 0 AND k % 5 <> 0)::BIGINT AS unreadable_cells
FROM ({LINES_SQL})
""",
)
def reading_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a wide file with words for dates and numbers and lines that end early: what its reading loses."""
    k = F.col("o_orderkey")
    day = F.when(k % 11 == 0, "soon").otherwise(F.col("o_orderdate").cast("date").cast("string"))
    last = F.when(k % 7 == 0, "").otherwise(F.concat(F.lit("\t"), F.when(k % 5 == 0, "-9999").otherwise(F.col("o_orderpriority"))))
    lines = table(spark, sf_dir, "orders").select(F.concat(day, F.lit("\t"), F.col("o_totalprice").cast("string"), last).alias("date\tprice\tpriority"))
    path = scratch_path(spark, "orders")
    lines.write.csv(path, header=True, **PLAIN)
    ledger = Ledger("orders")
    read_wide(spark, path, "value", ledger=ledger).write.format("noop").mode("overwrite").save()
    ledger.check()
    return ledger.table(spark)


@query(
    "mixed_encodings",
    """
SELECT doc_id, length(line) AS chars, md5(line) AS digest
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[^A-Za-zÀ-ÖØ-öø-ÿ ]', '', 'g') AS line FROM documents)
""",
)
def mixed_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the documents' letters in UTF-8 files, half in Latin-1 ones of the same folder, told apart by their bytes."""
    letters = F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-zÀ-ÖØ-öø-ÿ ]", "")
    lines = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit("|"), letters).alias("line"))
    path = scratch_path(spark, "encodings")
    lines.filter("doc_id % 2 = 0").select("line").write.text(path)
    lines.filter("doc_id % 2 = 1").select("line").write.mode("append").csv(path, encoding="ISO-8859-1", **PLAIN)
    got = read_lines(spark, path, fallback="ISO-8859-1")
    letters = F.substring_index("line", "|", -1)
    return got.select(F.substring_index("line", "|", 1).cast("bigint").alias("doc_id"), F.length(letters).cast("bigint").alias("chars"), F.md5(letters).alias("digest"))


@query("wide_melt", with_(SD, select=GRID_SQL))
def wide_melt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return melt_wide(_wide(spark, sf_dir, fixed.TARGET), fixed.TARGET, time=fixed.TIME)


@query(
    "line_cleaning",
    """
SELECT doc_id, count(*) AS lines, CAST(sum(length(line)) AS BIGINT) AS chars, min(line) AS first_line,
  max(md5(line)) AS top_digest
FROM (
  SELECT doc_id, regexp_replace(replace(ltrim(part, chr(65279)), '"', ''), '\\t+', chr(9), 'g') AS line
  FROM (SELECT doc_id, unnest(string_split(
          replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))) AS part
        FROM documents))
WHERE NOT regexp_full_match(line, '\\s*')
GROUP BY doc_id
""",
)
def line_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    parts = documents.select("doc_id", F.explode(F.split("text", "\r\n|\r|\n")).alias("line"))
    lines = clean_lines(parts, collapse_tabs=True)
    return lines.groupBy("doc_id").agg(
        F.count("*").alias("lines"),
        F.sum(F.length("line")).cast("bigint").alias("chars"),
        F.min("line").alias("first_line"),
        F.max(F.md5("line")).alias("top_digest"),
    )


@query("panel_parts_roundtrip", with_(*M, select="SELECT * FROM m"))
def panel_parts_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written with one folder per series, read back as one panel."""
    rows = master(spark, sf_dir)
    path = scratch_path(spark, "parts")
    write_panel(rows, path, partition=True)
    return read_panel(spark, path).select(*rows.columns)


@query("panel_buckets_roundtrip", with_(*M, select="SELECT * FROM m"))
def panel_buckets_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written in a fixed number of buckets whatever the number of series, and opened again from the folder."""
    path = scratch_path(spark, "buckets")
    write_buckets(master(spark, sf_dir), path)
    return read_buckets(spark, path)


@query(
    "key_coercion",
    "SELECT CAST(o_custkey AS STRING) AS basin_id, CAST(o_orderdate AS DATE) AS date, o_orderkey, "
    "CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS value FROM orders WHERE o_custkey IS NOT NULL",
)
def key_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored table with numeric ids, timestamps and NaN cells, read as a panel."""
    orders = table(spark, sf_dir, "orders")
    value = F.when(F.col("o_orderkey") % 7 == 0, float("nan")).otherwise(F.col("o_totalprice"))
    path = scratch_path(spark, "orders")
    orders.select(
        F.col("o_custkey").alias(fixed.KEY),
        F.col("o_orderdate").alias(fixed.TIME),
        "o_orderkey",
        value.alias("value"),
    ).write.parquet(path)
    return read_panel(spark, path)


@query(
    "parts_union",
    with_(
        SD,
        select="SELECT basin_id, date, discharge_mm, CASE WHEN CAST(basin_id AS INT) >= 12 "
        "THEN pet_mm_hargreaves END AS pet_mm_hargreaves FROM sd",
    ),
)
def parts_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = series(spark, sf_dir).select(fixed.KEY, fixed.TIME, fixed.TARGET, fixed.PET)
    low = rows.filter(F.col(fixed.KEY).cast("int") < 12).drop(fixed.PET)
    return union_parts([low, rows.filter(F.col(fixed.KEY).cast("int") >= 12)])


@query(
    "metric_file_scan",
    f"""
SELECT CAST(c_custkey AS STRING) AS basin_id, {r('c_acctbal', 'test_R2')},
  CASE WHEN c_custkey % 5 <> 0 THEN CAST(c_nationkey AS DOUBLE) END AS test_RMSE FROM customer
""",
)
def metric_file_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A metrics CSV whose ids went through a float column."""
    customers = table(spark, sf_dir, "customer")
    rmse = F.when(F.col("c_custkey") % 5 == 0, "nan").otherwise(F.col("c_nationkey").cast("string"))
    path = scratch_path(spark, "metrics")
    write_csv(
        customers.select(
            F.concat(F.col("c_custkey").cast("string"), F.lit(".0")).alias(fixed.KEY),
            F.col("c_acctbal").alias("test_R2"),
            rmse.alias("test_RMSE"),
        ),
        path,
    )
    return rounded(read_metrics(spark, path, numbers=["test_R2", "test_RMSE"]))


@query(
    "list_file_scan",
    """
SELECT CAST(p_partkey AS STRING) AS basin_id, unnest([p_name, p_brand]) AS feature FROM part WHERE p_partkey % 3 <> 0
""",
)
def list_file_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists written as text in a CSV cell and parsed back; an unreadable one is empty."""
    parts = table(spark, sf_dir, "part")
    names = F.to_json(F.array("p_name", "p_brand"))
    text = F.when(F.col("p_partkey") % 3 == 0, "[broken").otherwise(F.translate(names, '"', "'"))
    path = scratch_path(spark, "lists")
    write_csv(parts.select(F.col("p_partkey").alias(fixed.KEY), text.alias("features_used")), path)
    read = read_metrics(spark, path)
    return read.select(fixed.KEY, F.explode(parse_list("features_used")).alias("feature"))


@query(
    "encoding_artifact",
    with_(
        *M,
        ("te", "SELECT basin_id, sum(discharge_mm) AS t, count(*) AS n FROM m GROUP BY basin_id"),
        ("g", "SELECT sum(t) / sum(n) AS g FROM te"),
        select=f"SELECT basin_id, {r('(t + 100 * g) / (n + 100)', 'enc')}, {r('g', 'global_mean')} FROM te, g",
    ),
)
def encoding_artifact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The encoding written as a JSON artifact and read back."""
    path = scratch_path(spark, "encoding")
    write_artifact(encoding_entries(fit_target_encoding(master(spark, sf_dir), fixed.TARGET)), path)
    encoding, mean = read_encoding(spark, path, lines=True)
    return rounded(encoding.withColumn("global_mean", mean.scalar()))


@query(
    "artifact_manifest",
    """
SELECT 'attributes' AS artifact, true AS exists, 64 AS digits, true AS filled
UNION ALL SELECT 'one_part', true, 64, true UNION ALL SELECT 'serving_policy', false, NULL, NULL
""",
)
def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest and size of written artifacts; one of the expected ones is absent."""
    folder = scratch_path(spark, "artifacts")
    write_artifact(attributes(spark, sf_dir).coalesce(1), f"{folder}/attributes")
    found = spark.read.format("binaryFile").load(f"{folder}/attributes/*.json").select("path")
    name = found.first()[0].rsplit("/", 1)[-1]
    wanted = {"attributes": "attributes", "one_part": f"attributes/{name}", "serving_policy": "serving_policy.json"}
    rows = artifact_manifest(spark, folder, wanted)
    return rows.select("artifact", "exists", F.length("sha256").alias("digits"), (F.col("size_bytes") > 0).alias("filled"))


SHEET_SQL = f"""
SELECT basin_id, area_sites, elev_gauge, CASE WHEN CAST(basin_id AS INT) % 4 <> 0 THEN slope_class END AS slope_class
FROM ({ATTRS_SQL})
"""


@query("attribute_sheet_scan", SHEET_SQL)
def attribute_sheet_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A transposed sheet with quotes, blank lines, text cells and an empty attribute."""
    attrs = attributes(spark, sf_dir)
    ids = _series_ids(spark, sf_dir)
    slope = F.when(F.col(fixed.KEY).cast("int") % 4 == 0, "abc").otherwise(F.col("slope_class").cast("string"))
    texts = attrs.select(
        fixed.KEY,
        F.col("area_sites").cast("string").alias(" Area Sites"),
        F.col("elev_gauge").cast("string").alias("elev-gauge"),
        slope.alias("slope/class"),
        F.lit(" ").alias("nothing"),
    )
    long = texts.unpivot(fixed.KEY, [c for c in texts.columns if c != fixed.KEY], "gauge_id", "value")
    sheet = long.groupBy("gauge_id").pivot(fixed.KEY, ids).agg(F.max("value"))
    quoted = [F.concat(F.lit('"'), F.coalesce(F.col(f"`{c}`"), F.lit("")), F.lit('"')) for c in sheet.columns]
    head = F.lit("\t".join(f'"{c}"' for c in sheet.columns))
    path = scratch_path(spark, "sheet")
    blocks = F.concat_ws("\n", head, F.lit(" \t "), F.concat_ws("\t", *quoted))
    # One file, header first: the sheet has as many lines as there are attributes.
    sheet.select(blocks.alias("value")).coalesce(1).write.text(path)
    return read_attributes(spark, path)


@query(
    "attribute_cells_pivot",
    """
SELECT basin_id, max(CASE WHEN attribute = 'small' THEN v END) AS small, max(CASE WHEN attribute = 'economy' THEN v END) AS economy,
  max(CASE WHEN attribute = 'large' THEN v END) AS large
FROM (SELECT p_brand AS basin_id, lower(p_type) AS attribute, CAST(arg_min(p_size, p_partkey) AS DOUBLE) AS v
      FROM part WHERE p_size % 3 <> 0 GROUP BY 1, 2)
WHERE attribute IN ('small', 'economy', 'large') GROUP BY basin_id
""",
)
def attribute_cells_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many cells per (series, attribute): the first one with a value wins."""
    parts = table(spark, sf_dir, "part")
    cells = parts.select(
        F.col("p_brand").alias(fixed.KEY),
        F.col("p_type").alias("attribute"),
        F.when(F.col("p_size") % 3 != 0, F.col("p_size").cast("string")).alias("value"),
        F.col("p_partkey").alias("line_no"),
    ).filter(F.lower("attribute").isin("small", "economy", "large"))
    return pivot_attributes(cells, ["small", "economy", "large"])


@query(
    "name_normalisation",
    """
SELECT DISTINCT regexp_replace(lower(trim(p_name || '.' || p_type || '/' || p_brand)), '[ \\-./]', '_', 'g') AS name
FROM part
""",
)
def name_normalisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    raw = F.concat("p_name", F.lit("."), "p_type", F.lit("/"), "p_brand")
    return parts.select(normal_name(raw).alias("name")).distinct()


@query(
    "number_coercion",
    """
SELECT l_orderkey, l_linenumber,
  CASE l_linenumber % 4 WHEN 0 THEN NULL WHEN 1 THEN NULL ELSE l_quantity END AS value FROM lineitem
""",
)
def number_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers as text, some of them unreadable or NaN."""
    lines = table(spark, sf_dir, "lineitem")
    kind = F.col("l_linenumber") % 4
    text = (
        F.when(kind == 0, "n/a")
        .when(kind == 1, "NaN")
        .when(kind == 2, F.concat(F.lit(" "), F.col("l_quantity").cast("string")))
        .otherwise(F.col("l_quantity").cast("string"))
    )
    return lines.select("l_orderkey", "l_linenumber", to_number(text).alias("value"))


@query(
    "date_coercion",
    """
SELECT o_orderkey, TRY_CAST(printf('%04d-%02d-%02d', year(o_orderdate), month(o_orderdate) + (o_orderkey % 3) * 5,
  day(o_orderdate)) AS DATE) AS date FROM orders
""",
)
def date_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    day = F.col("o_orderdate")
    month = F.month(day) + (F.col("o_orderkey") % 3) * 5
    text = F.format_string("%04d-%02d-%02d", F.year(day), month, F.dayofmonth(day))
    return orders.select("o_orderkey", to_time(text).alias("date"))


@query(
    "id_repair",
    "SELECT CAST(s_suppkey AS STRING) AS basin_id, count(*) AS n FROM supplier JOIN lineitem "
    "ON l_suppkey = s_suppkey GROUP BY s_suppkey",
)
def id_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    ids = repair_id(F.col("l_suppkey").cast("double")).alias(fixed.KEY)
    return lines.groupBy(ids).agg(F.count("*").alias("n"))


