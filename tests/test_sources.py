"""Text, CSV, JSON and parquet sources on hand-made files."""

import hashlib

import pytest
from pyspark.sql import functions as F

from freshet.functions.scalars import (
    floor_zero,
    is_zero_feature,
    normal_names,
    parse_list,
    to_time,
    to_number,
)
from freshet.operators.master import build_master
from freshet.sources.artifacts import (
    SERVING_SCHEMA,
    artifact_manifest,
    read_artifact,
    read_encoding,
    read_exclusions,
    read_feature_order,
    read_serving_policy,
)
from freshet.sources.tables import coerce_keys, read_metrics, read_panel, write_csv, write_panel
from freshet.sources.wide import attribute_cells, read_attributes, read_wide, resolve_input


def test_wide_file(spark, tmp_path):
    text = (
        "# streamflow\n"
        'Date\t"1001"\tX-2 b\t30.5/a\n'
        "2000-01-01\t1.5\t-9999\t\n"
        "2000-01-02\tNaN\t2 # late\n"
        "2009-13-40\t1\t1\t1\n"
        "\n"
        "2000-01-03\tabc\t-9999.0\t-3\n"
    )
    (tmp_path / "flow.txt").write_text(text)
    rows = read_wide(spark, str(tmp_path / "flow"), "q").orderBy("date", "basin_id").collect()
    got = {(r["basin_id"], str(r["date"])): r["q"] for r in rows}
    assert got == {
        ("1001", "2000-01-01"): 1.5,
        ("x_2_b", "2000-01-01"): None,
        ("30_5_a", "2000-01-01"): None,
        ("1001", "2000-01-02"): None,
        ("x_2_b", "2000-01-02"): 2.0,
        ("30_5_a", "2000-01-02"): None,
        ("1001", "2000-01-03"): None,
        ("x_2_b", "2000-01-03"): None,
        ("30_5_a", "2000-01-03"): -3.0,
    }


def test_wide_file_with_named_date_and_other_separator(spark, tmp_path):
    (tmp_path / "p.csv").write_text('a,when,"b,c"\r\n1,2000-01-01,2\r\n"3",2000-01-02,"4"\r\n')
    got = read_wide(spark, str(tmp_path / "p"), "v", sep=",", date_col="when").collect()
    assert sorted((r[0], str(r[1]), r[2]) for r in got) == [
        ("a", "2000-01-01", 1.0),
        ("a", "2000-01-02", 3.0),
        ("b,c", "2000-01-01", 2.0),
        ("b,c", "2000-01-02", 4.0),
    ]
    with pytest.raises(ValueError):
        read_wide(spark, str(tmp_path / "p"), "v", sep=",", date_col="day")


def test_missing_file(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        resolve_input(spark, str(tmp_path / "nothing"))


SHEET = (
    b'\xef\xbb\xbf"gauge_id"\t"1001"\t"1002"\r\n'
    b'"area km"\t"10.5"\t"7"\r\n'
    b"\t \r\n"
    b'"elev.mean"\t"high"\t"200"\r\n'
    b'"geol/Class"\t""\t"nan"\r\n'
    b'"area km"\t"99"\t"98"\r\n'
    b'"na\xffme"\t"1"\t"2"\r\n'
)


def test_attribute_sheet(spark, tmp_path):
    (tmp_path / "attrs.txt").write_bytes(SHEET)
    got = read_attributes(spark, str(tmp_path / "attrs")).orderBy("basin_id").collect()
    assert [r.asDict() for r in got] == [
        {"basin_id": "1001", "area_km": 10.5, "elev_mean": None, "geol_class": None, "name": 1.0},
        {"basin_id": "1002", "area_km": 7.0, "elev_mean": 200.0, "geol_class": None, "name": 2.0},
    ]


def test_other_encoding(spark, tmp_path):
    (tmp_path / "l.txt").write_bytes("gauge_id\t1\t2\r\nañada x\t3\t\r\n".encode("latin-1"))
    got = read_attributes(spark, str(tmp_path / "l"), encoding="ISO-8859-1").collect()
    assert [r.asDict() for r in got] == [{"basin_id": "1", "añada_x": 3.0}]
    assert read_attributes(spark, str(tmp_path / "l")).columns == ["basin_id", "aada_x"]


def test_attribute_sheet_header_variants(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Gauge\t1\t2\nx\t1\t\t2\n")
    assert read_attributes(spark, str(tmp_path / "a.txt")).count() == 1
    joined = read_attributes(spark, str(tmp_path / "a.txt"), collapse_tabs=True)
    assert joined.count() == 2
    (tmp_path / "b.txt").write_text("name\t1\nx\t1\n")
    with pytest.raises(ValueError):
        attribute_cells(spark, str(tmp_path / "b.txt"))
    (tmp_path / "c.txt").write_text("\n\n")
    with pytest.raises(ValueError):
        attribute_cells(spark, str(tmp_path / "c.txt"))


def test_tolerant_casts(spark):
    texts = [" 1.5 ", "1.5d", "abc", "NaN", "", None, "-2e3", "7f"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(to_number("t")).collect()] == [1.5, None, None, None, None, None, -2000.0, None]
    days = spark.createDataFrame([("2000-02-30",), ("2000-02-29",), ("x",)], "t string")
    assert [str(r[0]) for r in days.select(to_time("t")).collect()] == ["None", "2000-02-29", "None"]
    low = spark.createDataFrame([(-1.0,), (None,), (2.0,)], "x double")
    assert [r[0] for r in low.select(floor_zero("x")).collect()] == [0.0, None, 2.0]
    lists = spark.createDataFrame([("['a', 'b']",), ("oops",), (None,), ("[]",)], "t string")
    assert [r[0] for r in lists.select(parse_list("t")).collect()] == [["a", "b"], [], [], []]


def test_names():
    assert normal_names([" Mean Temp.", "a-b/c"]) == ["mean_temp_", "a_b_c"]
    assert is_zero_feature("swe_mm_lag3") and is_zero_feature("x_lag2") and is_zero_feature("dd_above5")
    assert not is_zero_feature("tmin_c") and not is_zero_feature("x_lag2_b")


def test_panel_sink_and_scan(spark, tmp_path):
    rows = [("0012", "2000-01-01", 1.0), ("0012", "2000-01-02", float("nan")), ("7", "2000-01-01", 3.0)]
    df = coerce_keys(spark.createDataFrame(rows, "basin_id string, date string, v double"))
    write_panel(df, str(tmp_path / "parts"), partition=True)
    got = read_panel(spark, str(tmp_path / "parts"))
    assert sorted((r["basin_id"], str(r["date"]), r["v"]) for r in got.collect()) == [
        ("0012", "2000-01-01", 1.0),
        ("0012", "2000-01-02", None),
        ("7", "2000-01-01", 3.0),
    ]


def test_a_hot_series_is_written_by_many_tasks(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(4000).select(
            F.when(F.col("id") % 4 == 0, F.col("id").cast("string")).otherwise("hot").alias("basin_id"),
            F.expr("date_add(date'2000-01-01', cast(id as int))").alias("date"),
        )
        write_panel(df, str(tmp_path / "p"), partition=True)
        assert len(list((tmp_path / "p" / "basin_id=hot").glob("*.parquet"))) >= 4
        assert read_panel(spark, str(tmp_path / "p")).count() == 4000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_finer_time(spark):
    df = spark.createDataFrame([("a", "2000-01-01 05:30:00"), ("a", "x")], "basin_id string, date string")
    kept = coerce_keys(df, time_type="timestamp_ntz").orderBy("date").collect()
    assert [str(r["date"]) for r in kept] == ["None", "2000-01-01 05:30:00"]


def test_metric_file(spark, tmp_path):
    table = spark.createDataFrame(
        [("12.0", 0.5, ["a", "b"]), ("7", None, [])], "basin_id string, test_R2 double, used array<string>"
    )
    write_csv(table, str(tmp_path / "m"))
    got = read_metrics(spark, str(tmp_path / "m"), numbers=["test_R2"])
    got = got.withColumn("used", parse_list("used")).orderBy("basin_id").collect()
    assert [tuple(r) for r in got] == [("12", 0.5, ["a", "b"]), ("7", None, [])]


def test_artifacts(spark, tmp_path):
    (tmp_path / "te.json").write_text('{"mapping": {"1": 0.5, "2": 0.25}, "global_mean": 0.4}')
    table, mean = read_encoding(spark, str(tmp_path / "te.json"))
    assert {r[0]: r[1] for r in table.collect()} == {"1": 0.5, "2": 0.25} and mean.first()[0] == 0.4
    (tmp_path / "order.json").write_text('{"feature_order": ["b", "a", "basin_te"]}')
    assert read_feature_order(spark, str(tmp_path / "order.json")) == ["b", "a", "basin_te"]
    (tmp_path / "bad.json").write_text('{"feature_order": ["a"]}')
    with pytest.raises(ValueError):
        read_feature_order(spark, str(tmp_path / "bad.json"))
    (tmp_path / "broken.json").write_text("{ not json")
    for name in ("none.json", "broken.json"):
        assert read_artifact(spark, str(tmp_path / name), SERVING_SCHEMA).filter("basins is not null").count() == 0
        assert read_serving_policy(spark, str(tmp_path / name)).count() == 0
    (tmp_path / "gating.json").write_text('{"feature_exclude": {"1": ["x", "y"]}, "rules": {"a": 1}}')
    assert sorted(map(tuple, read_exclusions(spark, str(tmp_path / "gating.json")).collect())) == [("1", "x"), ("1", "y")]
    (tmp_path / "policy.json").write_text(
        '{"basins": {"1": {"mode": "local_lite", "model_path": "m", "feature_order": ["a"]}, "2": {"mode": "global"}}}'
    )
    got = {r["basin_id"]: r for r in read_serving_policy(spark, str(tmp_path / "policy.json")).collect()}
    assert got["1"]["feature_order"] == ["a"] and got["2"]["model_path"] is None
    rows = artifact_manifest(spark, str(tmp_path), {"te": "te.json", "model": "model.json"}).collect()
    got = {r["artifact"]: r for r in rows}
    assert got["te"]["sha256"] == hashlib.sha256((tmp_path / "te.json").read_bytes()).hexdigest()
    assert got["te"]["exists"] and got["te"]["size_bytes"] == (tmp_path / "te.json").stat().st_size
    assert not got["model"]["exists"] and got["model"]["mtime"] is None


def test_master_drops_targetless_rows_first(spark):
    q = spark.createDataFrame([("a", "2000-01-01", 1.0), ("a", "2000-01-02", None)], "basin_id string, date string, discharge_mm double")
    p = spark.createDataFrame([("a", "2000-01-01", -4.0), ("b", "2000-01-01", 4.0)], "basin_id string, date string, prcp_mm_cr2met double")
    rows = build_master(coerce_keys(q), [coerce_keys(p)]).collect()
    assert [(r["basin_id"], r["discharge_mm"], r["prcp_mm_cr2met"]) for r in rows] == [("a", 1.0, None)]
    assert coerce_keys(q.withColumn("basin_id", F.lit(None).cast("string"))).count() == 0


def test_many_quoted_fields_and_other_dates(spark, tmp_path):
    names = ["date"] + [f'"id {i}\t{i}"' for i in range(20_000)]
    (tmp_path / "wide.txt").write_text("\t".join(names) + "\n2000/01/02\t" + "\t".join(["1"] * 20_000) + "\n20000103\t2\n01-04-2000\t3\n")
    rows = read_wide(spark, str(tmp_path / "wide.txt"), "v").filter("v is not null")
    assert rows.count() == 20_002
    assert sorted(str(r[0]) for r in rows.select("date").distinct().collect()) == ["2000-01-02", "2000-01-03", "2000-01-04"]


def test_manifest_of_folders(spark, tmp_path):
    spark.range(50).repartition(3).write.json(str(tmp_path / "te"))
    rows = {r["artifact"]: r for r in artifact_manifest(spark, str(tmp_path), {"te": "te", "gone": "t"}).collect()}
    assert rows["te"]["exists"] and len(rows["te"]["sha256"]) == 64 and not rows["gone"]["exists"]
    assert rows["te"]["size_bytes"] == sum(p.stat().st_size for p in (tmp_path / "te").iterdir() if p.name[0] not in "._")
