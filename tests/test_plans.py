"""Shape of the physical plans: exchanges, windows, broadcasts, pushdown."""

import re

import pytest
from pyspark.sql import functions as F

from freshet import session
from freshet.catalog import fixture
from freshet.operators.encode import apply_target_encoding
from freshet.operators.features import build_features
from freshet.operators.master import attach_static, build_master
from freshet.operators.metrics import regression_metrics
from freshet.operators.split import cap_per_series
from freshet.session import broadcast_checked, settle, shared_dir, store

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def nodes(df, name: str) -> int:
    return len(re.findall(rf"(?:^|[-+ ]){name}\b", plan(df), flags=re.M))


@pytest.fixture(scope="module")
def master(spark):
    return fixture.master(spark, SF)


def test_all_features_share_one_exchange_and_one_window(spark, master):
    attrs = store(fixture.attributes(spark, SF))
    df = build_features(master, attrs)
    assert nodes(df, "Exchange") == 1 and nodes(df, "Window") == 1 and nodes(df, "Sort") == 1
    assert nodes(df, "BroadcastHashJoin") == 1 and nodes(df, "SortMergeJoin") == 0


def test_unused_columns_are_not_read(master):
    df = build_features(master).select("basin_id", "date", "tmin_c_lag1")
    read = re.search(r"ReadSchema: struct<(.*?)>", plan(df)).group(1)
    assert sorted(c.split(":")[0] for c in read.split(",")) == ["basin_id", "date", "tmin_c"]


def test_key_filter_reaches_the_scan(master):
    df = build_features(master).filter("basin_id = '3'")
    assert "EqualTo(basin_id,3)" in plan(df)


def test_each_master_input_is_shuffled_once(spark, master, monkeypatch):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        target = master.select("basin_id", "date", "discharge_mm")
        parts = [store(master.select("basin_id", "date", c)) for c in ("tmin_c", "tmax_c", "prcp_mm_cr2met")]
        df = build_master(target, parts)
        assert nodes(df, "SortMergeJoin") == 3 and nodes(df, "Exchange") == 4
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_scores_need_one_exchange(spark, master):
    df = regression_metrics(master, "tmin_c", "tmax_c")
    assert nodes(df, "Exchange") == 1 and "partial_avg" in plan(df)


def test_cap_limits_before_the_shuffle(master):
    df = cap_per_series(master.withColumn("side", F.lit("train")), {"train": 5})
    assert "WindowGroupLimit" in plan(df) and nodes(df, "Exchange") == 1


def test_only_small_sides_are_broadcast(spark, master):
    small = settle(spark.createDataFrame([("1", 0.5)], "basin_id string, enc double"))
    assert nodes(apply_target_encoding(master, small, 0.1), "BroadcastHashJoin") == 1
    hinted = lambda df: "hint" in df._jdf.queryExecution().logical().toString().lower()
    rows = spark.range(30).select(F.col("id").cast("string").alias("basin_id"), "id")
    assert hinted(broadcast_checked(rows, max_cells=60))
    assert not hinted(broadcast_checked(rows, max_cells=58))


def test_no_cross_join_anywhere(spark):
    import __spark_entry__ as entry

    for name in ("target_encoding", "encoded_rows", "common_features", "serving_policy", "serving_mode"):
        text = plan(entry.queries()[name](spark, SF))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_the_shared_folder_of_the_session_is_used(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert shared_dir(spark) == (named or spark.sparkContext.getCheckpointDir())
    assert session.scratch_path(spark, "x").startswith(shared_dir(spark))


def test_attributes_keep_all_rows(spark, master):
    attrs = fixture.attributes(spark, SF).filter("basin_id <> '3'")
    assert attach_static(master, attrs).count() == master.count()
