"""Bucketed storage: the same rows, fewer exchanges, files by bucket."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from freshet.catalog import fixture
from freshet.operators import blocks
from freshet.operators.features import build_features
from freshet.operators.master import build_master
from freshet.plans import panel
from freshet.session import scratch_path
from freshet.sources.buckets import pruned, read_buckets, write_buckets

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return len(re.findall(r"(?:^|[-+ ])Exchange\b", plan(df), flags=re.M))


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.fixture(scope="module")
def master(spark):
    return fixture.master(spark, SF)


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def inputs(master):
    return [master.select("basin_id", "date", c) for c in ("discharge_mm", "tmin_c", "tmax_c", "prcp_mm_cr2met", "pet_mm_hargreaves")]


def test_joins_of_the_master_need_no_exchange(spark, master, no_broadcast):
    folder = scratch_path(spark, "buckets")
    stored = [write_buckets(t, f"{folder}/{i}", buckets=5) for i, t in enumerate(inputs(master))]
    df = build_master(stored[0], stored[1:])
    assert plan(df).count("SortMergeJoin") == 4 and exchanges(df) == 0
    again = [read_buckets(spark, f"{folder}/{i}") for i in range(5)]
    opened = build_master(again[0], again[1:])
    assert exchanges(opened) == 0
    target, *forcings = inputs(master)
    assert rows(df) == rows(opened) == rows(build_master(target, forcings))


def test_features_need_no_exchange_on_buckets_of_the_key(spark, master, no_broadcast):
    df = panel.bucketed_feature_panel(inputs(master), scratch_path(spark, "buckets"), buckets=5)
    assert plan(df).count("Window ") == 1 and exchanges(df) == 0
    target, *forcings = inputs(master)
    assert rows(df) == rows(build_features(build_master(target, forcings)))


def test_a_long_series_is_spread_over_the_buckets(spark, master):
    longest = master.groupBy("basin_id").count().agg(F.max("count")).first()[0]
    assert blocks.window_columns(master) == ["basin_id"]
    assert blocks.window_columns(master, block_rows=longest - 1) == ["basin_id", "date"]
    assert blocks.window_columns(master.limit(0)) == ["basin_id"]


def test_files_by_bucket_and_skipped_buckets(spark, master, capsys):
    path = scratch_path(spark, "buckets")
    stored = write_buckets(master, path, by=["basin_id"], buckets=4)
    assert len(list(Path(path.removeprefix("file:")).glob("*.parquet"))) <= 4
    one = pruned(stored, ["3"])
    # otherwise the plan reads the same buckets, but as plain files, and does not say so
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    try:
        pruned(stored, ["3"]).explain("formatted")
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert "SelectedBucketsCount: 1 out of 4" in capsys.readouterr().out
    assert rows(one) == rows(pruned(master, ["3"]))


def test_null_keys_empty_tables_and_odd_names(spark):
    odd = spark.createDataFrame([(None, 1, "x"), ("a", None, None), ("a", 2, "y"), ("a", 2, "y")], "`a key` string, at int, `select` string")
    for df in (odd, odd.limit(0)):
        path = scratch_path(spark, "buckets")
        write_buckets(df, path, by=["a key", "at"], order=["a key", "at"], buckets=3)
        assert rows(read_buckets(spark, path)) == rows(df) and read_buckets(spark, path).schema == df.schema
