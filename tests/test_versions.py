"""Versioned artifacts and the micro-batches that are pinned to them."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from freshet.plans.versions import folder_of, publish, versions
from freshet.session import listed
from freshet.streaming.scoring import pinned, read_requests, read_scores, versioned_batch, write_versioned_scores


class Table:
    """Stands in for the stored artifacts: answers with what its version's policy says."""

    def __init__(self, policy):
        self.policy = policy

    def score(self, requests):
        return requests.drop("features").crossJoin(F.broadcast(self.policy))


def load(spark, folder):
    return Table(spark.read.schema("answer string").json(f"{folder}/policy"))


def answering(spark, text):
    return lambda folder: spark.createDataFrame([(text,)], "answer string").write.json(f"{folder}/policy")


@pytest.fixture
def base(tmp_path):
    return str(tmp_path)


def test_versions_count_once_they_are_complete(spark, base):
    root = f"{base}/artifacts"
    assert versions(spark, root) == []
    with pytest.raises(FileNotFoundError):
        pinned(spark, root, f"{base}/pins", 0)
    assert publish(spark, root, answering(spark, "a")) == 1

    def broken(folder):
        answering(spark, "b")(folder)
        raise OSError("lost")

    with pytest.raises(OSError):
        publish(spark, root, broken)
    assert versions(spark, root) == [1] and pinned(spark, root, f"{base}/pins", 0) == 1
    assert publish(spark, root, answering(spark, "c")) == 3  # the number of the broken one is not used again
    assert versions(spark, root) == [1, 3] and listed(spark, f"{folder_of(root, 2)}/policy")
    assert pinned(spark, root, f"{base}/pins", 0) == 1 and pinned(spark, root, f"{base}/pins", 1) == 3


def test_a_repeated_batch_keeps_its_version_and_its_rows(spark, base):
    root, out = f"{base}/artifacts", f"{base}/out"
    publish(spark, root, answering(spark, "old"))
    batch = spark.createDataFrame([("1", {"x": 1.0}), ("2", {"x": 2.0})], "basin_id string, features map<string,double>")
    versioned_batch(root, out, load)(batch, 0)
    publish(spark, root, answering(spark, "new"))
    versioned_batch(root, out, load)(batch, 0)  # a new driver repeats the batch after the new version came
    versioned_batch(root, out, load)(batch, 1)
    got = sorted((r["batch"], r["basin_id"], r["answer"], r["version"]) for r in read_scores(spark, out).collect())
    assert got == [(0, "1", "old", 1), (0, "2", "old", 1), (1, "1", "new", 2), (1, "2", "new", 2)]


def test_a_pin_that_was_not_finished_is_taken_again(spark, base):
    root, pins = f"{base}/artifacts", f"{base}/pins"
    publish(spark, root, answering(spark, "a"))
    half = Path(pins) / "batch=4"
    half.mkdir(parents=True)
    (half / "part-0.json").write_text('{"version": 9}')
    assert pinned(spark, root, pins, 4) == 1 and pinned(spark, root, pins, 4) == 1


def test_the_policy_changes_between_batches_of_one_stream(spark, base):
    root, out = f"{base}/artifacts", f"{base}/out"
    publish(spark, root, answering(spark, "old"))
    for turn, answer in enumerate(("old", "new")):
        rows = [(f"{turn}{k}", {"x": None if k else 1.0}) for k in range(5)]
        spark.createDataFrame(rows, "basin_id string, features map<string,double>").coalesce(1).write.mode("append").json(f"{base}/requests")
        write_versioned_scores(read_requests(spark, f"{base}/requests"), root, out, f"{base}/log", load=load).awaitTermination()
        publish(spark, root, answering(spark, "new"))
    got = sorted((r["basin_id"], r["answer"], r["version"]) for r in read_scores(spark, out).collect())
    assert got == [(f"{turn}{k}", answer, turn + 1) for turn, answer in enumerate(("old", "new")) for k in range(5)]
