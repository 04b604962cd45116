"""Merkle manifest of a table by a cogrouped exchange of subtrees.

Rows are leaves, ordered by id inside their group; every run of ``WIDTH`` consecutive nodes is hashed to a node of the
next level until one is left, the group's subroot, and the subroots, ordered by group, make the root the same way.

A superblock is ``WIDTH ** LEVELS`` consecutive leaves. Superblocks are reduced on their own, their
nodes are the leaves of the next round, and so on: rounds grow with the logarithm of the rows. On the way back each
superblock is cogrouped with the few outer nodes that it needs, those beside the path from its own node to the root;
there local reduction, the joining of proofs and the folding of claimed leaves end in one task. So a group that holds a
third of all rows is many superblocks, and no task sees more than a superblock's nodes at once.

Null ids come first, null groups before all others. Rows with equal group and id stand in the order of their leaves, and
rows that are equal altogether are leaves of their own. An empty table has no rows, hence no root. Columns other than
the hashed ones are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.llm import common
from freshet.session import store

WIDTH = 16
#: Levels of a superblock, which has up to WIDTH ** LEVELS leaves.
LEVELS = 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(text: str) -> str:
    """H of the contract: lower-case hex of the SHA-256 of a string."""
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(fields: Sequence[Column]) -> Column:
    """H of the fields, each as its length in bytes, a colon and its text, or ``-`` if null."""
    text = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256)


def leaves(docs: DataFrame, fields: Sequence[str], tampered: Column | None = None, changed: Column | None = None, *, group_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``group, doc_id, leaf, claimed`` of every row; ``claimed`` is the leaf of the ``changed`` text where ``tampered`` holds.

    ``group`` is the group's text behind a mark, so that a null group sorts before the empty text.
    """
    own = [F.col(f"`{c}`") for c in fields]
    plain = leaf(own)
    claimed = plain
    if tampered is not None:
        claimed = F.when(tampered, leaf([changed if c == text_col else f for c, f in zip(fields, own)])).otherwise(plain)
    group = F.coalesce(F.concat(F.lit("="), F.col(f"`{group_col}`").cast("string")), F.lit(""))
    return docs.select(group.alias("group"), F.col(f"`{id_col}`").alias("doc_id"), plain.alias("leaf"), claimed.alias("claimed"))


def numbered(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Add ``pos``, the place of a row among those of its ``group`` from 0, and ``size``, the rows of the group.

    Rows are range-partitioned by group and order, so a large group spreads over many tasks; each task counts its own
    runs, and what stands before a run is the sum of one number per task and group. ``df`` must be stored.
    """
    schema = df.schema
    by = ["group", *order, "_at"]  # ties are split by the running number, so equal rows spread too
    spread = df.withColumn("_at", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by).drop("_at")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, upto = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            group = batch.column("group")
            starts = np.ones(n, dtype=bool)
            starts[1:] = pc.not_equal(group[1:], group[:-1]).to_numpy(zero_copy_only=False)
            starts[0] = group[0].as_py() != last
            at = np.arange(n)
            begin = np.maximum.accumulate(np.where(starts, at, -1))
            number = np.where(begin < 0, at + upto, at - begin)
            last, upto = group[n - 1].as_py(), int(number[-1]) + 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(n, part, dtype=np.int32)), pa.array(number)], names=[*batch.schema.names, "part", "number"]
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    placed = store(spread.mapInArrow(count, f"{fields}, part int, number bigint"), "placed")
    runs = placed.groupBy("group", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.select(
        "group", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy("group")).alias("size")
    )
    joined = common.join_small(placed, store(offsets, "offsets"), ["group", "part"], "inner")
    return joined.select(*schema.names, (F.col("before") + F.col("number")).alias("pos"), "size")


def _levels(size: int, most: int) -> int:
    """Levels that a superblock of a group of ``size`` nodes is reduced by."""
    levels = 0
    while levels < most and WIDTH**levels < size:
        levels += 1
    return levels


def reduce(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes of every level, from the given ones to the superblock's own."""
    out = [nodes]
    for _ in range(levels):
        nodes = [digest("".join(nodes[i : i + WIDTH])) for i in range(0, len(nodes), WIDTH)]
        out.append(nodes)
    return out


def beside(levels: list[list[str]]) -> list[list[tuple[str, str]]]:
    """For every node of every level but the last, what stands in its run to the left and to the right."""
    out = []
    for nodes in levels[:-1]:
        sides = []
        for i in range(len(nodes)):
            begin = i - i % WIDTH
            sides.append(("".join(nodes[begin:i]), "".join(nodes[i + 1 : begin + WIDTH])))
        out.append(sides)
    return out


_KEY = ["group", "block"]


def _blocks(nodes: DataFrame, node: str, levels: int) -> DataFrame:
    return nodes.withColumn("block", F.shiftright("pos", levels * 4)).withColumnRenamed(node, "node")  # WIDTH is 2 ** 4


def climb(nodes: DataFrame, node: str, levels: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """The nodes of every round, and per round the ``group, node`` of those groups that it brought down to one node."""

    def up(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        size = int(rows["size"].iat[0])
        own = reduce(rows["node"].tolist(), _levels(size, levels))[-1][0]
        return pd.DataFrame({"group": rows["group"].iat[0], "pos": rows["block"].iat[0], "size": -(-size // WIDTH**levels), "node": own}, index=[0])

    rounds, ends, here = [], [], _blocks(nodes, node, levels)
    while True:
        rounds.append(here)
        above = here.select(*_KEY, "pos", "size", "node").groupBy(*_KEY).applyInPandas(up, "group string, pos bigint, size bigint, node string")
        above = store(above, "nodes")
        ends.append(above.where("size = 1").select("group", "node"))
        here = above.where("size > 1")
        if here.isEmpty():
            return rounds, ends
        here = _blocks(here, "node", levels)


PATH = "path array<string>, subroot string, root string"


def descend(rounds: list[DataFrame], ends: list[DataFrame], tops: DataFrame, finish, schema: str, levels: int) -> DataFrame:
    """Hand the outer nodes down, round by round, and apply ``finish`` to every superblock of the lowest one.

    ``tops`` holds the ``group, path, subroot, root`` of every group, ``path`` being the left and right neighbours level
    by level. ``finish`` takes a superblock's rows in order, the neighbours by level and the outer row.
    """

    def joined(last):
        def run(rows: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("pos", ignore_index=True)
            sides = beside(reduce(rows["node"].tolist(), _levels(int(rows["size"].iat[0]), levels)))
            return last(rows, sides, outer.iloc[0])

        return run

    def handed(rows: pd.DataFrame, sides: list, outer: pd.Series) -> pd.DataFrame:
        paths = [[x for k, level in enumerate(sides) for x in level[i // WIDTH**k]] + list(outer["path"]) for i in range(len(rows))]
        return pd.DataFrame({"group": rows["group"], "block": rows["pos"], "path": paths, "subroot": outer["subroot"], "root": outer["root"]})

    below = None
    for turn in reversed(range(len(rounds))):
        outer = tops.join(ends[turn].select("group"), "group").select("group", F.lit(0).cast("long").alias("block"), "path", "subroot", "root")
        if below is not None:
            outer = outer.union(below)
        last, made = (finish, schema) if turn == 0 else (handed, f"group string, block bigint, {PATH}")
        outer = outer.select(F.col("group").alias("outer_group"), F.col("block").alias("outer_block"), "path", "subroot", "root")
        given = rounds[turn].groupBy(*_KEY).cogroup(outer.groupBy("outer_group", "outer_block"))
        below = given.applyInPandas(joined(last), made)
        if turn:
            below = store(below, "outer")
    return below


def fold(claimed: str, sides: list[tuple[str, str]]) -> str:
    """The root that a leaf and what stands beside its path give."""
    for left, right in sides:
        claimed = digest(left + claimed + right)
    return claimed


def manifest(rows: DataFrame, levels: int = LEVELS) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof, folded_root, verified`` of every row of ``leaves``.

    ``proof`` are the hashes beside the leaf's path, joined level by level; ``folded_root`` is what the claimed leaf and
    the proof give, ``verified`` whether that is the root. The result doesn't depend on ``levels``, those of a superblock.
    """
    rows = store(rows, "leaves")
    kind = rows.schema["doc_id"].dataType.simpleString()
    # pandas has no column of integers and nulls, so ids travel as text
    placed = numbered(rows, ["doc_id", "leaf", "claimed"]).withColumn("doc_id", F.col("doc_id").cast("string"))
    rounds, ends = climb(store(placed, "numbered"), "leaf", levels)
    subroots = ends[0]
    for more in ends[1:]:
        subroots = subroots.union(more)
    subroots = store(subroots.select(F.lit("").alias("group"), F.col("group").alias("name"), F.col("node").alias("subroot")), "subroots")
    upper, tops = climb(store(numbered(subroots, ["name"]), "numbered"), "subroot", levels)
    root = tops[0]
    for more in tops[1:]:
        root = root.union(more)
    top = root.select("group", F.array().cast("array<string>").alias("path"), F.lit("").alias("subroot"), F.col("node").alias("root"))

    def named(rows: pd.DataFrame, sides: list, outer: pd.Series) -> pd.DataFrame:
        paths = [[x for k, level in enumerate(sides) for x in level[i // WIDTH**k]] + list(outer["path"]) for i in range(len(rows))]
        return pd.DataFrame({"group": rows["name"], "path": paths, "subroot": rows["node"], "root": outer["root"]})

    paths = store(descend(upper, tops, top, named, f"group string, {PATH}", levels), "paths")

    def proved(rows: pd.DataFrame, sides: list, outer: pd.Series) -> pd.DataFrame:
        flat = list(outer["path"])
        above = list(zip(flat[::2], flat[1::2]))
        tail = "".join(flat)
        proofs, folded = [], []
        for i, claimed in enumerate(rows["claimed"]):
            own = [level[i // WIDTH**k] for k, level in enumerate(sides)]
            proofs.append("".join([left + right for left, right in own]) + tail)
            folded.append(fold(claimed, own + above))
        return pd.DataFrame(
            {
                "doc_id": rows["doc_id"], "leaf": rows["node"], "subroot": outer["subroot"], "root": outer["root"],
                "proof": proofs, "folded_root": folded, "verified": [x == outer["root"] for x in folded],
            }
        )

    schema = "doc_id string, leaf string, subroot string, root string, proof string, folded_root string, verified boolean"
    return descend(rounds, ends, paths, proved, schema, levels).withColumn("doc_id", F.col("doc_id").cast(kind))
