"""N-gram Jaccard join: documents whose sets of word n-grams are alike, as a blocked sparse matrix product.

The incidence matrix of documents by n-grams is multiplied with its transpose, restricted to the part that size
bounds leave: two sets that reach the threshold share an n-gram among the first ``n - need + 1`` of either, in any
fixed order of all n-grams, where ``need`` is the smallest overlap that a set of that size allows. Rare n-grams come
first in the order. Documents with equal sets are one class and enter once.

Columns are cut into blocks by set size, and only neighbouring blocks meet. The products of short columns are formed
at once. In long ones a hub of each block is multiplied with the rest, and members that turn out linked share a label.
What is left between different labels is mostly near copies of one text below the threshold. Their sets are written as
differences from a hub: sets whose differences have no n-gram in common are linked only if both are linked with the hub,
and others meet again in the first n-grams of their differences, so what all of them share no longer counts. N-grams
that the hub does not have come first. Sets that have none of these in common lie together in the hub only, and a set is at
least as like the hub as another one that is no smaller than the hub; so n-grams that only the hub has are needed for a few
sets smaller than it and those next to the threshold. Columns of differences that are still long get hubs of their own.
So no link between labels is lost.
Sketches of two sets bound how much they differ; overlaps of pairs within that bound are counted over whole sets.

A null, empty or blank text has an empty set and is linked with nothing. A text with fewer than ``n`` words has one
n-gram, all of its words. Rows may repeat; null ids count as larger than all others. Sets are told apart by 64-bit
digests.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from freshet.llm import common
from freshet.llm.components import components
from freshet.session import store

#: N-grams that repeat inside a block of so many are counted as frequent; the most frequent steer the order.
BLOCK = 1_000_000
FREQUENT_KEPT = 500_000
#: Columns with at most this many products per entry between labels are multiplied whole, longer ones by hubs.
LEFT_PER_ENTRY = 16
#: After so many rounds of differences, or one that leaves long columns half their length, the rest of every column is multiplied whole.
HUB_ROUNDS = 4
#: Bits of a sketch, and of a short one.
SKETCH_BITS = 1024
SHORT_BITS = 256
#: Members of a column, about so many, that tell what most of them hold; only the choice of its hub depends on them.
CENTRE_OF = 64


def ngrams(text: str, n: int) -> np.ndarray | None:
    """Distinct hashed n-grams of the lower-cased words, ascending; None without words."""
    words = common.encode(text).lower().split()
    if not words:
        return None
    data, begin, end = common.word_spans(words)
    m = min(n, len(words))
    return np.unique(common.span_hashes(common.prefix_hashes(data), begin[: len(words) - m + 1], end[m - 1 :]))


def digest(found: np.ndarray) -> int:
    return int.from_bytes(xxhash.xxh3_64_digest(found.tobytes()), "little", signed=True)


def need(size: np.ndarray | int, percent: int) -> np.ndarray | int:
    """Smallest overlap with which a set of this size can reach the threshold."""
    return -(-percent * size // 100)


def apart(sizes, percent: int):
    """Most n-grams in which two sets of these sizes together may differ if they reach the threshold."""
    return (100 - percent) * sizes // (100 + percent)


def least_common(sizes, percent: int):
    """Fewest n-grams that two sets of these sizes together have in common if they reach the threshold."""
    return -(-percent * sizes // (100 + percent))


def sketch(found: np.ndarray) -> np.ndarray:
    """Parities of the n-grams in each of ``SKETCH_BITS`` classes; two sets differ at least in as many n-grams as their sketches in bits."""
    odd = np.bincount((found & np.uint64(SKETCH_BITS - 1)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.int64)


def members(df: DataFrame, n: int) -> DataFrame:
    """``doc_id, row, size, class, sketch`` of every row; class and sketch are null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [ngrams(t.as_py(), n) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row")]
                + [pa.array([0 if f is None else len(f) for f in found], type=pa.int64()), pa.array([None if f is None else digest(f) for f in found], type=pa.int64())]
                + [pa.array([None if f is None else sketch(f) for f in found], type=pa.list_(pa.int64()))],
                names=["doc_id", "row", "size", "class", "sketch"],
            )

    return df.mapInArrow(run, "doc_id bigint, row bigint, size bigint, class bigint, sketch array<bigint>")


def frequent(df: DataFrame, n: int) -> dict:
    """Level of n-grams that repeat among the documents of some block; only the order depends on it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, seen = [], 0, set()

        def out() -> pa.RecordBatch:
            value, times = np.unique(np.concatenate(held), return_counts=True)
            many = times > 1
            return pa.RecordBatch.from_arrays([pa.array(value[many].view(np.int64)), pa.array(times[many].astype(np.int64))], names=["gram", "times"])

        for batch in batches:
            for text in batch.column("text"):
                found = ngrams(text.as_py(), n)
                if found is None or (d := digest(found)) in seen:
                    continue
                seen.add(d)
                held.append(found)
                count += len(found)
                if count >= BLOCK:
                    yield out()
                    held, count, seen = [], 0, set()
        if held:
            yield out()

    times = df.select("text").mapInArrow(run, "gram bigint, times bigint").groupBy("gram").agg(F.sum("times").alias("times"))
    most = times.where("times >= 4").orderBy(F.desc("times"), "gram").limit(FREQUENT_KEPT).toArrow()
    grams = most["gram"].to_numpy().view(np.uint64)
    order = np.argsort(grams)
    return {"grams": grams[order], "level": np.log2(most["times"].to_numpy().astype(float)[order]).astype(np.uint8)}


def in_order(found: np.ndarray, order: dict, most: int) -> np.ndarray:
    """The first n-grams of an ascending set in the order of all n-grams, at most so many."""
    known = order["grams"]
    level = np.zeros(len(found), dtype=np.uint8)
    if len(known):
        at = np.minimum(np.searchsorted(known, found), len(known) - 1)
        same = known[at] == found
        level[same] = order["level"][at[same]] + 1
    return found[np.argsort(level, kind="stable")[:most]]


def entries(df: DataFrame, n: int, percent: int, order: Broadcast) -> DataFrame:
    """Entries of the restricted matrix: ``gram, class, size, pos``, columns with one class left out; stored.

    ``pos`` is the n-gram's position among those of its set, in the order of all n-grams.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            grams, classes, sizes, places = [], [], [], []
            for text in batch.column("text"):
                found = ngrams(text.as_py(), n)
                if found is None or (d := digest(found)) in seen:
                    continue
                if len(seen) >= 1_000_000:
                    seen.clear()
                seen.add(d)
                part = in_order(found, order.value, len(found) - need(len(found), percent) + 1)
                grams.append(part)
                classes.append(np.full(len(part), d, dtype=np.int64))
                sizes.append(np.full(len(part), len(found), dtype=np.int32))
                places.append(np.arange(len(part), dtype=np.int32))
            if grams:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x)) for x in ([g.view(np.int64) for g in grams], classes, sizes, places)], names=names
                )

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None  # the last entry, and whether its column already has another
        for batch in batches:
            if not batch.num_rows:
                continue
            g, c, s, p = (batch.column(k).to_numpy() for k in range(4))
            hit = np.zeros(len(g), dtype=bool)
            if carry is not None:
                g, c, s, p = (np.concatenate([a, b]) for a, b in zip(carry[0], (g, c, s, p)))
                hit = np.concatenate([[carry[1]], hit])
            again = np.zeros(len(g), dtype=bool)
            again[1:] = (g[1:] == g[:-1]) & (c[1:] == c[:-1])
            keep = ~again
            g, c, s, p, hit = g[keep], c[keep], s[keep], p[keep], hit[keep]
            if len(g) > 1:
                near = g[1:] == g[:-1]
                hit[1:] |= near
                hit[:-1] |= near
            yield pa.RecordBatch.from_arrays([pa.array(x[:-1][hit[:-1]]) for x in (g, c, s, p)], names=names)
            carry = ([x[-1:].copy() for x in (g, c, s, p)], bool(hit[-1]))
        if carry is not None and carry[1]:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in carry[0]], names=names)

    names, schema = ["gram", "class", "size", "pos"], "gram bigint, class bigint, size int, pos int"
    spread = df.select("text").mapInArrow(run, schema).repartition("gram").sortWithinPartitions("gram", "class")
    return store(spread.mapInArrow(shared, schema), "entries")


def sets_of(df: DataFrame, named: DataFrame, who: DataFrame, n: int) -> DataFrame:
    """``class, grams`` of the distinct classes in the stored ``named``, again for a row with equal id and text; stored. ``who`` names a row for each class."""
    rows = store(common.join_small(who.select("doc_id", "row", "class"), named, ["class"], "inner"), "classes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [ngrams(t.as_py(), n).view(np.int64) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("class"), pa.array(found, type=pa.list_(pa.int64()))], names=["class", "grams"])

    return store(common.join_small(df, rows, ["doc_id", "row"], "inner").select("class", "text").mapInArrow(run, "class bigint, grams array<bigint>"), "sets")


def _ends(pairs: DataFrame) -> DataFrame:
    """``class``: all classes in the pairs ``a, b``; stored."""
    return store(pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct(), "ends")


def overlaps(df: DataFrame, pairs: DataFrame, who: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs ``a, b`` of classes whose sets reach the threshold; stored.

    Overlaps are counted over whole sets, of pairs whose sketches do not differ too much.
    """
    known = store(common.join_small(who.select("class", "size", "sketch"), _ends(pairs), ["class"], "inner"), "sketches")
    for side in "ab":
        pairs = common.join_small(pairs, known.select(F.col("class").alias(side), F.col("size").alias(f"size_{side}"), F.col("sketch").alias(f"sketch_{side}")), [side], "inner")
    differ = sum((F.bit_count(F.col("sketch_a")[k].bitwiseXOR(F.col("sketch_b")[k])) for k in range(SKETCH_BITS // 64)), F.lit(0))
    close = store(pairs.where(differ * (100 + percent) <= (F.col("size_a") + F.col("size_b")) * (100 - percent)).select("a", "b"), "close")
    if close.isEmpty():
        return close
    sets = sets_of(df, _ends(close), who, n)
    left, right = sets.select(F.col("class").alias("a"), F.col("grams").alias("x")), sets.select(F.col("class").alias("b"), F.col("grams").alias("y"))
    both = close.join(right.hint("merge"), "b").join(left.hint("merge"), "a")
    counted = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("same"), (F.size("x") + F.size("y")).alias("sizes"))
    return store(counted.where(F.col("same") * 100 >= (F.col("sizes") - F.col("same")) * percent).select("a", "b").distinct(), "linked")


def differences(df: DataFrame, near: DataFrame, who: DataFrame, n: int, percent: int, order: Broadcast) -> DataFrame:
    """``hub, class, size, over, d, more, most, linked, loose, elems`` for the stored ``hub, class, low``; stored.

    ``d`` n-grams stand in one of both sets only, ``more`` of them in the class; the hub has ``over`` more n-grams than the
    class. Two linked sets differ by ``most`` n-grams at most, so ``elems`` are the first ``most + 1`` of the difference,
    those of the class first, up to the place behind which too few n-grams are left to have in common with a set of ``low``. Those of the hub only count between a ``loose`` set and one smaller than the hub. A loose
    set is not linked with the hub, yet may be with a set of at least ``low`` n-grams, all their common ones in the hub.
    """
    sets = sets_of(df, store(near.select(F.explode(F.array("hub", "class")).alias("class")).distinct(), "ends"), who, n).dropDuplicates(["class"])
    hubs = store(near.select(F.col("hub").alias("class")).distinct().join(sets, "class").select(F.col("class").alias("hub"), F.col("grams").alias("from")), "hubs")
    both = common.join_small(near.join(sets, "class"), hubs, ["hub"], "inner").select("hub", "class", "low", "from", "grams")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x, y, low in zip(batch.column("from"), batch.column("grams"), batch.column("low").to_pylist()):
                x, y = x.values.to_numpy().view(np.uint64), y.values.to_numpy().view(np.uint64)
                more, less = np.setdiff1d(y, x, assume_unique=True), np.setdiff1d(x, y, assume_unique=True)
                d, most = len(more) + len(less), apart(len(y) + len(y) * 100 // percent, percent)
                linked = d <= apart(len(x) + len(y), percent)
                low = max(low, need(len(y), percent))
                last = len(y) - least_common(len(y) + low, percent)
                loose = not linked and low < len(x) and len(more) <= last
                elems = in_order(more, order.value, min(most, last) + 1)
                if len(more) <= last and (loose or len(y) < len(x)):
                    elems = np.concatenate([elems, np.sort(less)[: most + 1 - len(elems)]])
                out.append((len(y), len(x) - len(y), d, len(more), most, linked, loose, elems.view(np.int64)))
            columns = list(zip(*out)) or [[]] * 8
            yield pa.RecordBatch.from_arrays(
                [batch.column("hub"), batch.column("class")] + [pa.array(list(v), type=t) for v, t in zip(columns, [pa.int32()] * 5 + [pa.bool_()] * 2 + [pa.list_(pa.int64())])],
                names=["hub", "class", "size", "over", "d", "more", "most", "linked", "loose", "elems"],
            )

    return store(both.mapInArrow(run, "hub bigint, class bigint, size int, over int, d int, more int, most int, linked boolean, loose boolean, elems array<bigint>"), "differences")


def short_sketches(lists: DataFrame, who: DataFrame) -> DataFrame:
    """``class, short`` of all classes in ``lists``: the sketch folded to ``SHORT_BITS``, which bounds differences as well; stored."""
    longs, parts = SHORT_BITS // 64, range(SKETCH_BITS // SHORT_BITS)
    short = F.array(*[functools.reduce(Column.bitwiseXOR, [F.col("sketch")[k + longs * i] for i in parts]) for k in range(longs)])
    known = common.join_small(who.select("class", "sketch"), store(lists.select("class").distinct(), "ends"), ["class"], "inner")
    return store(known.select("class", short.alias("short")), "sketches")


def unlike(x: str, y: str) -> Column:
    """Bits in which two short sketches differ."""
    return sum((F.bit_count(F.col(x)[k].bitwiseXOR(F.col(y)[k])) for k in range(SHORT_BITS // 64)), F.lit(0))


def _centres(held: DataFrame) -> DataFrame:
    """``gram, centre``: the bits that most of about ``CENTRE_OF`` members of a column have in their short sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for shorts in batch.column("shorts"):
                bits = np.unpackbits(shorts.values.flatten().to_numpy().view(np.uint8).reshape(len(shorts), -1), axis=1, bitorder="little")
                out.append(np.packbits(bits.sum(axis=0) * 2 > len(bits), bitorder="little").view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("gram"), pa.array(out, type=pa.list_(pa.int64()))], names=["gram", "centre"])

    sizes = held.groupBy("gram").agg(F.count("*").alias("m"))
    some = held.join(sizes, "gram").where(F.pmod(F.xxhash64("class", F.lit(1)), F.greatest(F.lit(1), F.floor(F.col("m") / CENTRE_OF))) == 0)
    return some.groupBy("gram").agg(F.collect_list("short").alias("shorts")).mapInArrow(run, "gram bigint, centre array<bigint>")


def _hubs(lists: DataFrame) -> DataFrame:
    """``hub, class, low``: every column's hub, with its members and the size of the smallest of them.

    A column proposes the member closest to what most members hold, by their short sketches. N-grams that most of them
    hold are then in the hub, so the columns of differences get shorter. Of its members that any column proposes, a column
    takes the one that most columns do, so the columns of one family share hubs, and a set is written as few differences.
    """
    far = F.coalesce(unlike("short", "centre"), F.lit(0))
    closest = lists.join(_centres(lists), "gram", "left").groupBy("gram").agg(F.min_by("class", F.struct(far, F.xxhash64("class"), "class")).alias("hub"))
    proposed = store(closest.groupBy("hub").agg(F.count("*").alias("columns")), "proposed")
    some = lists.select("gram", F.col("class").alias("hub")).join(proposed, "hub")
    hub = some.groupBy("gram").agg(F.max_by("hub", F.struct("columns", F.xxhash64("hub"), "hub")).alias("hub"))
    near = store(lists.join(hub, "gram").select("hub", "class", "size").where("hub <> class").distinct(), "near")
    return store(near.join(near.groupBy("hub").agg(F.min("size").alias("low")), "hub").select("hub", "class", "low"), "near")


def _by_differences(df: DataFrame, lists: DataFrame, labels: DataFrame | None, done: DataFrame, who: DataFrame, n: int, percent: int, order: Broadcast) -> DataFrame | None:
    """Labels after all links between members of the long columns ``gram, class, size, d, label``.

    A set's difference from a hub is ordered, its own n-grams first and then those that only the hub has. Two linked
    sets may differ by ``most`` n-grams, so the one that is closer to the hub has the first common n-gram in the first half of its
    first ``most + 1`` (``lead``), the other one anywhere in them; behind both places there are enough n-grams for the overlap
    of the differences that a link needs. If they have no n-gram in common, each set is linked with the hub. If the first
    common one is the hub's only, the sets have nothing in common outside the hub, and a set is linked with the hub
    if the other one is no smaller than that: what remains lies between loose sets, which lead here, and smaller ones.
    """
    for turn in range(HUB_ROUNDS):
        mixed = lists.groupBy("gram").agg(F.min("label").alias("one"), F.max("label").alias("other")).where("one <> other")
        lists = store(lists.join(mixed, "gram", "left_semi").drop("label"), "long")
        held = lists.count()
        if not held:
            break
        if not turn:  # sketches join sets from here on, not the n-grams of their differences
            known = short_sketches(lists, who)
            lists = store(common.join_small(lists, known, ["class"], "inner"), "long")
        found = differences(df, _hubs(lists), who, n, percent, order)
        linked = store(found.where("linked").select(F.least("hub", "class").alias("a"), F.greatest("hub", "class").alias("b")).distinct(), "linked")
        if not linked.isEmpty():
            labels = _relabel(labels, linked)
        sets = common.join_small(_labelled(found, labels), known, ["class"], "inner")
        spread = sets.select("hub", "class", "size", "over", "d", "more", "most", "loose", "label", "short", F.posexplode("elems").alias("pos", "elem")).withColumn("hubs", F.col("pos") >= F.col("more"))
        spread = spread.withColumn("lead", F.when(F.col("hubs"), F.col("loose")).otherwise(F.col("pos") * 2 <= F.col("most")))
        spread = spread.select(F.xxhash64("hub", "elem").alias("gram"), "class", "size", "over", "d", "more", "pos", "hubs", "lead", "label", "short")
        lists = store(spread, "lists")
        by_label = lists.groupBy("gram", "label").agg(F.count("*").alias("m"), F.count_if("lead").alias("leads")).groupBy("gram")
        mixed = by_label.agg(F.sum("m").alias("m"), F.sum("leads").alias("leads"), F.sum(F.col("m") * F.col("m")).alias("own"), F.max(F.struct("m", "label"))["label"].alias("main"), F.count("*").alias("n"))
        heavy = F.col("leads") * (1 - F.col("own") / (F.col("m") * F.col("m"))) > LEFT_PER_ENTRY if turn < HUB_ROUNDS - 1 else F.lit(False)
        lists = store(lists.join(mixed.where("n > 1 AND leads > 0").select("gram", "main", heavy.alias("heavy")), "gram"), "lists")
        if turn and lists.where("heavy").count() * 2 > held:  # another hub would not shorten them
            lists = lists.withColumn("heavy", F.lit(False))
        light = lists.where("NOT heavy")
        other = light.where("NOT hubs OR over > 0").select("gram", F.struct("class", "size", "label", "d", "more", "pos", "short").alias("other"), (F.col("label") == F.col("main")).alias("other_main"))
        lead = light.where("lead")
        met = lead.where("label <> main").join(other, "gram").unionByName(lead.where("label = main").join(other.where("NOT other_main"), "gram"))
        most = F.floor((F.col("size") + F.col("other.size")) * (100 - percent) / (100 + percent))
        share = F.greatest(F.lit(1), F.ceil((F.col("d") + F.col("other.d") - most) / 2))
        first = F.struct("d", "class") < F.struct("other.d", "other.class")
        places = (F.col("pos") <= F.col("d") - share) & (F.col("other.pos") <= F.col("other.d") - share)
        # own n-grams before the first common one are not common
        left = F.least(F.col("size") - F.least("pos", "more"), F.col("other.size") - F.least("other.pos", "other.more"))
        enough = left >= F.ceil((F.col("size") + F.col("other.size")) * percent / (100 + percent))
        met = met.where((F.col("label") != F.col("other.label")) & places & enough & (F.col("hubs") | first) & (unlike("short", "other.short") <= most))
        pairs = met.select(F.least("class", "other.class").alias("a"), F.greatest("class", "other.class").alias("b")).distinct()
        pairs = store(pairs.join(done, ["a", "b"], "left_anti"), "pairs")
        if not pairs.isEmpty():
            linked = overlaps(df, pairs, who, n, percent)
            labels = labels if linked.isEmpty() else _relabel(labels, linked)
            done = done.union(pairs)
        lists = _labelled(lists.where("heavy").select("gram", "class", "size", "d", "short"), labels)
    return labels


def jaccard_join(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, row, n_shingles, component_id`` and ``first_row``; one row per input row.

    ``component_id`` is the smallest id reachable by links (its own for an empty set); ``first_row`` is the row of
    its component with that id and, among these, the smallest hash of the text.
    """
    df = common.with_row(common.documents(docs, id_col, text_col))
    rows = store(members(df, n), "members")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    who = rows.where("class IS NOT NULL").groupBy("class").agg(F.min(place).alias("first"), F.min_by(F.struct("size", "sketch"), place).alias("set"))
    who = store(who.select("class", "first.doc_id", "first.row", "set.size", "set.sketch"), "who")
    order = df.sparkSession.sparkContext.broadcast(frequent(df, n))
    # sizes that can reach the threshold lie in the same or a neighbouring step of a scale of that ratio
    step = F.floor(F.log(F.col("size").cast("double")) / math.log(100 / percent) + 1e-9).cast("int") if percent < 100 else F.col("size")
    lists = entries(df, n, percent, order).withColumn("step", step)
    fits = (F.col("size") * 100 >= F.col("other.size") * percent) & (F.col("other.size") * 100 >= F.col("size") * percent)
    labels = None
    near = Window.partitionBy("gram").orderBy("step").rangeBetween(0, 1)
    by_step = lists.groupBy("gram", "step").agg(F.count("*").alias("here"), F.max("class").alias("main")).withColumn("met", F.col("here") * F.sum("here").over(near))
    mixed = by_step.groupBy("gram").agg(F.sum("here").alias("m"), F.sum("met").alias("met"), F.max("main").alias("main"))
    mixed = mixed.withColumn("heavy", F.col("met") * (1 - 1 / F.col("m")) > LEFT_PER_ENTRY * F.col("m"))
    lists = store(lists.join(mixed.select("gram", "main", "heavy"), "gram"), "lists")
    # short columns: all classes but the main one meet every other; long ones: a hub of each step does
    whole = lists.where("NOT heavy AND class <> main").select("gram", F.struct("class", "size", "pos").alias("other"), "step")
    hub = F.min_by(F.struct("class", "size", "pos"), F.struct(F.col("class") != F.col("main"), F.xxhash64("class", F.lit(0))))
    hubs = lists.where("heavy").groupBy("gram", "step").agg(hub.alias("other")).select("gram", "other", "step")
    around = F.explode(F.array(F.col("step") - 1, F.col("step"), F.col("step") + 1)).alias("step") if percent < 100 else F.col("step")
    met = lists.join(whole.union(hubs).select("gram", "other", around), ["gram", "step"])
    met = met.where(fits & (F.col("class") != F.col("other.class")) & (F.col("heavy") | (F.col("class") == F.col("main")) | (F.col("class") < F.col("other.class"))))
    here, there = F.struct("class", "size", "pos"), F.struct("other.class", "other.size", "other.pos")
    pairs = store(_candidates(met.select(F.least(here, there).alias("a"), F.greatest(here, there).alias("b"), "heavy"), lists, percent), "pairs")
    if not pairs.isEmpty():
        linked = overlaps(df, pairs, who, n, percent)
        labels = None if linked.isEmpty() else _relabel(None, linked)
        labels = _by_differences(df, _labelled(lists.where("heavy").select("gram", "class", "size", F.lit(0).alias("d")), labels), labels, pairs, who, n, percent, order)
    joined = _labelled(rows.drop("sketch"), labels)
    least = joined.where("label IS NOT NULL").groupBy("label").agg(F.min(place).alias("first"))
    out = joined.join(least, "label", "left")
    alone = F.col("label").isNull()
    return out.select(
        "doc_id", "row", F.col("size").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id"),
        F.when(alone, F.col("row")).otherwise(F.col("first.row")).alias("first_row"),
    )


def _candidates(met: DataFrame, lists: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs ``a, b`` among the products, without those whose accumulated overlap is bound to stay too small.

    All products of short columns are there, so a pair's overlap is at most those, plus its entries in
    long columns, plus what either set has after the last n-gram that was met.
    """
    short = F.when(~F.col("heavy"), True)
    seen = met.groupBy(F.col("a.class").alias("a"), F.col("b.class").alias("b")).agg(
        F.count(short).alias("both"), F.max(F.when(short, F.col("a.pos"))).alias("at_a"), F.max(F.when(short, F.col("b.pos"))).alias("at_b"),
        F.max("a.size").alias("size_a"), F.max("b.size").alias("size_b"),
    )
    long = lists.where("heavy").groupBy("class").agg(F.count("*").alias("long"))
    for side in "ab":
        seen = seen.join(long.select(F.col("class").alias(side), F.col("long").alias(f"long_{side}")), side, "left")
    more = F.least(F.coalesce("long_a", F.lit(0)), F.coalesce("long_b", F.lit(0)))
    most = F.col("both") + more + F.least(F.col("size_a") - F.col("at_a") - 1, F.col("size_b") - F.col("at_b") - 1)
    can = (F.col("both") == 0) | (most * 100 >= (F.col("size_a") + F.col("size_b") - most) * percent)
    return seen.where(can).select("a", "b")


def _labelled(df: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Add the label of each class, the class itself where it has no links."""
    if labels is None:
        return df.withColumn("label", F.col("class"))
    return df.join(labels, "class", "left").withColumn("label", F.coalesce("label", "class"))


def _relabel(labels: DataFrame | None, linked: DataFrame) -> DataFrame:
    """Labels after new links: components of the labels that the links join."""
    if labels is None:
        return components(linked).select(F.col("node").alias("class"), "label")
    at = lambda side: _labelled(linked.select(F.col(side).alias("class"), "a", "b"), labels).select("a", "b", F.col("label").alias(f"l{side}"))
    joined = at("a").join(at("b"), ["a", "b"]).select(F.col("la").alias("a"), F.col("lb").alias("b"))
    merged = components(joined).select("node", F.col("label").alias("merged"))
    known = labels.select("class", "label").union(linked.select(F.explode(F.array("a", "b")).alias("class")).distinct().join(labels, "class", "left_anti").select("class", F.col("class").alias("label")))
    out = known.join(merged, known.label == merged.node, "left").select("class", F.coalesce("merged", "label").alias("label"))
    return store(out, "labels")


def one_per_component(docs: DataFrame, joined: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all columns, that stand first in their component; empty sets all stay.

    ``joined`` is the stored result of ``jaccard_join``. Of rows with equal id and text one stays.
    """
    first = joined.where(F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("row") == F.col("first_row")))
    times = first.groupBy("doc_id", "row", "n_shingles").agg(F.count("*").alias("times"))
    again = store(times.where("times > 1 AND n_shingles > 0").select("doc_id", "row"), "again")
    if again.isEmpty():
        return common.rows_in(docs, store(times.select("doc_id", "row"), "first"), "left_semi", id_col, text_col)
    single = store(times.where("times = 1 OR n_shingles = 0").select("doc_id", "row"), "first")
    double = common.rows_in(docs, again, "left_semi", id_col, text_col)
    return common.rows_in(docs, single, "left_semi", id_col, text_col).union(double.dropDuplicates([id_col, text_col]))
