"""Document fingerprints from closed syncmers.

A k-mer is a closed syncmer if its smallest inner s-mer stands first or last in it. Whether it is chosen depends on
the k-mer alone, so equal stretches give equal anchors wherever they stand. A fingerprint keeps the ``SKETCH``
smallest anchor hashes with their first positions. The likeness of two is the share of the smallest anchors of both
that they have in common at the same displacement, so shared anchors must also line up.

Null and empty texts have no anchors; a text shorter than k has one, itself. Two fingerprints without anchors are
alike (1), one without is unlike any other (0). Equal texts have equal fingerprints.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.llm import common

K, S = 24, 8
SKETCH = 64
#: Displacements that differ by at most this many code points count as the same.
SLACK = 16
#: Stands for a null id in the order; it sorts last.
LAST = 2**63 - 1


def sketch(text: str, k: int = K, s: int = S, size: int = SKETCH) -> tuple[np.ndarray, np.ndarray]:
    """The smallest closed-syncmer hashes, ascending, and where each stands first."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
    n = len(codes)
    if not n:
        return np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.uint32)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(codes * common._table("up", common.BASE, n), out=sums[1:])
    if n < k:
        whole = common.span_hashes(sums, np.array([0]), np.array([n]))
        return (whole >> np.uint64(32)).astype(np.uint32), np.zeros(1, dtype=np.uint32)
    inner = np.arange(n - s + 1)
    small = common.span_hashes(sums, inner, inner + s)
    width = k - s + 1
    least, reach = small, 1
    while reach < width:
        step = min(reach, width - reach)
        least = np.minimum(least[:-step], least[step:])
        reach += step
    at = np.flatnonzero((small[: len(least)] == least) | (small[width - 1 :] == least))
    hashes = (common.span_hashes(sums, at, at + k) >> np.uint64(32)).astype(np.uint32)
    if len(hashes) > 4 * size:  # only the smallest are sorted; equal ones may make it choose again
        limit = np.partition(hashes, 4 * size)[4 * size]
        few = hashes <= limit
        values, first = np.unique(hashes[few], return_index=True)
        if len(values) >= size:
            return values[:size], at[few][first[:size]].astype(np.uint32)
    values, first = np.unique(hashes, return_index=True)
    return values[:size], at[first[:size]].astype(np.uint32)


def written(made: tuple[np.ndarray, np.ndarray]) -> str:
    """A sketch as text."""
    return base64.b64encode(np.stack(made, axis=1).astype("<u4").tobytes()).decode()


def read(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    """A sketch from its text."""
    both = np.frombuffer(base64.b64decode(fingerprint), dtype="<u4").reshape(-1, 2)
    return both[:, 0], both[:, 1]


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], size: int = SKETCH) -> float:
    """Estimated share of anchors in common, in place."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    union = np.union1d(a[0], b[0])[:size]
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    inside = a[0][i] <= union[-1]
    moved = b[1][j][inside].astype(np.int64) - a[1][i][inside].astype(np.int64)
    if not len(moved):
        return 0.0
    moved.sort()
    most = np.searchsorted(moved, moved + SLACK, side="right") - np.arange(len(moved))
    return float(most.max() / len(union))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``fingerprint``; one row per input row."""
    df = common.documents(docs, id_col, text_col)
    return common.map_texts(df, lambda texts: {"fingerprint": [written(sketch(t)) for t in texts]}, {"fingerprint": ("string", pa.string())})


def with_next(docs: DataFrame) -> DataFrame:
    """Rows of ``doc_id, text`` dealt in order of id over ranges, for ``fold_next`` to stream.

    The ranges' borders are quantiles of the ids. The first row of every range also goes to the range before it,
    where it is marked as a ``tail``; the first of all goes to the last. Only one id per range reaches the driver.
    """
    spark = docs.sparkSession
    df = common.with_row(docs).withColumn("place", F.coalesce("doc_id", F.lit(LAST)))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [k / ranges for k in range(1, ranges)]
    borders = sorted(set(docs.approxQuantile("doc_id", shares, 0.2 / ranges))) if shares else []
    border = F.array(*[F.lit(int(b)) for b in borders]) if borders else F.array().cast("array<bigint>")
    df = df.withColumn("range", F.size(F.filter(border, lambda b: b <= F.col("place"))))
    heads = df.groupBy("range").agg(F.min(F.struct("place", "row")).alias("head")).orderBy("range").collect()
    before = [(h["range"], h["head"]["place"], h["head"]["row"], heads[i - 1]["range"]) for i, h in enumerate(heads)]
    first = spark.createDataFrame(before, "`range` int, place bigint, row bigint, earlier int")
    marked = df.join(F.broadcast(first), ["range", "place", "row"], "left")
    copies = F.when(F.col("earlier").isNull(), F.array(F.struct(F.col("range"), F.lit(False).alias("tail")))).otherwise(
        F.array(F.struct(F.col("range"), F.lit(False).alias("tail")), F.struct(F.col("earlier").alias("range"), F.lit(True).alias("tail")))
    )
    dealt = marked.select("doc_id", "place", "row", "text", F.inline(copies))
    return dealt.repartition("range").sortWithinPartitions("range", "tail", "place", "row")


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they and the next document's are.

    The edited text has its last quarter replaced by as much of the beginning of the next document, by ascending
    id; ties go by a hash of the text, null ids come last, and the first follows the last.
    """
    df = with_next(common.documents(docs, id_col, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None  # id, text, sketch and range of a row whose next one has not come yet

        for batch in batches:
            out: list[tuple] = []
            ids, ranges, tails = (batch.column(c).to_pylist() for c in ("doc_id", "range", "tail"))
            texts = batch.column("text")
            for i in range(batch.num_rows):
                text = texts[i].as_py()
                own = sketch(text)
                if waiting is not None and waiting[3] == ranges[i]:
                    doc, before, made, _ = waiting
                    cut = len(before) // 4
                    edited = before[: len(before) - cut] + text[:cut]
                    changed = sketch(edited) if cut else made
                    out.append((doc, len(before), edited, written(made), written(changed), likeness(made, changed), likeness(made, own)))
                waiting = None if tails[i] else (ids[i], text, own, ranges[i])
                if len(out) >= 500 or (out and i == batch.num_rows - 1):
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out), kinds)], names=names)
                    out = []

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = ["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return df.select("doc_id", "range", "tail", "text").mapInArrow(
        run, "doc_id bigint, n_chars bigint, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )
