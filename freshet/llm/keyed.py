"""Keys that occur in several places: pre-aggregated inside tasks, range-partitioned and streamed in order.

A *place* is a run [begin, end) of positions in a row of a table, the row being named by ``doc_id`` and ``row``.
Every task first combines its own places by key, so a key of any frequency sends one document's places at most
from each combined block into the shuffle; all other places are decided where they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "h1 bigint, h2 bigint, route bigint, doc_id bigint, row bigint, begin int, `end` int, decided boolean"
NAMES = ["h1", "h2", "route", "doc_id", "row", "begin", "end", "decided"]
KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()]

#: Places that are combined together inside a task.
BLOCK = 1_000_000
#: Stands for a null id; it sorts last.
NO_ID = np.iinfo(np.int64).max
#: Hashes are uniform, so ranges of equal width hold equal shares and need no sampling pass.
RANGE_BITS = 48


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before in any column."""
    out = np.ones(len(columns[0]), dtype=bool)
    if len(out) > 1:
        out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def _runs(doc: np.ndarray, row: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted single positions as runs."""
    order = np.lexsort((pos, row, doc))
    doc, row, pos = doc[order], row[order], pos[order]
    first = np.ones(len(pos), dtype=bool)
    if len(pos) > 1:
        first[1:] = (doc[1:] != doc[:-1]) | (row[1:] != row[:-1]) | (pos[1:] > pos[:-1] + 1)
    at = np.flatnonzero(first)
    last = np.append(at[1:], len(pos)) - 1
    return doc[at], row[at], pos[at], pos[last] + 1


def combine(places: list[tuple[np.ndarray, ...]], by_document: bool) -> Iterator[pa.RecordBatch]:
    """One block of places (h1, h2, doc, row, pos): those decided by the block itself, and one per key that is not.

    ``by_document``: a place is hit if a smaller document holds its key; the places of the block's smallest
    document stay open. Else a place is hit if its key has another place; one place of each key goes on, as hit
    already if the block has another.
    """
    h1, h2, doc, row, pos = (np.concatenate(x) for x in zip(*places))
    order = np.lexsort((pos, row, doc, h2, h1))
    h1, h2, doc, row, pos = h1[order], h2[order], doc[order], row[order], pos[order]
    starts = _starts(h1, h2)
    at = np.flatnonzero(starts)
    sizes = np.diff(np.append(at, len(h1)))
    if by_document:
        ahead = doc == np.repeat(doc[at], sizes)
        hit = np.zeros(len(h1), dtype=bool)
    else:
        ahead = starts
        hit = np.repeat(sizes > 1, sizes)
    rest = ~ahead
    d, r, b, e = _runs(doc[rest], row[rest], pos[rest]) if rest.any() else (doc[:0], row[:0], pos[:0], pos[:0])
    for k in range(0, int(ahead.sum()), 100_000):
        some = np.flatnonzero(ahead)[k : k + 100_000]
        yield _batch(h1[some], h2[some], h1[some] >> RANGE_BITS, doc[some], row[some], pos[some], pos[some] + 1, hit[some])
    for k in range(0, len(d), 100_000):
        s = slice(k, k + 100_000)
        yield _batch(None, None, r[s] ^ (d[s] * 31), d[s], r[s], b[s], e[s], np.ones(len(d[s]), dtype=bool))


def _batch(h1, h2, route, doc, row, begin, end, decided) -> pa.RecordBatch:
    empty = lambda: pa.nulls(len(doc), pa.int64())
    columns = [empty() if h1 is None else h1, empty() if h2 is None else h2, route, doc, row, begin.astype(np.int32), end.astype(np.int32), decided]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=t) for c, t in zip(columns, KINDS)], names=NAMES)


def places(docs: DataFrame, of: Callable[..., tuple[np.ndarray, ...] | None], by_document: bool, extra: tuple[str, ...] = ()) -> DataFrame:
    """Combined places of all rows; ``of(text, *extra)`` gives h1, h2 and positions of a text or None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            rows = batch.column("row").to_pylist()
            more = [batch.column(c) for c in extra]
            for i, text in enumerate(batch.column("text")):
                found = of(text.as_py(), *(m[i].values.to_numpy() for m in more))
                if found is None or not len(found[0]):
                    continue
                h1, h2, pos = found
                doc = np.full(len(pos), NO_ID if ids[i] is None else ids[i], dtype=np.int64)
                held.append((h1, h2, doc, np.full(len(pos), rows[i], dtype=np.int64), pos.astype(np.int64)))
                count += len(pos)
                if count >= BLOCK:
                    yield from combine(held, by_document)
                    held, count = [], 0
        if held:
            yield from combine(held, by_document)

    return docs.select("doc_id", "row", "text", *extra).mapInArrow(run, SCHEMA)


def hits(found: DataFrame, by_document: bool) -> DataFrame:
    """Stream the places in key order and keep those that are hit, as ``doc_id, row, runs`` per row.

    ``runs`` is an array of begin, end, begin, end and so on, in order. Keys are spread over ranges of their hash
    and sorted by document and position within.
    """
    ordered = found.repartition("route").sortWithinPartitions("h1", "h2", "doc_id", "row", "begin")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: list[np.ndarray] | None = None
        smallest: tuple[int, int, int] | None = None  # key and its first document so far

        def emit(cols: list[np.ndarray], hit: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(cols[2][hit]), pa.array(cols[3][hit]), pa.array(cols[4][hit], type=pa.int32()), pa.array(cols[5][hit], type=pa.int32())],
                names=["doc_id", "row", "begin", "end"],
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            table = {n: batch.column(n) for n in NAMES}
            known = table["h1"].is_valid().to_numpy(zero_copy_only=False)
            cols = [(table[n].fill_null(0) if n in ("h1", "h2") else table[n]).to_numpy(zero_copy_only=False) for n in ("h1", "h2", "doc_id", "row", "begin", "end", "decided")]
            if not known.all():  # decided before the shuffle; nulls come first
                yield emit([c[~known] for c in cols], np.ones(int((~known).sum()), dtype=bool))
                cols = [c[known] for c in cols]
                if not known.any():
                    continue
            if by_document:
                h1, h2, doc = cols[:3]
                starts = _starts(h1, h2)
                first = doc[np.maximum.accumulate(np.where(starts, np.arange(len(doc)), 0))]
                if smallest is not None and (h1[0], h2[0]) == smallest[:2]:
                    n = int(np.flatnonzero(starts)[1]) if starts.sum() > 1 else len(doc)
                    first[:n] = smallest[2]
                smallest = (h1[-1], h2[-1], first[-1])
                yield emit(cols, doc != first)
            else:
                if carry is not None:
                    cols = [np.concatenate([a, b]) for a, b in zip(carry, cols)]
                starts = _starts(cols[0], cols[1])
                hit = cols[6].astype(bool) | ~starts
                hit[:-1] |= ~starts[1:]
                yield emit([c[:-1] for c in cols], hit[:-1])
                carry = [c[-1:].copy() for c in cols]
                carry[6] = hit[-1:].copy()
        if carry is not None:
            yield emit(carry, carry[6].astype(bool))

    hit = ordered.mapInArrow(run, "doc_id bigint, row bigint, begin int, `end` int")
    runs = F.array_sort(F.collect_list(F.struct("begin", "end")))
    return hit.groupBy("doc_id", "row").agg(F.flatten(F.transform(runs, lambda x: F.array(x["begin"], x["end"]))).alias("runs")).withColumn(
        "doc_id", F.when(F.col("doc_id") != int(NO_ID), F.col("doc_id"))
    )
