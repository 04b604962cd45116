"""Line dedup: every line whose key a document with a smaller id holds is dropped.

Keys are hashed to 128 bits, spread over ranges of the hash and sorted by document and position; the first
occurrences stream by, and what comes back is one compressed keep bitmap per document, not text.

A line's key is the line stripped of ASCII white space at both ends with A-Z lower-cased. Keys shorter than
``min_chars`` code points never drop. A null or empty text is one empty line. Rows with the same id are one
document; null ids are one document that comes after all others. Rows that are equal get equal results.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.llm import common, keyed
from freshet.session import store

WHITE = b" \t\n\v\f\r"
MIN_CHARS = 10


def line_keys(text: str, min_chars: int = MIN_CHARS) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Two hash words and the position of each line whose key is long enough."""
    keys = [line.strip(WHITE).lower() for line in common.encode(text).split(b"\n")]
    at = [i for i, k in enumerate(keys) if len(k) >= min_chars and (k.isascii() or len(k.decode()) >= min_chars)]
    if not at:
        return None
    h = np.frombuffer(b"".join([xxhash.xxh3_128_digest(keys[i]) for i in at]), dtype="<i8").reshape(-1, 2)
    return h[:, 0], h[:, 1], np.array(at)


def bitmap(runs: np.ndarray) -> bytes:
    """Compressed bits of a document's lines, 1 for kept; lines after the last bit are kept."""
    keep = np.ones(-(-int(runs.max()) // 8) * 8, dtype=bool)
    for begin, end in zip(runs[::2], runs[1::2]):
        keep[begin:end] = False
    return zlib.compress(np.packbits(keep, bitorder="little").tobytes(), 6)


def kept_lines(text: str, bits: bytes | None) -> tuple[str, int, int]:
    """The kept lines joined, the lines before and the lines dropped."""
    n = text.count("\n") + 1
    if bits is None:
        return text, n, 0
    keep = np.unpackbits(np.frombuffer(zlib.decompress(bits), dtype=np.uint8), bitorder="little")[:n]
    lines = text.split("\n")
    dropped = np.flatnonzero(keep == 0)
    for i in dropped:
        lines[i] = None
    return "\n".join([x for x in lines if x is not None]), n, len(dropped)


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """``doc_id``, ``row`` (hash of the text) and ``keep`` for every document that loses a line; stored."""
    df = common.with_row(common.documents(docs, id_col, text_col))
    runs = keyed.hits(keyed.places(df, lambda text: line_keys(text, min_chars), True), True)

    def run(batches):
        for batch in batches:
            keep = [bitmap(r.values.to_numpy()) for r in batch.column("runs")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(keep, type=pa.binary())], names=["doc_id", "row", "keep"])

    return store(runs.mapInArrow(run, "doc_id bigint, row bigint, keep binary"), "keep-bitmaps")


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Add ``kept`` (the text of the kept lines), ``n_lines`` and ``n_dropped`` to ``doc_id``; one row per input row."""
    df = common.with_row(common.documents(docs, id_col, text_col))
    joined = common.join_small(df, bitmaps, ["doc_id", "row"], "left").drop("row")

    def run(batches):
        for batch in batches:
            texts, bits = batch.column("text"), batch.column("keep")
            for begin, end in common.pieces(texts.to_pylist()):
                made = [kept_lines(t, b) for t, b in zip(texts[begin:end].to_pylist(), bits[begin:end].to_pylist())]
                kept, n, dropped = zip(*made)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[begin:end], pa.array(kept, type=pa.string()), pa.array(n, type=pa.int64()), pa.array(dropped, type=pa.int64())],
                    names=["doc_id", "kept", "n_lines", "n_dropped"],
                )

    return joined.mapInArrow(run, "doc_id bigint, kept string, n_lines bigint, n_dropped bigint")


def drop_lines(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all columns, the texts being those of the kept lines; a null text stays null."""
    marked = docs.withColumns({"_lines_id": F.col(f"`{id_col}`").cast("long"), "_lines_row": F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))})
    named = bitmaps.select(F.col("doc_id").alias("_lines_id"), F.col("row").alias("_lines_row"), F.col("keep").alias("_lines_keep"))
    joined = common.join_small(marked, named, ["_lines_id", "_lines_row"], "left").drop("_lines_id", "_lines_row")

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts, bits = batch.column(text_col).to_pylist(), batch.column("_lines_keep").to_pylist()
            kept = [t if t is None or b is None else kept_lines(t, b)[0] for t, b in zip(texts, bits)]
            columns = [pa.array(kept, type=pa.string()) if i == at else batch.column(i) for i in range(len(batch.schema) - 1)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return joined.mapInArrow(run, docs.schema)
