"""Substring dedup: words inside a window of ``length`` words that also stands elsewhere are removed.

Seed and extend. Winnowing picks anchors, such that two equal stretches of ``length`` words share one. Anchors that
occur twice are seeds. Around each seed the stretch is extended both ways: the windows of ``length`` words that
contain the seed are matched by 128-bit hashes with those around all other seeds, and the windows that repeat join
into maximal repeats. No pairs of documents are formed: a passage in a million documents costs one entry each.

Words are stretches without ASCII white space, unchanged. Null and empty texts have no words. Every row counts as a
document of its own, so equal rows repeat each other. Rows that are equal get equal results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from freshet.llm import common, keyed
from freshet.session import store

LENGTH = 35
#: Words hashed into one anchor; windows of LENGTH - GRAM + 1 of them pick one each.
GRAM = 12


def anchors(text: str, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Winnowed anchors of a text: hash, zeros and the anchor's first word."""
    words = common.encode(text).split()
    if len(words) < length:
        return None
    data, begin, end = common.word_spans(words)
    grams = common.span_hashes(common.prefix_hashes(data), begin[: len(words) - gram + 1], end[gram - 1 :])
    width = length - gram + 1
    best = np.lib.stride_tricks.sliding_window_view(grams, width).argmin(axis=1) + np.arange(len(grams) - width + 1)
    at = np.unique(best)
    return grams[at].view(np.int64), np.zeros(len(at), dtype=np.int64), at


def windows(text: str, seeds: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """The windows around a text's seeds: two hash words and the first word of each."""
    words = common.encode(text).split()
    n = len(words) - length + 1
    if n < 1:
        return None
    change = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(change, np.maximum(seeds[::2] - (length - gram), 0), 1)
    np.add.at(change, seeds[1::2], -1)
    at = np.flatnonzero(np.cumsum(change)[:n] > 0)
    data, begin, end = common.word_spans(words)
    h1, h2 = (common.span_hashes(common.prefix_hashes(data, second), begin[at], end[at + length - 1]) for second in (False, True))
    return h1.view(np.int64), h2.view(np.int64), at


def kept_words(text: str, repeated: np.ndarray | None, length: int = LENGTH) -> tuple[str, int, int]:
    """The words outside all repeated windows joined by a space, all words and the removed words."""
    if repeated is None:
        words = common.encode(text).split()
        return b" ".join(words).decode(), len(words), 0
    words = common.encode(text).split()
    change = np.zeros(len(words) + length + 1, dtype=np.int64)
    np.add.at(change, repeated[::2], 1)
    np.add.at(change, np.minimum(repeated[1::2] + length - 1, len(words)), -1)
    gone = np.cumsum(change)[: len(words)] > 0
    return b" ".join([w for w, g in zip(words, gone.tolist()) if not g]).decode(), len(words), int(gone.sum())


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``doc_id``, ``row`` (hash of the text) and ``runs`` of first words of repeated windows; stored."""
    df = common.with_row(common.documents(docs, id_col, text_col))
    seeds = store(keyed.hits(keyed.places(df, lambda text: anchors(text, length, gram), False), False), "seeds")
    seeded = common.join_small(df, seeds, ["doc_id", "row"], "inner")
    found = keyed.places(seeded, lambda text, runs: windows(text, runs, length, gram), False, ("runs",))
    return store(keyed.hits(found, False), "repeats")


def remove_repeats(docs: DataFrame, repeats: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """``doc_id``, ``kept`` (the words left), ``n_words`` and ``n_removed``; one row per input row."""
    df = common.with_row(common.documents(docs, id_col, text_col))
    joined = common.join_small(df, repeats, ["doc_id", "row"], "left").drop("row")

    def run(batches):
        for batch in batches:
            texts, runs = batch.column("text"), batch.column("runs")
            for begin, end in common.pieces(texts.to_pylist()):
                made = [
                    kept_words(t, r.values.to_numpy() if r.is_valid else None, length)
                    for t, r in zip(texts[begin:end].to_pylist(), runs[begin:end])
                ]
                kept, n, removed = zip(*made)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[begin:end], pa.array(kept, type=pa.string()), pa.array(n, type=pa.int64()), pa.array(removed, type=pa.int64())],
                    names=["doc_id", "kept", "n_words", "n_removed"],
                )

    return joined.mapInArrow(run, "doc_id bigint, kept string, n_words bigint, n_removed bigint")
