"""Benchmark decontamination by latent semantic retrieval.

Benchmark items are cut into passages; TF-IDF weights take document frequencies over all documents. A randomised SVD
of the passages' TF-IDF matrix, its products summed over the cluster, gives a latent space. Windows of all documents
are projected into it and searched by cosine. A candidate is confirmed if the longest common subsequence of words
covers enough of the passage, or somewhat less of it and also the answer: the item's own answer column if it has one,
else the last sentence.

Passages go in blocks of bounded size by their running number; the latent space of a block keeps all directions of its
passages. Documents are scanned whole, once per block, and an item's best window over all blocks counts. A passage that
stands verbatim in a document always becomes a candidate (``HALF_COVER``). Words are lower-cased, ASCII
punctuation separates them. Null and empty texts and items match nothing. Items that are equal match the same
documents. Rows may repeat: each is judged by itself, and the result has a row per id, text and item.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.llm import common
from freshet.session import store

#: Half windows of a text that are looked at together.
STRETCH = 2048
#: Words of a window; windows begin every half. Words of a passage at most.
WINDOW = 64
PASSAGE = 48
#: Passages of a block.
BLOCK = 248
#: Cosine, and share of a passage's own weight, at which a window becomes a candidate.
COSINE = 0.45
COVER = 0.35
#: Share of a passage's own weight that makes a window a candidate whatever else it holds. Of the windows over a verbatim
#: copy, one has half of its weight at least, but heavier words beside a copy of common ones bring the cosine down.
HALF_COVER = 0.49
#: Weight from which a word tells passages apart; lighter ones can't make a candidate by themselves.
TELLING = 1.5
#: Share of a passage's words that must be common, alone and together with the answer.
COMMON = 0.7
COMMON_WITH_ANSWER = 0.55
ANSWER = 0.8
#: Passages of fewer words are too short to tell.
MIN_WORDS = 5

_SEPARATE = bytes(32 if chr(b) in string.punctuation else b for b in range(256))


def words_of(text: str) -> list[bytes]:
    return common.encode(text.lower()).translate(_SEPARATE).split()


def hashes(words: list[bytes]) -> np.ndarray:
    data, begin, end = common.word_spans(words)
    return common.span_hashes(common.prefix_hashes(data), begin, end)


def common_words(a: list[bytes], b: list[bytes]) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    at: dict[bytes, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        if (m := at.get(w)) is not None:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def answer_of(text: str) -> str:
    """The last sentence of an item without an answer of its own."""
    parts = [p for p in text.replace("?", ".").replace("!", ".").replace("\n", ".").split(".") if p.strip()]
    return parts[-1] if parts else ""


@dataclass
class Block:
    """Passages of a block of items and the latent space made of them."""

    items: list[int]
    passages: list[list[bytes]]
    answers: list[list[bytes]]
    vocabulary: np.ndarray
    weight: np.ndarray
    basis: np.ndarray
    latent: np.ndarray
    norm: np.ndarray

    def __post_init__(self):
        self.quick = np.zeros(1 << 20, dtype=bool)
        self.quick[(self.vocabulary >> np.uint64(44)).astype(np.intp)] = True
        # Telling words of a window are first added up per passage that holds them. Its other words can't add more
        # than all such words of the passage, so a window that stays below the rest is no candidate for it.
        owner, word, self.least = [], [], np.zeros(len(self.passages))
        for k, (passage, norm) in enumerate(zip(self.passages, self.norm)):
            slot, times = np.unique(np.searchsorted(self.vocabulary, hashes(passage)), return_counts=True)
            telling = self.weight[slot] >= TELLING
            plain = (2 * (np.log1p(times) / np.log(2) * self.weight[slot]) ** 2)[~telling].sum()
            self.least[k] = COVER * norm**2 - plain
            owner.append(np.full(int(telling.sum()), k))
            word.append(slot[telling])
        owner, word = (np.concatenate(x) if x else np.zeros(0, dtype=np.intp) for x in (owner, word))
        self.owner = owner[np.argsort(word, kind="stable")]
        self.holders = np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(self.vocabulary)))]).astype(np.intp)

    def slots(self, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of words that the vocabulary has, and where it has them."""
        at = np.flatnonzero(self.quick[(hashed >> np.uint64(44)).astype(np.intp)])
        slot = np.minimum(np.searchsorted(self.vocabulary, hashed[at]), len(self.vocabulary) - 1)
        same = self.vocabulary[slot] == hashed[at]
        return at[same], slot[same]

    def rich(self, at: np.ndarray, slot: np.ndarray, begin: int, parts: int) -> np.ndarray:
        """Windows of one stretch, by their first half, that some passage's telling words allow as candidates."""
        half, passages, count = WINDOW // 2, len(self.passages), min(STRETCH, parts - begin)
        low, high = np.searchsorted(at, (begin * half, (begin + count + 1) * half))
        at, slot = at[low:high], slot[low:high]
        if not len(at):
            return np.zeros(0, dtype=np.intp)
        first, many = self.holders[slot], self.holders[slot + 1] - self.holders[slot]
        ends = np.cumsum(many)
        entry = np.arange(int(ends[-1])) + np.repeat(first - (ends - many), many)
        cell = np.repeat(at // half - begin, many) * passages + self.owner[entry]
        mass = np.bincount(cell, weights=np.repeat(self.weight[slot] ** 2, many), minlength=(count + 1) * passages).reshape(-1, passages)
        return begin + np.flatnonzero((mass[:-1] + mass[1:] >= self.least).any(axis=1))

    def search(self, text: str) -> list[tuple[int, int, float, float, bool]]:
        """Best confirmed window per item: item, first word, cosine, share of common words, answer found."""
        words = words_of(text)
        if len(words) < MIN_WORDS:
            return []
        at, slot = self.slots(hashes(words))
        if not len(at):
            return []
        half = WINDOW // 2
        rich = np.concatenate([self.rich(at, slot, begin, -(-len(words) // half)) for begin in range(0, -(-len(words) // half), STRETCH)])
        found: dict[int, tuple] = {}
        for part in rich:
            low, high = np.searchsorted(at, (part * half, part * half + WINDOW))
            own, times = np.unique(slot[low:high], return_counts=True)
            here = (np.log1p(times) / np.log(2) * self.weight[own]) @ self.basis[own]
            dots = self.latent @ here
            near = dots / (self.norm * max(float(np.linalg.norm(here)), 1e-12))
            for k in np.flatnonzero(((near >= COSINE) & (dots >= COVER * self.norm**2)) | (dots >= HALF_COVER * self.norm**2)):
                begin = max(0, part * half - half)
                around = words[begin : part * half + WINDOW + half]
                share = common_words(self.passages[k], around) / len(self.passages[k])
                if share < COMMON_WITH_ANSWER:
                    continue
                answer = self.answers[k]
                has = bool(answer) and common_words(answer, around) >= ANSWER * len(answer)
                if share >= COMMON or has:
                    best = found.get(self.items[k])
                    row = (self.items[k], int(part * half), float(near[k]), float(share), has)
                    if best is None or (row[3], row[2], -row[1]) > (best[3], best[2], -best[1]):
                        found[self.items[k]] = row
        return [found[k] for k in sorted(found)]


def document_counts(df: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
    """Documents that hold each word of a bounded vocabulary, and all documents."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        quick = np.zeros(1 << 20, dtype=bool)
        quick[(held >> np.uint64(44)).astype(np.intp)] = True
        total, n = np.zeros(len(held), dtype=np.int64), 0
        for batch in batches:
            for text in batch.column("text"):
                n += 1
                words = words_of(text.as_py())
                if not words or not len(held):
                    continue
                h = hashes(words)
                h = h[quick[(h >> np.uint64(44)).astype(np.intp)]]
                slot = np.minimum(np.searchsorted(held, h), len(held) - 1)
                total[np.unique(slot[held[slot] == h])] += 1
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1).astype(np.int32)), pa.array(np.append(total[some], n))], names=["slot", "n"])

    seen = {r["slot"]: r["n"] for r in df.select("text").mapInArrow(run, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).collect()}
    n = seen.pop(-1, 0)
    return np.array([seen.get(i, 0) for i in range(len(vocabulary))], dtype=float), n


def latent_space(passages: DataFrame, vocabulary: np.ndarray, weight: np.ndarray, count: int) -> np.ndarray:
    """Basis of the latent space: randomised SVD of the passages' TF-IDF matrix with one power step.

    Tasks form their rows' part of the product of the matrix, its transpose and a thin matrix; the sum has the
    vocabulary's size by the rank. The rank is that of the passages, so none of them loses a part.
    """
    rank = min(count + 8, len(vocabulary))
    context = passages.sparkSession.sparkContext
    thin = np.random.default_rng(7).standard_normal((len(vocabulary), rank))
    for _ in range(2):
        thin, _ = np.linalg.qr(thin)
        shared = context.broadcast((vocabulary, weight, thin))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, w, side = shared.value
            total = np.zeros_like(side)
            for batch in batches:
                for text in batch.column("passage"):
                    slot, times = np.unique(np.searchsorted(held, hashes(text.as_py().encode().split())), return_counts=True)
                    row = np.log1p(times) / np.log(2) * w[slot]
                    total[slot] += np.outer(row, row @ side[slot])
            some = np.flatnonzero(total.any(axis=1))
            for k in range(0, len(some), 500):
                slot, column = np.meshgrid(some[k : k + 500], np.arange(total.shape[1]), indexing="ij")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(slot.ravel().astype(np.int32)), pa.array(column.ravel().astype(np.int32)), pa.array(total[some[k : k + 500]].ravel())], names=["slot", "k", "v"]
                )

        summed = passages.select("passage").mapInArrow(run, "slot int, k int, v double").groupBy("slot", "k").agg(F.sum("v").alias("v")).toArrow()
        thin = np.zeros_like(thin)
        thin[summed["slot"].to_numpy(), summed["k"].to_numpy()] = summed["v"].to_numpy()
    left, strength, _ = np.linalg.svd(thin, full_matrices=False)
    return left[:, strength > 1e-12 * max(strength.max(initial=0), 1e-300)]


def passages_of(items: DataFrame, item_col: str, text_col: str, answer_col: str | None) -> DataFrame:
    """``item_id, passage, answer`` for the passages of every item, the words joined by spaces."""
    answer = F.col(f"`{answer_col}`") if answer_col else F.lit(None)
    df = items.where(F.col(f"`{text_col}`").isNotNull()).select(F.col(f"`{item_col}`").cast("long").alias("item_id"), F.col(f"`{text_col}`").alias("text"), answer.cast("string").alias("answer"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for item, text, answer in zip(*(batch.column(c).to_pylist() for c in ("item_id", "text", "answer"))):
                words = words_of(text)
                pieces = max(1, round(len(words) / PASSAGE))
                size = -(-len(words) // pieces) if words else 1
                told = b" ".join(words_of(answer_of(text) if answer is None else answer)).decode()
                for k in range(0, len(words), size):
                    part = words[k : k + size]
                    if len(part) >= MIN_WORDS:
                        out.append((item, b" ".join(part).decode(), told))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out), (pa.int64(), pa.string(), pa.string()))], names=["item_id", "passage", "answer"])

    return df.mapInArrow(run, "item_id bigint, passage string, answer string")


def numbered(passages: DataFrame) -> DataFrame:
    """The distinct passages with their running ``number``, stored; no task sees all of them."""
    ordered = passages.distinct().orderBy("item_id", "passage", "answer")
    place = F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1))
    held = store(ordered.withColumns({"part": F.spark_partition_id(), "place": place}), "passages")
    sizes = sorted((r["part"], r["count"]) for r in held.groupBy("part").count().collect())
    before, first = 0, [F.lit(-1), F.lit(0).cast("long")]
    for part, size in sizes:
        first += [F.lit(part), F.lit(before).cast("long")]
        before += size
    return held.select("item_id", "passage", "answer", (F.create_map(*first)[F.col("part")] + F.col("place")).alias("number"))


def make_block(df: DataFrame, passages: DataFrame) -> Block | None:
    """Latent space of one block of passages, with weights from all documents ``df``."""
    rows = passages.orderBy("number").collect()
    if not rows:
        return None
    cut = [r["passage"].encode().split() for r in rows]
    vocabulary = np.unique(np.concatenate([hashes(p) for p in cut]))
    holding, n = document_counts(df, vocabulary)
    weight = np.log((1 + n) / (1 + np.minimum(holding, n))) + 0.01
    basis = latent_space(passages, vocabulary, weight, len(rows))
    latent = np.zeros((len(cut), basis.shape[1]))
    for i, p in enumerate(cut):
        slot, times = np.unique(np.searchsorted(vocabulary, hashes(p)), return_counts=True)
        latent[i] = (np.log1p(times) / np.log(2) * weight[slot]) @ basis[slot]
    norm = np.maximum(np.linalg.norm(latent, axis=1), 1e-12)
    return Block([r["item_id"] for r in rows], cut, [r["answer"].encode().split() for r in rows], vocabulary, weight, basis, latent, norm)


def contaminated(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", answer_col: str | None = None
) -> DataFrame:
    """``doc_id, row, item_id, first_word, cosine, common_share, answer_found`` for each document and item found in it."""
    df = common.with_row(common.documents(docs, id_col, text_col))
    passages = numbered(passages_of(items, item_col, item_text_col, answer_col))
    blocks = -(-passages.count() // BLOCK)
    schema = "doc_id bigint, row bigint, item_id bigint, first_word int, cosine double, common_share double, answer_found boolean"
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.bool_()]
    names = ["doc_id", "row", "item_id", "first_word", "cosine", "common_share", "answer_found"]
    out = None
    for k in range(blocks):
        block = make_block(df, passages.where(F.col("number").between(k * BLOCK, (k + 1) * BLOCK - 1)))
        if block is None:
            continue
        shared = df.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = []
                for doc, row, text in zip(batch.column("doc_id").to_pylist(), batch.column("row").to_pylist(), batch.column("text")):
                    found += [(doc, row, *hit) for hit in shared.value.search(text.as_py())]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*found), kinds)], names=names)

        part = df.select("doc_id", "row", "text").mapInArrow(run, schema)
        out = part if out is None else out.union(part)
    if out is None:
        return df.sparkSession.createDataFrame([], schema)
    # passages of one item may be in several blocks
    best = F.max(F.struct("common_share", "cosine", (-F.col("first_word")).alias("place"), "answer_found")).alias("best")
    grouped = out.groupBy("doc_id", "row", "item_id").agg(best)
    return grouped.select("doc_id", "row", "item_id", (-F.col("best.place")).alias("first_word"), "best.cosine", "best.common_share", "best.answer_found")
