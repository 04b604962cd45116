"""Language identification by the nearest of several clustered centroids per language.

Texts become normalised TF-IDF vectors of hashed character n-grams. Document frequencies cover all labelled rows;
the centroids come from spherical k-means on a bounded sample of them (``SAMPLE`` rows per language, by hash of
the text; a text that stands in many rows enters once). A text belongs to the language of the centroid with the largest cosine. It is rejected if that cosine
is far below those of training texts of its length, or if it has no letter. Texts of one word repeated over and over are
unlike other texts of their length and may be rejected too.

Null, empty and letterless texts are ``und`` with score 0 and rejected. Without labelled rows every text is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.llm import common

DIMS = 4096
CENTROIDS = 4
#: Labelled rows per language that the centroids are fitted on, about.
SAMPLE = 800
ROUNDS = 12
#: A cosine below this share of a low quantile of training texts of the same length class is rejected. The smallest would
#: be that of a single odd text.
REJECT = 0.5
LOW = 0.05
#: Training texts that a quantile needs; a class with fewer takes those of the nearest classes along.
LEAST = 20
LENGTHS = 20
#: Texts of fewer than 2 ** SHORT n-grams are too short to be told from other languages, so they are not rejected.
SHORT = 7
SHARPNESS = 20.0
UNKNOWN = "und"

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000))
    return _letters[0]


def counts(text: str) -> np.ndarray | None:
    """Counts of hashed 2- and 3-grams of letters, words being set apart by one space; None without a letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    is_letter = letters()[codes]
    if not is_letter.any():
        return None
    codes = np.where(is_letter, codes, np.uint32(32))
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    codes = np.concatenate([[np.uint32(32)], codes[keep], [np.uint32(32)]]).astype(np.uint32)
    pair = codes[:-1] * np.uint32(0x9E3779B1) ^ codes[1:] * np.uint32(0x85EBCA6B)
    triple = (pair[:-1] * np.uint32(0xC2B2AE35)) ^ codes[2:] * np.uint32(0x27D4EB2F)
    triple ^= triple >> np.uint32(15)
    slots = np.concatenate([(pair * np.uint32(0x165667B1)) >> np.uint32(20), (triple * np.uint32(0x9E3779B1)) >> np.uint32(20)])
    return np.bincount(slots.astype(np.intp), minlength=DIMS)


def vector(found: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Normalised TF-IDF vector with damped counts."""
    v = np.log1p(found) * idf
    return (v / max(np.linalg.norm(v), 1e-12)).astype(np.float32)


def length_class(found: np.ndarray) -> int:
    return min(int(np.log2(found.sum())), LENGTHS - 1)


@dataclass
class Model:
    """Inverse document frequencies, centroids with their language, and the smallest cosine accepted by length class."""

    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    names: list[str]
    floor: np.ndarray

    def predict(self, text: str) -> tuple[str, float, bool]:
        found = counts(text)
        if found is None or not self.names:
            return UNKNOWN, 0.0, True
        near = self.centroids @ vector(found, self.idf)
        best = np.full(len(self.names), -1.0)
        np.maximum.at(best, self.owner, near)
        k = int(best.argmax())
        share = np.exp(SHARPNESS * (best - best[k]))
        return self.names[k], float(1 / share.sum()), bool(best[k] < self.floor[k, length_class(found)])


def cluster(rows: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means from a start of far-apart rows."""
    centres = rows.mean(axis=0, keepdims=True)
    centres /= max(np.linalg.norm(centres), 1e-12)
    chosen = [int((rows @ centres[0]).argmax())]
    while len(chosen) < min(k, len(rows)):
        chosen.append(int((rows @ rows[chosen].T).max(axis=1).argmin()))
    centres = rows[chosen].copy()
    for _ in range(ROUNDS):
        near = (rows @ centres.T).argmax(axis=1)
        for c in range(len(centres)):
            if (near == c).any():
                centres[c] = rows[near == c].sum(axis=0)
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres


def floors(near: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Smallest cosine accepted by length class, from the cosines and length classes of training texts."""
    floor = np.zeros(LENGTHS)
    for c in range(SHORT, LENGTHS):
        away = np.abs(size - c)
        floor[c] = REJECT * np.quantile(near[away <= np.sort(away)[min(LEAST, len(away)) - 1]], LOW)
    return floor


def fit(docs: DataFrame, learn: Column, text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """Model from the rows where ``learn`` holds and the language is not null."""
    common.small_batches(docs.sparkSession)
    df = docs.where(learn & F.col(f"`{lang_col}`").isNotNull()).select(
        F.col(f"`{lang_col}`").cast("string").alias("lang"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")
    )

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(DIMS, dtype=np.int64), 0
        for batch in batches:
            for text in batch.column("text"):
                found = counts(text.as_py())
                if found is not None:
                    total += found > 0
                    n += 1
        slot = np.append(np.arange(DIMS), -1)
        yield pa.RecordBatch.from_arrays([pa.array(slot, type=pa.int32()), pa.array(np.append(total, n))], names=["slot", "n"])

    seen = df.select("text").mapInArrow(frequencies, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    by_slot = {r["slot"]: r["n"] for r in seen}
    n = by_slot.pop(-1, 0)
    idf = np.array([np.log((1 + n) / (1 + by_slot.get(i, 0))) + 0.01 for i in range(DIMS)])

    # distinct texts, as the draw is one of texts: a language of copies of a few keeps them all
    sizes = {r["lang"]: r["count"] for r in df.select("lang", F.xxhash64("text").alias("text")).distinct().groupBy("lang").count().collect()}
    if not sizes:
        return Model(idf, np.zeros((0, DIMS), np.float32), np.zeros(0, np.intp), [], np.zeros((0, LENGTHS)))
    share = F.create_map(*[F.lit(x) for lang, size in sizes.items() for x in (lang, min(1.0, sample / size))])
    draw = (F.xxhash64("text", F.lit("draw")).bitwiseAND(F.lit(2**40 - 1)) / F.lit(float(2**40)))
    vectors_type = "lang string, vector binary, size int"

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                found = counts(text.as_py())
                if found is not None:
                    out.append((lang, vector(found, idf).tobytes(), length_class(found)))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=t) for c, t in zip(zip(*out), (pa.string(), pa.binary(), pa.int32()))], names=["lang", "vector", "size"]
                )

    def centres(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["vector"])
        rows = np.stack([np.frombuffer(v, dtype=np.float32) for v in pdf["vector"]])
        made = cluster(rows, CENTROIDS)
        floor = floors((rows @ made.T).max(axis=1), pdf["size"].to_numpy())
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "centre": [c.astype(np.float32).tobytes() for c in made], "floor": [floor.tolist()] * len(made)})

    # copies share their draw, so a text in a third of all rows would come with all of them
    drawn = df.where(draw < share[F.col("lang")]).distinct().mapInArrow(vectors, vectors_type)
    found = drawn.groupBy("lang").applyInPandas(centres, "lang string, centre binary, floor array<double>").collect()
    found.sort(key=lambda r: (r["lang"], r["centre"]))
    names = sorted({r["lang"] for r in found})
    return Model(
        idf,
        np.stack([np.frombuffer(r["centre"], dtype=np.float32) for r in found]) if found else np.zeros((0, DIMS), np.float32),
        np.array([names.index(r["lang"]) for r in found], dtype=np.intp),
        names,
        np.array([next(r["floor"] for r in found if r["lang"] == x) for x in names]).reshape(-1, LENGTHS),
    )


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``lang_pred``, ``score`` from 0 to 1 and ``rejected``; one row per input row."""
    df = common.documents(docs, id_col, text_col)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def columns(texts: list[str]) -> dict:
        lang, score, rejected = zip(*(shared.value.predict(t) for t in texts))
        return {"lang_pred": lang, "score": score, "rejected": rejected}

    return common.map_texts(
        df, columns, {"lang_pred": ("string", pa.string()), "score": ("double", pa.float64()), "rejected": ("boolean", pa.bool_())}
    )


def known(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all columns, that are not rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return common.filter_texts(docs, lambda texts: [not shared.value.predict(t)[2] for t in texts], text_col)
