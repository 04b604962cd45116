"""Document quality from a linear-chain conditional random field over lines.

Every line gets features of its own and of its neighbours. The field labels lines good or bad; the forward-backward
marginals, weighted by line length, give a document's share of good text, and a logistic curve fitted on the
labels turns that share into the probability of label 1.

Labels are known per document only, so training is iterated: lines of good documents are good; lines of bad
documents start as bad and take the field's own marginals in the next rounds. It uses a bounded sample of labelled
rows (``SAMPLE`` per label, by hash of the text; a text that stands in many rows enters once per label). Null and empty texts are one empty line. Without labels of both
kinds every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.llm import common
from freshet.session import store

#: Labelled rows per label that the field is fitted on, about.
SAMPLE = 1500
ROUNDS = 4
STEPS = 60
RATE = 0.15
SHRINK = 1e-3
#: Classes of characters: letters in lower and upper case, digits, white space, common punctuation, all others.
LOWER, UPPER, DIGIT, SPACE, PUNCTUATION, OTHER = range(6)
COMMON = ".,;:'\"-()?"
OWN = 15

_classes: list[np.ndarray] = []


def classes() -> np.ndarray:
    """Class of every code point."""
    if not _classes:
        out = np.full(0x110000, OTHER, dtype=np.uint8)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                out[i] = UPPER if c.isupper() else LOWER
            elif c.isdigit():
                out[i] = DIGIT
            elif c.isspace():
                out[i] = SPACE
        out[[ord(c) for c in COMMON]] = PUNCTUATION
        _classes.append(out)
    return _classes[0]


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line, its length, and the number of lines of each text."""
    joined = "\n".join(texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    codes = np.append(codes, np.uint32(10))
    kind = classes()[codes]
    ends = np.flatnonzero(codes == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = (ends - starts).astype(np.float64)
    total = np.zeros((len(codes) + 1, 6), dtype=np.int32)
    for k in range(6):
        np.cumsum(kind == k, out=total[1:, k])
    share = (total[ends] - total[starts]) / np.maximum(size, 1)[:, None]

    def rate(marks: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(marks)])
        return sums[ends] - sums[starts]

    word_start = (kind != SPACE) & np.concatenate([[True], kind[:-1] == SPACE])
    words = np.maximum(rate(word_start), 1)
    follows = np.concatenate([kind[1:], [SPACE]])
    odd_end = rate((kind == OTHER) & (follows == SPACE)) / words
    capital = rate(word_start & (kind == UPPER)) / words
    again = rate(np.concatenate([[False], (codes[1:] == codes[:-1]) & (kind[1:] >= PUNCTUATION)])) / np.maximum(size, 1)
    stop = np.where(size > 0, np.isin(codes[np.maximum(ends - 1, 0)], [ord(c) for c in ".?!"]), False)
    at = np.flatnonzero(word_start)
    twice = np.zeros(len(codes), dtype=bool)
    if len(at) > 1:  # words that equal the word before them, by a sum over their characters
        sums = np.add.reduceat(np.where(kind != SPACE, common.mix(codes.astype(np.uint64) + np.uint64(1)), np.uint64(0)), at)
        twice[at[1:]] = sums[1:] == sums[:-1]
    out = np.column_stack(
        [share, odd_end, capital, again, rate(twice) / words, stop, np.log1p(size) / 5, np.minimum(size / words, 30) / 10, np.log1p(words) / 5, size == 0]
    )
    lines = np.fromiter((t.count("\n") + 1 for t in texts), dtype=np.int64, count=len(texts))
    return out, size, lines


def with_neighbours(own: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """A line's features, those of the line before and after it in the same text (0 outside), and a constant."""
    begins = np.cumsum(lines) - lines
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[begins] = 0
    after[begins + lines - 1] = 0
    return np.column_stack([own, before, after, np.ones(len(own))])


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def marginals(score: np.ndarray, lines: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over many chains at once: P(good) of each line and summed pair marginals.

    ``score``: emission score of good against bad; ``move``: 2 x 2 transition scores. Chains advance together,
    longest first, so that the chains still running are always the first ones.
    """
    order = np.argsort(-lines, kind="stable")
    begins = (np.cumsum(lines) - lines)[order]
    length = lines[order]
    emit = np.stack([np.ones(len(score)), np.exp(np.clip(score, -30, 30))], axis=1)
    emit /= emit.sum(axis=1, keepdims=True)
    step = np.exp(move)
    alive = [int(np.searchsorted(-length, -t, side="left")) for t in range(int(length[0]))] if len(length) else []
    forward = np.zeros((len(score), 2))
    for t, n in enumerate(alive):
        at = begins[:n] + t
        f = emit[at] if t == 0 else emit[at] * (forward[at - 1] @ step)
        forward[at] = f / f.sum(axis=1, keepdims=True)
    back = np.ones((len(score), 2))
    pairs = np.zeros((2, 2))
    for t in range(len(alive) - 2, -1, -1):
        at = begins[: alive[t + 1]] + t
        ahead = emit[at + 1] * back[at + 1]
        both = forward[at][:, :, None] * step[None] * ahead[:, None, :]
        pairs += (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        b = ahead @ step.T
        back[at] = b / b.sum(axis=1, keepdims=True)
    joint = forward * back
    return joint[:, 1] / joint.sum(axis=1), pairs


@dataclass
class Field:
    """Scale of the features, emission weights, transition scores and the curve from good share to probability."""

    centre: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    move: np.ndarray
    curve: np.ndarray

    def good(self, features: np.ndarray, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return marginals(((features - self.centre) / self.spread) @ self.weights, lines, self.move)

    def shares(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Length-weighted share of good lines, P(good) of every line and the lines of each text."""
        own, size, lines = line_features(texts)
        good, _ = self.good(with_neighbours(own, lines), lines)
        begins = np.cumsum(lines) - lines
        weight = size + 1
        return np.add.reduceat(weight * good, begins) / np.add.reduceat(weight, begins), good, lines

    def score(self, shares: np.ndarray) -> np.ndarray:
        return logistic(curve_inputs(shares) @ self.curve)


def curve_inputs(shares: np.ndarray) -> np.ndarray:
    clipped = np.clip(shares, 1e-3, 1 - 1e-3)
    return np.column_stack([np.ones(len(shares)), shares, np.log(clipped / (1 - clipped))])


def newton(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Logistic regression with few inputs."""
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = logistic(x @ w)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w + np.linalg.solve(hessian, x.T @ (y - p) - ridge * w)
    return w


def train(features: np.ndarray, sizes: np.ndarray, lines: np.ndarray, labels: np.ndarray) -> Field:
    """Fit the field by gradient steps on the conditional likelihood, then the curve."""
    centre, spread = features.mean(axis=0), features.std(axis=0)
    spread = np.where(spread > 1e-9, spread, 1.0)
    centre[-1], spread[-1] = 0.0, 1.0
    x = (features - centre) / spread
    document = np.repeat(np.arange(len(lines)), lines)
    line_label = labels[document].astype(float)
    begins = np.cumsum(lines) - lines
    follows = np.ones(len(x), dtype=bool)
    follows[begins] = False
    later = np.flatnonzero(follows)
    balance = np.where(labels == 1, 0.5 / max((labels == 1).sum(), 1), 0.5 / max((labels == 0).sum(), 1)) * len(labels)
    weight = (balance / lines)[document]
    w, move = np.zeros(x.shape[1]), np.zeros((2, 2))
    for _ in range(ROUNDS):
        first, second, t = np.zeros(len(w) + 4), np.zeros(len(w) + 4), 0
        for _ in range(STEPS):
            good, pairs = marginals(x @ w, lines, move)
            there = np.array([1 - line_label, line_label])
            seen = np.array([[(there[a][later - 1] * there[b][later]).sum() for b in (0, 1)] for a in (0, 1)])
            slope = np.concatenate([x.T @ (weight * (line_label - good)) / weight.sum() - SHRINK * w, ((seen - pairs) / max(len(later), 1) - SHRINK * move).ravel()])
            t += 1
            first = 0.9 * first + 0.1 * slope
            second = 0.99 * second + 0.01 * slope**2
            delta = RATE * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
            w, move = w + delta[:-4], move + delta[-4:].reshape(2, 2)
        alone = logistic(x @ w)  # what a line says without its chain: a bad document may hold good lines
        line_label = np.where(labels[document] == 1, 1.0, np.where(alone > 0.5, 1.0, 0.0))
    field = Field(centre, spread, w, move, np.zeros(3))
    good, _ = field.good(features, lines)
    heavy = sizes + 1
    shares = np.add.reduceat(heavy * good, begins) / np.add.reduceat(heavy, begins)
    field.curve = newton(curve_inputs(shares), labels.astype(float))
    return field


def fit(docs: DataFrame, text_col: str = "text", label_col: str = "label", sample: int = SAMPLE, labels: DataFrame | None = None, id_col: str = "doc_id") -> Field | None:
    """Field from rows with a 0/1 label; None if either label is missing.

    Labels stand in ``docs``, or in a table ``labels`` of their own with the same id. Only ids and hashes of texts meet
    the labels; whole texts move for drawn ones only.
    """
    common.small_batches(docs.sparkSession)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    draw = F.xxhash64(text, F.lit("draw")).bitwiseAND(F.lit(2**40 - 1)) / F.lit(float(2**40))
    hashed = [F.xxhash64(text).alias("key"), draw.alias("draw")]
    if labels is None:
        known = docs.select(F.col(f"`{label_col}`").alias("label"), *hashed)
    else:
        known = docs.select(F.col(f"`{id_col}`").alias("id"), *hashed).join(labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label")), "id")
    # distinct texts, as the draw is one of texts: a label of copies of a few keeps them all
    known = store(known.where(F.col("label").isin(0, 1)).select(F.col("label").cast("int").alias("label"), "key", "draw").distinct(), "labelled")
    count = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if len(count) < 2:
        return None
    # both labels are drawn with the same share, so that the curve sees them as often as they are
    share = min(1.0, 2 * sample / sum(count.values()))
    rare = min(1.0, max(share, sample / 4 / min(count.values())))
    chance = F.when(F.col("label") == min(count, key=count.get), rare).otherwise(share)
    drawn = store(known.where(F.col("draw") < chance).select("label", "key"), "drawn")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for label, text in zip(batch.column("label").to_pylist(), batch.column("text")):
                own, size, lines = line_features([text.as_py()])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x], type=t) for x, t in ((label, pa.int32()), (own.astype(np.float32).tobytes(), pa.binary()), (size.tobytes(), pa.binary()))],
                    names=["label", "own", "size"],
                )

    # a text in a third of all rows would come with all of its copies
    texts = common.join_small(docs.select(text.alias("text"), hashed[0]), drawn, ["key"], "inner").select("label", "text").distinct()
    rows = texts.mapInArrow(features, "label int, own binary, size binary").collect()
    rows.sort(key=lambda r: (r["label"], r["own"]))
    if len({r["label"] for r in rows}) < 2:
        return None
    size = [np.frombuffer(r["size"]) for r in rows]
    own = np.concatenate([np.frombuffer(r["own"], dtype=np.float32).reshape(-1, OWN) for r in rows]).astype(float)
    lines = np.array([len(s) for s in size])
    return train(with_neighbours(own, lines), np.concatenate(size), lines, np.array([r["label"] for r in rows]))


def score(docs: DataFrame, field: Field | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``score`` and ``bad_lines``, the positions of lines labelled bad; one row per input row."""
    df = common.documents(docs, id_col, text_col)
    shared = df.sparkSession.sparkContext.broadcast(field)

    def columns(texts: list[str]) -> dict:
        if shared.value is None:
            return {"score": [0.5] * len(texts), "bad_lines": [[]] * len(texts)}
        shares, good, lines = shared.value.shares(texts)
        begins = np.cumsum(lines) - lines
        bad = [np.flatnonzero(good[b : b + n] < 0.5).tolist() for b, n in zip(begins, lines)]
        return {"score": shared.value.score(shares), "bad_lines": bad}

    return common.map_texts(df, columns, {"score": ("double", pa.float64()), "bad_lines": ("array<int>", pa.list_(pa.int32()))})
