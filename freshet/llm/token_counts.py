"""Token counts by finite-state transducers.

Two transducers count the tokens of a byte-level BPE file without building ids:

* The splitter reads character classes and marks where words begin. Texts are cut into chunks of equal length;
  for each chunk the map from every start state to the end state is computed, the maps are composed by a parallel
  prefix scan, and with the start states known a second pass marks the cuts.
* The word transducer reads bytes. A state stands for a prefix of a word; the transition that leads to it is
  annotated with the number of tokens it adds (merging can make it negative). A state is compiled when it is first
  reached: of the tokens that can end a prefix exactly one is compatible with the last token of the prefix before it.
  Compiled states are dropped when they pass a fixed number, so memory is bounded.

Texts: null and empty count 0 tokens. Very long texts and words work.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.llm import characters, common
from freshet.llm.bpe import Merger, byte_chars, loaded, share

#: Characters of a chunk; compiled states and remembered words kept at most.
CHUNK = 256
MAX_STATES = 250_000
MAX_WORDS = 120_000
#: Longer words go through exact merging, as their prefixes would not be met again.
MAX_WORD = 64

#: Classes of characters: end of text, space, other white space, digit, apostrophe, other, plain letter, and the
#: letters that can follow an apostrophe in a contraction, which are fixed values of the split pattern.
END, SPACE, WHITE, DIGIT, QUOTE, OTHER, LETTER = range(7)
CONTRACTIONS = ["s", "t", "re", "ve", "m", "ll", "d"]
MARKED = sorted({c for x in CONTRACTIONS for c in x})
WHITE_CHARS = [*range(0x09, 0x0E), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def class_table(known: dict | None = None) -> np.ndarray:
    """Class of every code point; ``known`` is ``characters.tables()``."""
    known = known or characters.tables()
    out = np.full(0x110000, OTHER, dtype=np.uint8)
    for kind, ranges in ((LETTER, known["letters"]), (DIGIT, known["numbers"])):
        for begin, end in ranges:
            out[begin:end] = kind
    out[WHITE_CHARS] = WHITE
    out[ord(" ")] = SPACE
    out[ord("'")] = QUOTE
    for k, c in enumerate(MARKED):
        out[ord(c)] = LETTER + 1 + k
    out[0] = OTHER
    return out


def splitter() -> tuple[np.ndarray, np.ndarray, int]:
    """Next state and cuts by class and state: 1 cuts before the character, 2 before the one before it.

    States: the kind of the word that the last character stands in. A first apostrophe is undecided until the
    next characters show whether it begins a contraction; white space until its run ends.
    """
    names = ["start", "letter", "digit", "other", "space", "white", "space+", "white+", "quote", "closed"]
    names += [f"quote {c[0]}" for c in CONTRACTIONS if len(c) == 2]
    state = {n: i for i, n in enumerate(names)}
    classes = [END, SPACE, WHITE, DIGIT, QUOTE, OTHER, LETTER, *range(LETTER + 1, LETTER + 1 + len(MARKED))]
    kind = {END: "start", DIGIT: "digit", OTHER: "other", QUOTE: "other"}
    move = np.zeros((len(classes), len(names)), dtype=np.uint8)
    cut = np.zeros_like(move)
    for c in classes:
        letter = MARKED[c - LETTER - 1] if c > LETTER else None
        own = kind.get(c, "letter")
        for n in names:
            late = 0
            if n.startswith("quote ") and letter is not None and n[-1] + letter in CONTRACTIONS:
                to, now = "closed", 0
            elif n.startswith("quote "):  # the apostrophe stood alone: the letter after it began a word
                late = 2
                to, now = _plain("letter", c, own)
            elif n == "quote" and letter is not None and letter in CONTRACTIONS:
                to, now = "closed", 0
            elif n == "quote" and letter is not None and any(x[0] == letter for x in CONTRACTIONS):
                to, now = f"quote {letter}", 0
            elif n == "quote":
                to, now = _plain("other", c, own)
            elif n in ("space", "white", "space+", "white+"):
                if c in (SPACE, WHITE):
                    to, now = ("space+" if c == SPACE else "white+"), 0
                elif c == END:
                    to, now = "start", 1
                else:
                    late = 2 if n.endswith("+") else 0
                    joins = n.startswith("space")
                    to, now = ("quote" if c == QUOTE and not joins else own), 0 if joins else 1
            else:
                to, now = _plain(n, c, own)
            move[c, state[n]], cut[c, state[n]] = state[to], now | late
    return move, cut, state["start"]


def _plain(before: str, c: int, own: str) -> tuple[str, int]:
    """State and cut after a character that does not complete anything begun before."""
    if c == SPACE:
        return "space", 1
    if c == WHITE:
        return "white", 1
    if c == END:
        return "start", 1
    if before == own and before in ("letter", "digit", "other"):
        return own, 0
    return ("quote" if c == QUOTE else own), 1


class Counter:
    """Token counts of a byte-level BPE file."""

    def __init__(self, spec: str, known: dict | None = None):
        whole = json.loads(spec)
        vocab = whole["model"]["vocab"]
        number = {c: b for b, c in enumerate(byte_chars())}
        raw = {token: bytes(number[c] for c in token) for token in vocab if all(c in number for c in token)}
        self.token_of = {raw[t]: i for t, i in vocab.items() if t in raw}
        self.merger = Merger(vocab, whole["model"]["merges"])
        self.single = [self.token_of[bytes([b])] for b in range(256)]
        self.bytes_of = {i: t for t, i in self.token_of.items()}
        #: Suffixes of tokens, so that a search for the last token can stop early.
        self.tails = {t[k:] for t in self.token_of for k in range(len(t))}
        special = sorted((a["content"] for a in whole["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.fits: dict[int, bool] = {}
        self.move, self.cut, self.start = splitter()
        self.classes = class_table(known)
        self.words: dict[str, int] = {}
        self.older: dict[str, int] = {}
        self.reset()

    def reset(self) -> None:
        """Only the empty prefix is compiled."""
        self.step: dict[int, int] = {}
        self.last, self.total, self.added = [-1], [0], [0]

    def compatible(self, left: int, right: int) -> bool:
        """Whether two tokens stay apart when their bytes are merged alone; left -1: whether right gives itself."""
        key = (left + 1) << 20 | right
        said = self.fits.get(key)
        if said is None:
            symbols = [self.single[b] for b in (self.bytes_of[left] if left >= 0 else b"") + self.bytes_of[right]]
            said = self.merger.merge(symbols) == ([left, right] if left >= 0 else [right])
            if len(self.fits) > 500_000:
                self.fits.clear()
            self.fits[key] = said
        return said

    def compile(self, path: list[int], word: bytes, i: int) -> int:
        """State of ``word[: i + 1]`` given the states of all shorter prefixes."""
        token_of, tails = self.token_of, self.tails
        j = i
        while True:
            piece = word[j : i + 1]
            token = token_of.get(piece)
            if token is not None and self.compatible(self.last[path[j]], token):
                if j == 0 or self.compatible(-1, token):
                    break
            j -= 1
            if j < 0 or word[j : i + 1] not in tails:
                # no compatible last token: the vocabulary is not closed under its merges
                symbols = self.merger.merge([self.single[b] for b in word[: i + 1]])
                token, count = symbols[-1], len(symbols)
                return self._state(path[i], word[i], token, count)
        return self._state(path[i], word[i], token, self.total[path[j]] + 1)

    def _state(self, before: int, byte: int, token: int, count: int) -> int:
        new = len(self.last)
        self.last.append(token)
        self.total.append(count)
        self.added.append(count - self.total[before])
        self.step[before << 8 | byte] = new
        return new

    def count_word(self, word: str) -> int:
        """Sum of the annotations on the word's path."""
        data = common.encode(word)
        if len(data) > MAX_WORD:
            return len(self.merger.merge([self.single[b] for b in data]))
        if len(self.last) > MAX_STATES:
            self.reset()
        step, at, path, tokens = self.step, 0, [0], 0
        for i, byte in enumerate(data):
            to = step.get(at << 8 | byte)
            at = self.compile(path, data, i) if to is None else to
            path.append(at)
            tokens += self.added[at]
        return tokens

    def marks(self, codes: np.ndarray) -> np.ndarray:
        """Cuts before each class code, by chunk maps, their prefix composition and a marking pass."""
        n, states = len(codes), self.move.shape[1]
        rows = -(-n // CHUNK)
        grid = np.full(rows * CHUNK, END, dtype=np.intp)
        grid[:n] = codes
        grid = np.ascontiguousarray((grid * states).reshape(rows, CHUNK).T)
        move, cut = self.move.ravel(), self.cut.ravel()
        maps = np.repeat(np.arange(states, dtype=np.uint8)[None, :], rows, axis=0)
        for row in grid:
            maps = move.take(row[:, None] + maps)
        shift = 1
        while shift < rows:  # maps[k] becomes the map of all chunks up to k
            maps[shift:] = np.take_along_axis(maps[shift:], maps[:-shift].astype(np.intp), axis=1)
            shift *= 2
        at = np.full(rows, self.start, dtype=np.uint8)
        at[1:] = maps[:-1, self.start]
        out = np.empty((CHUNK, rows), dtype=np.uint8)
        for k, row in enumerate(grid):
            here = row + at
            out[k] = cut.take(here)
            at = move.take(here)
        marks = out.T.ravel()
        before = (marks & 1).astype(bool)
        before[:-1] |= (marks[1:] & 2).astype(bool)
        return before[:n]

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        parts, owner, out = [], [], [0] * len(texts)
        for i, text in enumerate(texts):
            pieces = self.special.split(text) if self.special and "<" in text else [text]
            out[i] = len(pieces) - 1
            parts += pieces
            owner += [i] * len(pieces)
        joined = "\0".join(parts) + "\0"
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        codes = self.classes[points]
        ends = np.cumsum([len(p) + 1 for p in parts]) - 1
        codes[ends] = END
        before = self.marks(codes)
        before[0] = True
        before[ends[:-1] + 1] = True
        cuts = np.flatnonzero(before)
        if len(self.words) > MAX_WORDS:
            self.words, self.older = {}, self.words
        held, older = self.words, self.older
        edges = cuts.tolist()
        edges.append(len(joined))
        words = [joined[a:b] for a, b in zip(edges, edges[1:])]
        is_end = codes[cuts] == END
        missing = []
        for w in set(words).difference(held):
            if (n := older.get(w)) is not None:
                held[w] = n
            else:
                missing.append(w)
        for w in missing:
            held[w] = self.count_word(w)
        counts = np.fromiter(map(held.__getitem__, words), dtype=np.int64, count=len(words))
        for w in missing:
            if len(w) > MAX_WORD:
                del held[w]
        counts[is_end] = 0
        sums = np.concatenate([[0], np.cumsum(counts)])
        upto = sums[np.searchsorted(cuts, ends)]
        for i, n in zip(owner, np.diff(np.concatenate([[0], upto])).tolist()):
            out[i] += n
        return out


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """``doc_id``, bytes, tokens and whether the tokens pass ``limit``. One row per input row."""
    df = common.documents(docs, id_col, text_col).withColumn("n_bytes", F.octet_length("text").cast("long"))
    shared = share(df, path, characters.tables())
    counted = common.map_texts(
        df, lambda texts: {"n_tokens": loaded(Counter, shared).count(texts)}, {"n_tokens": ("bigint", pa.int64())}
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
