"""BPE encoding and decoding by speculation and verification.

Words get a greedy longest-match proposal first. A sequence of tokens is what exact merging gives if, and only
if, each token stands for itself and every two neighbours stay apart when merged alone, so one vectorised look-up
of all adjacent pairs of a batch accepts most proposals. Only words with a failing pair go through exact merging.

Texts: null and empty give no ids and an empty text. Words of any length work; the cache of words is bounded.
"""

from __future__ import annotations

import json
import unicodedata
from heapq import heapify, heappop, heappush
from itertools import chain, pairwise, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from freshet.llm import characters, common

#: Fixed values of the file format: bytes that stand for themselves in byte-level vocabularies.
PLAIN_BYTES = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
#: Fixed value: white space as the tokenizer library's patterns know it.
WHITE = "\t-\r \x85\xa0  -     　"

#: Words remembered at most, and their ids; beyond either, a worker forgets them all.
CACHED_WORDS = 400_000
CACHED_IDS = 4_000_000
#: Words longer than this many characters are not kept in the cache.
CACHED_CHARS = 64


def byte_chars() -> list[str]:
    """The character by which byte-level vocabularies write each byte."""
    plain = set(PLAIN_BYTES)
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


#: Above any packed rank; the low bits of a packed rank hold the merged symbol.
NONE = 1 << 62
LOW = 20
#: Longer sequences are merged with a heap.
SHORT = 48
#: Sequences merged together have at most this many symbols each, and are so many at most.
WIDTHS = [4, 8, 12, 16, 24, 32, SHORT]
TOGETHER = 20_000


class Merger:
    """Exact merging by rank over the symbols of a vocabulary."""

    def __init__(self, vocab: dict, merges: list):
        self.rank: dict[tuple[int, int], int] = {}
        for i, pair in enumerate(merges):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.rank.setdefault((vocab[left], vocab[right]), i << LOW | vocab[left + right])
        pairs = np.array([a << LOW | b for a, b in self.rank], dtype=np.int64)
        order = np.argsort(pairs)
        self.pairs = np.append(pairs[order], NONE)
        self.packed = np.append(np.fromiter(self.rank.values(), dtype=np.int64, count=len(pairs))[order], NONE)

    def merge(self, symbols: list[int]) -> list[int]:
        """Merge the leftmost pair of the lowest rank until no pair has one."""
        if len(symbols) > SHORT:
            return self.merge_long(symbols)
        get, absent = self.rank.get, repeat(NONE)
        while len(symbols) > 1:
            ranks = list(map(get, zip(symbols, symbols[1:]), absent))
            best = min(ranks)
            if best == NONE:
                break
            i = ranks.index(best)
            symbols[i : i + 2] = [best & ((1 << LOW) - 1)]
        return symbols

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Packed rank of each pair of symbols; ``NONE`` where it has none or ``right`` is -1."""
        keys = np.where(right < 0, NONE, left << LOW | right)
        at = np.searchsorted(self.pairs, keys)
        return np.where(self.pairs[at] == keys, self.packed[at], NONE)

    def merge_many(self, rows: list[list[int]]) -> list[list[int]]:
        """``merge`` of many sequences: every round merges the lowest pair of each sequence at once."""
        out: list = [None] * len(rows)
        sizes = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows))
        for i in np.flatnonzero(sizes > SHORT).tolist():
            out[i] = self.merge_long(rows[i])
        least = -1
        for width in WIDTHS:
            some = np.flatnonzero((sizes > least) & (sizes <= width))
            least = width
            for k in range(0, len(some), TOGETHER):
                self._merge_block(rows, some[k : k + TOGETHER], sizes, width, out)
        return out

    def _merge_block(self, rows: list[list[int]], who: np.ndarray, sizes: np.ndarray, width: int, out: list) -> None:
        """Merge the sequences ``who`` of at most ``width`` symbols; their last column stays empty."""
        symbols = np.full((len(who), width + 1), -1, dtype=np.int64)
        filled = np.arange(width + 1) < sizes[who, None]
        symbols[filled] = np.fromiter(chain.from_iterable([rows[i] for i in who]), dtype=np.int64, count=int(sizes[who].sum()))
        rank = self.ranks(symbols[:, :-1], symbols[:, 1:])
        columns = np.arange(width + 1)
        while len(who):
            best = rank.argmin(axis=1)
            value = rank[np.arange(len(who)), best]
            going = value < NONE
            if not going.all():
                ended = symbols[~going]
                for i, row, n in zip(who[~going].tolist(), ended.tolist(), (ended >= 0).sum(axis=1).tolist()):
                    out[i] = row[:n]
                who, symbols, rank, best, value = (x[going] for x in (who, symbols, rank, best, value))
            row = np.arange(len(who))
            source = np.minimum(columns + (columns > best[:, None]), width)
            symbols = np.take_along_axis(symbols, source, axis=1)
            symbols[row, best] = value & ((1 << LOW) - 1)
            rank = np.take_along_axis(rank, np.minimum(source[:, :-1], width - 1), axis=1)
            rank[row, best] = self.ranks(symbols[row, best], symbols[row, best + 1])
            inner = row[best > 0]
            before = best[inner] - 1
            rank[inner, before] = self.ranks(symbols[inner, before], symbols[inner, before + 1])

    def merge_long(self, symbols: list[int]) -> list[int]:
        """The same with a heap of candidate pairs over a linked list."""
        n, rank = len(symbols), self.rank
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        value: list = list(symbols)
        heap = [(r, i, p) for i, p in enumerate(pairwise(symbols)) if (r := rank.get(p)) is not None]
        heapify(heap)
        while heap:
            r, i, pair = heappop(heap)
            j = right[i]
            if value[i] != pair[0] or j < 0 or value[j] != pair[1]:
                continue
            value[i], value[j] = r & ((1 << LOW) - 1), -1
            right[i] = right[j]
            if right[i] >= 0:
                left[right[i]] = i
            for a, b in ((left[i], i), (i, right[i])):
                if a >= 0 and b >= 0 and (r := rank.get((value[a], value[b]))) is not None:
                    heappush(heap, (r, a, (value[a], value[b])))
        return [v for v in value if v >= 0]


class WordBpe:
    """Encoder and decoder of a word-level BPE file with a word-end suffix.

    ``known`` is ``characters.tables()``, by which words are cut and lowered like the library does it.
    """

    def __init__(self, spec: str, known: dict | None = None):
        whole = json.loads(spec)
        model = whole["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.merger = Merger(self.vocab, model["merges"])
        self.tokens = [""] * (1 + max([*self.vocab.values(), *(a["id"] for a in whole["added_tokens"])]))
        for token, i in self.vocab.items():
            self.tokens[i] = token
        self.special = {a["content"]: a["id"] for a in whole["added_tokens"]}
        for token, i in self.special.items():
            self.tokens[i] = token
        longest_first = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if longest_first else None
        split = next(p for p in whole["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        known = known or characters.tables()
        pattern = split["pattern"]["Regex"].replace(r"\s", WHITE)
        self.words = regex.compile(pattern)
        # parts with characters that Python classes otherwise are cut by the classes written out
        for name, own in (("L", known["letters"]), ("N", known["numbers"])):
            pattern = pattern.replace(rf"\p{{{name}}}", characters.written(own))
        self.other_words = regex.compile(pattern)
        self.other = regex.compile(f"[{characters.written(known['differing'])}]") if known["differing"] else None
        self.lower = str.maketrans(known["lower"])
        self.lowers = regex.compile(f"[{''.join(map(regex.escape, known['lower']))}]") if known["lower"] else None
        self.white = regex.compile(f"[{WHITE}]+")
        self.chars = byte_chars()
        self.longest: dict[str, int] = {}
        for token in self.vocab:
            bare = token.removesuffix(self.suffix)
            self.longest[bare[:3]] = max(self.longest.get(bare[:3], 1), len(bare))
        self.names = pa.array(self.tokens, type=pa.string())
        self.forget()
        self.own: dict[int, list[int]] = {}
        self.seen = np.zeros(0, dtype=np.int64)
        self.good = np.zeros(0, dtype=bool)
        self.exact_words = self.proposed_words = 0

    def forget(self) -> None:
        """Remember special tokens only: the number of each white-space separated part, and its ids by number."""
        self.number: dict = {i: k for k, i in enumerate(self.special.values())}
        self.ids = np.array(list(self.special.values()), dtype=np.int32)
        self.begin = np.arange(len(self.ids) + 1)

    def symbols(self, piece: str, last: bool) -> list[int]:
        """First symbols of a piece in byte characters; those that the vocabulary lacks are left out."""
        units = list(piece)
        if last and units:
            units[-1] += self.suffix
        return [self.vocab[u] for u in units if u in self.vocab]

    def token_symbols(self, token: int) -> list[int]:
        if (held := self.own.get(token)) is None:
            text = self.tokens[token]
            ends = bool(self.suffix) and text.endswith(self.suffix)
            held = self.own[token] = self.symbols(text[: -len(self.suffix)] if ends else text, ends)
        return held

    def propose(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Longest vocabulary entry at each place of each word, and how many a word has; -1 marks a place where none fits."""
        get, longest, out, upto = self.vocab.get, self.longest.get, [], [0]
        for word in words:
            n, i = len(word), 0
            ended = word + self.suffix
            while i < n:
                most = longest(word[i : i + 3], 2)
                token, j = -1, i + 1
                if i + most >= n:
                    token, j = get(ended[i:], -1), n
                    most = n - i - 1
                if token < 0:
                    for j in range(i + most, i, -1):
                        if (token := get(word[i:j], -1)) >= 0:
                            break
                    else:
                        j = i + 1
                out.append(token)
                i = j
            upto.append(len(out))
        return np.array(out, dtype=np.int64), np.diff(np.array(upto))

    def compatible(self, keys: list[int]) -> list[bool]:
        """Whether exact merging of two tokens' symbols gives the two tokens; right 0: whether left gives itself.

        A key holds the left token and, in its low bits, one more than the right token.
        """
        pairs = [(k >> LOW, (k & ((1 << LOW) - 1)) - 1) for k in keys]
        merged = self.merger.merge_many([self.token_symbols(a) + (self.token_symbols(b) if b >= 0 else []) for a, b in pairs])
        return [m == ([a, b] if b >= 0 else [a]) for m, (a, b) in zip(merged, pairs)]

    def verdicts(self, keys: np.ndarray) -> np.ndarray:
        """Verdict of each pair key; keys not seen before are judged once and kept, the table being bounded."""
        wanted = np.unique(keys)
        if len(self.seen) > 1_000_000:
            self.seen, self.good = self.seen[:0], self.good[:0]
        at = np.searchsorted(self.seen, wanted)
        known = np.zeros(len(wanted), dtype=bool)
        inside = at < len(self.seen)
        known[inside] = self.seen[at[inside]] == wanted[inside]
        fresh = wanted[~known]
        if len(fresh):
            said = np.array(self.compatible(fresh.tolist()), dtype=bool)
            keys_all = np.concatenate([self.seen, fresh])
            order = np.argsort(keys_all, kind="stable")
            self.seen, self.good = keys_all[order], np.concatenate([self.good, said])[order]
        return self.good[np.searchsorted(self.seen, keys)]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-split words, speculating first, and how many each word has."""
        plain = lambda w: w.isascii() and w.isprintable() and " " not in w  # such characters stand for themselves
        mapped = [w if plain(w) else "".join([self.chars[b] for b in common.encode(w)]) for w in words]
        flat, sizes = self.propose(mapped)
        if not len(flat):
            return flat, sizes
        following = np.empty_like(flat)
        following[:-1] = flat[1:]
        ends = np.cumsum(sizes) - 1
        following[ends] = -1
        holes = flat < 0
        keys = (np.where(holes, 0, flat) << LOW) | (np.where(holes | (following < 0), -1, following) + 1)
        ok = self.verdicts(keys) & ~holes
        inner = following >= 0
        own = self.verdicts(flat[inner & ~holes] << LOW)
        ok[np.flatnonzero(inner & ~holes)] &= own
        failing = np.flatnonzero(~np.logical_and.reduceat(ok, ends - sizes + 1))
        exact = self.merger.merge_many([self.symbols(mapped[i], True) for i in failing.tolist()])
        # exact sequences go behind the proposals, from where each word takes its own
        first = ends - sizes + 1
        many = np.fromiter(map(len, exact), dtype=np.int64, count=len(exact))
        first[failing] = len(flat) + np.cumsum(many) - many
        sizes[failing] = many
        flat = np.concatenate([flat, np.fromiter(chain.from_iterable(exact), dtype=np.int64, count=int(many.sum()))])
        upto = np.cumsum(sizes)
        self.proposed_words += len(words)
        self.exact_words += len(failing)
        return flat[np.arange(upto[-1]) + np.repeat(first - (upto - sizes), sizes)], sizes

    def chunks(self, text: str) -> list:
        """White-space separated parts of the normalised text; ids of special tokens stand as integers."""
        out: list = []
        for k, part in enumerate(self.cut.split(text) if self.cut and "<" in text else [text]):
            if k % 2:
                out.append(self.special[part])
                continue
            if not part.isascii():
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
                if self.lowers and self.lowers.search(part):
                    part = part.translate(self.lower)
            part = part.lower()
            if any(c in part for c in "\x1c\x1d\x1e\x1f"):
                out.extend(p for p in self.white.split(part) if p)
            else:
                out.extend(part.split())
        return out

    def learn(self, parts: list[str]) -> None:
        """Encode and number parts not seen before."""
        cut = lambda part: (self.other_words if self.other and not part.isascii() and self.other.search(part) else self.words).findall(part)
        words = list(map(cut, parts))
        fresh, sizes = self.encode_words(list(chain.from_iterable(words)))
        upto = np.concatenate([[0], np.cumsum(sizes)])
        ends = upto[np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)))]
        first = len(self.begin) - 1
        self.number.update(zip(parts, range(first, first + len(parts))))
        self.begin = np.concatenate([self.begin, len(self.ids) + ends])
        self.ids = np.concatenate([self.ids, fresh.astype(np.int32)])

    def encode(self, texts: list[str]) -> pa.ListArray:
        """Ids of each text."""
        if len(self.number) > CACHED_WORDS or len(self.ids) > CACHED_IDS:
            self.forget()
        cut = [self.chunks(t) for t in texts]
        missing = list(set().union(*cut).difference(self.number))
        if missing:
            self.learn(missing)
        many = np.fromiter(map(len, cut), dtype=np.int64, count=len(cut))
        which = np.fromiter(map(self.number.__getitem__, chain.from_iterable(cut)), dtype=np.int64, count=int(many.sum()))
        size = self.begin[which + 1] - self.begin[which]
        ends = np.concatenate([[0], np.cumsum(size)])
        flat = self.ids[np.arange(ends[-1]) + np.repeat(self.begin[which] - ends[:-1], size)]
        offsets = ends[np.concatenate([[0], np.cumsum(many)])]
        for part in missing:
            if len(part) > CACHED_CHARS:
                del self.number[part]
        return pa.ListArray.from_arrays(pa.array(offsets, type=pa.int32()), pa.array(flat))

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """The tokens of each list of ids joined by spaces, as the file names no decoder."""
        return pc.binary_join(pa.ListArray.from_arrays(ids.offsets, self.names.take(ids.values)), " ")


_loaded: dict[str, object] = {}


def loaded(kind, shared):
    """One instance per worker process of a tokenizer built from a broadcast file."""
    key = f"{kind.__name__}:{shared.value[0]}"
    if key not in _loaded:
        _loaded[key] = kind(*shared.value[1:])
    return _loaded[key]


def release() -> None:
    """Drop the worker's tokenizers with their caches: workers are reused, and later stages need the memory."""
    _loaded.clear()
    common.release()


def share(df: DataFrame, path: str, *tables: object):
    """Broadcast a vocabulary file and tables of characters, whose sizes do not depend on the data."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    return df.sparkSession.sparkContext.broadcast((path, text, *tables))


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, the ids of each text as ``ids`` and their decoding as ``decoded``. One row per input row."""
    df = common.documents(docs, id_col, text_col)
    shared = share(df, path, characters.tables())

    def columns(texts: list[str]) -> dict:
        bpe = loaded(WordBpe, shared)
        ids = bpe.encode(texts)
        return {"ids": ids, "decoded": bpe.decode(ids)}

    return common.map_texts(df, columns, {"ids": ("array<int>", pa.list_(pa.int32())), "decoded": ("string", pa.string())}, release)
