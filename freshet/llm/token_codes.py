"""Token ids as directly addressable codes: any token can be read without decoding a block.

An id is cut into chunks of eight bits. The first level holds the lowest chunk of every id; a bitmap marks the ids that
go on, and their next chunks stand densely in the next level, where a marked id's place is the number of marks before
it. Rank directories (marks before every 512 bits, and inside these before every 64) give that number at once.

Documents are range-partitioned by id and written as segments: whole documents of about ``SEGMENT`` ids together, or one
longer document. A segment is a row of a parquet table, so Spark commits files and repeats lost tasks; it holds the
part it belongs to, its place there, the ids and starts of its documents and the codes. What stands before a part is the
sum over parts, so a token's place in the whole order needs no pass over the tokens.

A null or empty text has the end id only, or no id where none is given. Null document ids come first; rows with equal ids
stand in the order of their texts' hashes, equal rows side by side. Columns other than id and text are ignored. An empty
table has no segments. A text of any length is one document of one segment.
"""

from __future__ import annotations

import json
import os
import re
import struct
import unicodedata
from collections.abc import Callable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from freshet.llm import bpe, common
from freshet.session import scratch_path, store

#: Ids of a segment, unless one document has more.
SEGMENT = 1 << 18
CHUNK_BITS = 8
#: First bytes of a code block, words of 64 bits between two entries of the upper rank directory.
MAGIC = b"DAC1"
WORDS = 8

#: White-space separated words remembered at most, their pieces and ids; beyond any, a worker forgets them all.
CACHED_WORDS = 300_000
CACHED_IDS = 3_000_000
#: Words and pieces longer than this many characters are not kept.
CACHED_CHARS = 64
#: Texts encoded together have at most this many characters, or are one text.
BATCH_CHARS = 2_000_000
#: New pieces are handed to the library so many at a time.
TOGETHER = 256
#: Characters tried for agreement: Latin ones and general punctuation.
TRIED = [9, 10, 13, *range(0x20, 0x7F), *range(0xA1, 0x250), *range(0x2010, 0x2028)]


def encode_codes(ids: np.ndarray) -> bytes:
    """One block: magic, number of levels, then per level its number of chunks, the chunks, bitmap and directories."""
    rest, levels = ids.astype(np.uint32), []
    while True:
        chunk = (rest & ((1 << CHUNK_BITS) - 1)).astype(np.uint8)
        rest = rest >> CHUNK_BITS
        more = rest > 0
        if not more.any():
            levels.append(struct.pack("<q", len(chunk)) + chunk.tobytes())
            break
        bits = np.zeros(-(-len(chunk) // 64) * 8, dtype=np.uint8)
        packed = np.packbits(more, bitorder="little")
        bits[: len(packed)] = packed
        words = bits.view(np.uint64)
        before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])[:-1]
        upper = before[::WORDS].astype(np.uint64)
        lower = (before - np.repeat(before[::WORDS], WORDS)[: len(before)]).astype(np.uint16)
        levels.append(struct.pack("<q", len(chunk)) + chunk.tobytes() + words.tobytes() + upper.tobytes() + lower.tobytes())
        rest = rest[more]
    return MAGIC + struct.pack("<b", len(levels)) + b"".join(levels)


class Codes:
    """Read access to a block; the block is used where it lies, nothing is unpacked."""

    def __init__(self, block: bytes):
        if block[:4] != MAGIC:
            raise ValueError("not a block of directly addressable codes")
        count, at = block[4], 5
        self.levels = []

        def take(kind, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(block, dtype=kind, count=n, offset=at)
            at += out.nbytes
            return out

        for level in range(count):
            n = int(take("<i8", 1)[0])
            chunk, words = take("u1", n), -(-n // 64)
            if level == count - 1:
                self.levels.append((chunk, None, None, None))
            else:
                self.levels.append((chunk, take("<u8", words), take("<u8", -(-words // WORDS)), take("<u2", words)))

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def span(self, begin: int, end: int) -> np.ndarray:
        """The ids from ``begin`` to before ``end``: on every level they stand side by side."""
        out, who, a, b = np.zeros(end - begin, dtype=np.uint32), None, begin, end
        for k, (chunk, words, upper, lower) in enumerate(self.levels):
            part = chunk[a:b].astype(np.uint32) << np.uint32(CHUNK_BITS * k)
            if who is None:
                out[:] = part
            else:
                out[who] |= part
            if words is None or a >= b:
                break
            first, last = a >> 6, (b + 63) >> 6
            more = np.unpackbits(words[first:last].view(np.uint8), bitorder="little")[a - (first << 6) : b - (first << 6)].view(bool)
            who = np.flatnonzero(more) if who is None else who[more]
            word = words[first] & ((np.uint64(1) << np.uint64(a & 63)) - np.uint64(1))
            a = int(upper[a >> 9]) + int(lower[first]) + int(np.bitwise_count(word))
            b = a + len(who)
        return out

    def get(self, at: np.ndarray) -> np.ndarray:
        """The ids at these places, in any order."""
        out, who = np.zeros(len(at), dtype=np.uint32), np.arange(len(at))
        for k, (chunk, words, upper, lower) in enumerate(self.levels):
            out[who] |= chunk[at].astype(np.uint32) << np.uint32(CHUNK_BITS * k)
            if words is None:
                break
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            go = (word >> bit & np.uint64(1)).astype(bool)
            word, bit, at, who = word[go], bit[go], at[go], who[go]
            within = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            at = upper[at >> 9].astype(np.int64) + lower[at >> 6] + within
        return out


def _gather(ids: np.ndarray, begin: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the given entries in a row, and how many each has."""
    size = begin[which + 1] - begin[which]
    upto = np.cumsum(size)
    return ids[np.arange(upto[-1] if len(upto) else 0) + np.repeat(begin[which] - (upto - size), size)], size


_NONE = (np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64))


class Library:
    """The tokenizer library's ids. Each distinct word, and each piece that the file's own pattern cuts it into, is encoded once.

    Cutting is done here for characters on whose class and lower case the library and Python's pattern are found to
    agree; words with any other character, or with a special token, go to the library as they are.
    """

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.marks = sorted({f(t[:2]) for t in special for f in (str, str.lower, str.upper)})
        self.white = regex.compile(f"[{bpe.WHITE}]+")
        self.chars = bpe.byte_chars()
        self.pattern = self._pattern(json.loads(spec))
        # the same model without normalising and cutting
        self.merger = Tokenizer(self.tokenizer.model)
        self.merger.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self.forget()
        self.forget_pieces()

    def _pattern(self, whole: dict) -> re.Pattern | None:
        """The pattern that cuts a text into pieces, if the file drops all else; also sets ``odd``."""
        steps = whole["pre_tokenizer"].get("pretokenizers", [])
        if [p["type"] for p in steps] != ["Split", "ByteLevel"] or steps[0]["behavior"] != "Removed" or not steps[0]["invert"] or steps[1]["use_regex"] or steps[1]["add_prefix_space"]:
            return None
        suffix = whole["model"].get("end_of_word_suffix")
        if not suffix:
            return None
        vocab = whole["model"]["vocab"]
        self.is_end = np.zeros(1 + max(vocab.values()), dtype=bool)
        self.is_end[[i for token, i in vocab.items() if token.endswith(suffix)]] = True
        pattern = regex.compile(steps[0]["pattern"]["Regex"].replace(r"\s", bpe.WHITE))

        def agreed(c: str) -> bool:
            for text in (c, f"a{c}b", f"1{c}1", f"#{c}#", c + c):
                normal = self.tokenizer.normalizer.normalize_str(text)
                if [normal[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)] != pattern.findall(text.lower()):
                    return False
            return not unicodedata.combining(c)

        plain = [c for c in map(chr, TRIED) if agreed(c)]
        self.odd = re.compile("|".join([f"[^{''.join(map(re.escape, plain))}]", *map(re.escape, self.marks)]))
        # the same with the classes written out, for a faster engine; a line break parts words
        written = pattern.pattern
        for name in "LN":
            own = [c for c in plain if regex.match(rf"\p{{{name}}}", c)]
            written = written.replace(rf"\p{{{name}}}", "".join(map(re.escape, own)))
        return re.compile(f"{written}|\n")

    def forget(self) -> None:
        """Remember no words."""
        self.number: dict[str, int] = {}
        self.ids = np.zeros(0, dtype=np.int32)
        self.begin = np.zeros(1, dtype=np.int64)

    def forget_pieces(self) -> None:
        """Remember no piece but the line break between words, which is number 0 and has no ids."""
        self.pieces: dict[str, int] = {"\n": 0}
        self.piece_ids = np.zeros(0, dtype=np.int32)
        self.piece_begin = np.zeros(2, dtype=np.int64)

    def _normal(self, text: str) -> str:
        """The text in lower case, but for words with characters that the library has to look at."""
        if not self.odd.search(text):
            return text.lower()
        words = [w for w in self.white.split(text) if w]
        self.strange.update([w for w in words if self.odd.search(w)])
        return " ".join([w if w in self.strange else w.lower() for w in words])

    def _alone(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that the library cuts itself."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        return np.fromiter(chain.from_iterable(found), dtype=np.int32, count=int(sizes.sum())), sizes

    def _learn(self, pieces: list[str]) -> None:
        """Encode and number pieces not seen before, many in one call: a piece's last id, and no other, is a word end."""
        mapped = [p if p.isascii() else "".join([self.chars[b] for b in p.encode()]) for p in pieces]
        joined = [" ".join(mapped[i : i + TOGETHER]) for i in range(0, len(mapped), TOGETHER)]
        flat = np.array(list(chain.from_iterable([e.ids for e in self.merger.encode_batch_fast(joined)])), dtype=np.int32)
        ends = np.flatnonzero(self.is_end[flat]) + 1
        if len(ends) != len(pieces):
            raise ValueError("pieces do not come apart at word ends")
        first = len(self.piece_begin) - 1
        self.pieces.update(zip(pieces, range(first, first + len(pieces))))
        self.piece_begin = np.concatenate([self.piece_begin, len(self.piece_ids) + ends])
        self.piece_ids = np.concatenate([self.piece_ids, flat])

    def _cut(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that are cut here."""
        cut = self.pattern.findall("\n".join(words) + "\n")
        fresh = list(set(cut).difference(self.pieces))
        if fresh:
            self._learn(fresh)
        which = np.fromiter(map(self.pieces.__getitem__, cut), dtype=np.int64, count=len(cut))
        flat, size = _gather(self.piece_ids, self.piece_begin, which)
        at = np.concatenate([[0], np.cumsum(size)])
        return flat, np.diff(np.concatenate([[0], at[np.flatnonzero(which == 0)]]))

    def _add(self, words: list[str]) -> None:
        """Encode and number words not seen before."""
        odd = words if self.pattern is None else [w for w in words if w in self.strange] if self.strange else []
        if odd and self.pattern is not None:
            words = [w for w in words if w not in self.strange] + odd
        (a, m), (b, n) = self._cut(words[: len(words) - len(odd)]) if len(odd) < len(words) else _NONE, self._alone(odd) if odd else _NONE
        first = len(self.begin) - 1
        self.number.update(zip(words, range(first, first + len(words))))
        self.begin = np.concatenate([self.begin, len(self.ids) + np.cumsum(np.concatenate([m, n]))])
        self.ids = np.concatenate([self.ids, a, b])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each text has."""
        if len(self.number) > CACHED_WORDS or len(self.ids) > CACHED_IDS:
            self.forget()
        if len(self.pieces) > CACHED_WORDS:
            self.forget_pieces()
        self.strange: set[str] = set()
        if self.pattern is None:
            words, upto = pa.array(texts, type=pa.string()), np.arange(len(texts) + 1)
        else:
            cut = pc.ascii_split_whitespace(pa.array(list(map(self._normal, texts)), type=pa.string()))
            words, upto = cut.flatten(), cut.offsets.to_numpy()
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # several times faster than to_pylist
        which = np.fromiter(map(self.number.get, distinct, repeat(-1)), dtype=np.int64, count=len(distinct))
        new = np.flatnonzero(which < 0).tolist()
        missing = [distinct[i] for i in new]
        if missing:
            self._add(missing)
            which[new] = [self.number[w] for w in missing]
        flat, size = _gather(self.ids, self.begin, which[coded.indices.to_numpy()])
        ends = np.concatenate([[0], np.cumsum(size)])
        for part in missing:
            if len(part) > CACHED_CHARS:
                del self.number[part]
                self.pieces.pop(part, None)
        return flat, np.diff(ends[upto])


NAMES = ["part", "segment", "first", "n", "doc_ids", "starts", "codes"]
SCHEMA = "part int, segment int, first bigint, n bigint, doc_ids array<bigint>, starts array<bigint>, codes binary"
KINDS = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]


def write(docs: DataFrame, path: str, end: int | None = None, out: str | None = None, id_col: str = "doc_id", text_col: str = "text", segment_ids: int = SEGMENT) -> DataFrame:
    """Encode texts with the vocabulary file ``path``, write them in order of their ids to ``out``, and return the segments.

    ``end`` is appended to every document. ``out`` is a folder in the shared scratch folder where none is given.
    """
    df = common.documents(docs, id_col, text_col)
    shared = bpe.share(df, path)
    keyed = df.withColumns({"_tie": F.xxhash64("text"), "_at": F.monotonically_increasing_id()})
    order = ["doc_id", "_tie", "_at"]  # equal rows may spread over tasks
    spread = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.loaded(Library, shared)
        part, segment, first = TaskContext.get().partitionId(), 0, 0
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            nonlocal segment, first, held
            ids = np.concatenate([x for _, x in held])
            starts = np.concatenate([[0], np.cumsum([len(x) for _, x in held])])
            row = [part, segment, first, len(ids), [d for d, _ in held], starts, encode_codes(ids)]
            segment, first, held = segment + 1, first + len(ids), []
            return pa.RecordBatch.from_arrays([pa.array([v], type=t) for v, t in zip(row, KINDS)], names=NAMES)

        count = 0
        for batch in batches:
            texts, names = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
            for begin, upto in common.pieces(texts, BATCH_CHARS):
                flat, sizes = coder.encode(texts[begin:upto])
                at = np.cumsum(sizes)
                for name, a, b in zip(names[begin:upto], at - sizes, at):
                    own = flat[a:b] if end is None else np.append(flat[a:b], np.int32(end))
                    if held and count + len(own) > segment_ids:
                        yield flush()
                        count = 0
                    held.append((name, own))
                    count += len(own)
        if held:
            yield flush()

    out = out or scratch_path(df.sparkSession, "token-codes")
    spread.mapInArrow(run, SCHEMA).write.parquet(out)
    return load(docs, out)


def load(like: DataFrame, out: str) -> DataFrame:
    """Segments of a folder, read by the session of ``like``."""
    return like.sparkSession.read.schema(SCHEMA).parquet(out)


def _based(segments: DataFrame) -> DataFrame:
    """Segments with ``begin``, their first id's place in the whole order. There are as many parts as tasks wrote."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = segments.groupBy("part").agg(F.sum("n").alias("n"))
    base = store(parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "parts")
    joined = common.join_small(segments, base, ["part"], "inner")
    return joined.withColumn("begin", F.col("base") + F.col("first")).drop("base")


def read(segments: DataFrame, digest: Callable[[np.ndarray], object], name: str, kind: tuple[str, pa.DataType]) -> DataFrame:
    """``doc_id, start, n_tokens`` and, as ``name``, what ``digest`` makes of the ids of every document.

    ``kind`` is that column's Spark and Arrow type.
    ``start`` counts the ids of all documents before.
    """
    common.small_batches(segments.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, docs, starts, block in zip(*[batch.column(c) for c in ("begin", "doc_ids", "starts", "codes")]):
                codes, starts = Codes(block.as_py()), starts.values.to_numpy()
                ids = codes.span(0, len(codes))
                made = [digest(ids[a:b]) for a, b in zip(starts[:-1], starts[1:])]
                yield pa.RecordBatch.from_arrays(
                    [docs.values, pa.array(begin.as_py() + starts[:-1]), pa.array(np.diff(starts)), pa.array(made, type=kind[1])], names=["doc_id", "start", "n_tokens", "made"]
                )

    based = _based(segments).select("begin", "doc_ids", "starts", "codes")
    return based.mapInArrow(run, f"doc_id bigint, start bigint, n_tokens bigint, made {kind[0]}").withColumnRenamed("made", name)


def lookup(segments: DataFrame, wanted: DataFrame, at: str = "position") -> DataFrame:
    """``position, id`` of every distinct wanted place of the whole order; places beyond it, or null, give no row.

    Only the wanted ids are touched: places meet their segment by range, and its codes are addressed directly.
    """
    common.small_batches(segments.sparkSession)
    based = _based(segments)
    spans = based.select("part", "segment", "begin", "n", F.explode(F.sequence(F.floor(F.col("begin") / SEGMENT), F.floor((F.col("begin") + F.col("n") - 1) / SEGMENT))).alias("slot"))
    places = wanted.select(F.col(f"`{at}`").cast("long").alias("position")).distinct().withColumn("slot", F.floor(F.col("position") / SEGMENT))
    met = places.join(spans, "slot").where("position >= begin AND position < begin + n").select(F.col("part").alias("p"), F.col("segment").alias("s"), (F.col("position") - F.col("begin")).alias("at"), "begin")

    def pick(places: pa.Table, block: pa.Table) -> pa.Table:
        if not places.num_rows:
            return pa.table({"position": pa.array([], pa.int64()), "id": pa.array([], pa.int64())})
        at = places["at"].to_numpy()
        ids = Codes(block["codes"][0].as_py()).get(at)
        return pa.table({"position": pa.array(at + places["begin"].to_numpy()), "id": pa.array(ids.astype(np.int64))})

    named = met.select(F.col("p").alias("part"), F.col("s").alias("segment")).distinct()
    there = segments.join(named, ["part", "segment"], "left_semi").select("part", "segment", "codes")
    return met.groupBy("p", "s").cogroup(there.groupBy("part", "segment")).applyInArrow(pick, "position bigint, id bigint")
