"""The operators with one right answer against plain versions or the tokenizer library."""

import pytest
from tokenizers import Tokenizer

from freshet.llm import bpe, line_dedup, queries, substring_dedup, token_counts
from pyspark.sql import functions as F
from tests.llm import brute

key = lambda r: tuple((x is None, x) for x in r)


def same(df, expected):
    assert sorted(map(tuple, df.collect()), key=key) == sorted(expected, key=key)


@pytest.mark.parametrize("block", [None, 3])
def test_line_dedup(docs, nothing, rows, monkeypatch, block):
    if block:
        monkeypatch.setattr("freshet.llm.keyed.BLOCK", block)
    for given, expected in ((docs, brute.line_dedup(rows)), (nothing, [])):
        out = line_dedup.apply_bitmaps(given, line_dedup.keep_bitmaps(given))
        same(out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256)), expected)


@pytest.mark.parametrize("limit", [48 << 20, -1])
def test_substring_dedup(docs, nothing, rows, monkeypatch, limit):
    monkeypatch.setattr("freshet.llm.common.BROADCAST_BYTES", limit)
    for given, expected in ((docs, brute.substring_dedup(rows)), (nothing, [])):
        out = substring_dedup.remove_repeats(given, substring_dedup.repeated_windows(given))
        same(out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)), expected)


def test_bpe(docs, nothing, rows):
    path = queries.vocabulary("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    expected = []
    for doc, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        expected.append((doc, ids, t.decode(ids, skip_special_tokens=False)))
    same(bpe.encode_decode(docs, path), expected)
    same(bpe.encode_decode(nothing, path), [])


def test_bpe_speculation_is_verified(rows):
    with open(queries.vocabulary("word_bpe_49k.json"), encoding="utf-8") as f:
        coder = bpe.WordBpe(f.read())
    coder.encode([t or "" for _, t in rows])
    assert 0 < coder.exact_words < coder.proposed_words


def test_token_counts(docs, nothing, rows):
    path = queries.vocabulary("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    expected = []
    for doc, text in rows:
        n = len(t.encode(text or "", add_special_tokens=False).ids)
        expected.append((doc, len((text or "").encode()), n, n > 512))
    same(token_counts.token_counts(docs, path), expected)
    same(token_counts.token_counts(nothing, path), [])


@pytest.mark.parametrize("chunk", [1, 3, 7])
def test_chunk_maps_do_not_depend_on_the_chunks(rows, monkeypatch, chunk):
    with open(queries.vocabulary("byte_bpe_50k.json"), encoding="utf-8") as f:
        counter = token_counts.Counter(f.read())
    texts = [(t or "")[:400] for _, t in rows]
    whole = counter.count(texts)
    monkeypatch.setattr(token_counts, "CHUNK", chunk)
    assert counter.count(texts) == whole


def test_merging_together_equals_merging_alone(rows):
    with open(queries.vocabulary("word_bpe_49k.json"), encoding="utf-8") as f:
        coder = bpe.WordBpe(f.read())
    words = ["", "a", "zz" * 40, "abc" * 16, *{w for _, t in rows for w in (t or "").split() if w.isascii()}]
    symbols = [coder.symbols(w, True) for w in words]
    assert coder.merger.merge_many([list(s) for s in symbols]) == [coder.merger.merge(list(s)) for s in symbols]
    assert coder.merger.merge_many([]) == []
