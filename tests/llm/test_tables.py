"""Token codes, the Merkle manifest and whitening against plain versions."""

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from freshet.llm import merkle, queries, token_codes, whitening
from tests.llm.conftest import prose

BIGINT = ("bigint", pa.int64())
PATH = queries.vocabulary("word_bpe_49k.json")


def crc(ids):
    return zlib.crc32(np.asarray(ids).astype("<u4").tobytes())


@pytest.mark.parametrize("segment", [1 << 18, 100])
def test_token_codes(docs, nothing, rows, segment):
    t = Tokenizer.from_file(PATH)
    written = token_codes.write(docs, PATH, end=1, segment_ids=segment)
    got = token_codes.read(written, crc, "crc", BIGINT).collect()
    own = lambda text: t.encode(text or "", add_special_tokens=False).ids + [1]
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted([(r.doc_id, r.n_tokens, r.crc) for r in got], key=key) == sorted([(d, len(own(x)), crc(own(x))) for d, x in rows], key=key)
    # places follow each other in the order of ids, nulls first
    inorder = sorted(got, key=lambda r: r.start)
    assert [r.start for r in inorder] == np.cumsum([0, *[r.n_tokens for r in inorder]])[:-1].tolist()
    ids = [r.doc_id for r in inorder]
    assert ids == sorted(ids, key=lambda d: (d is not None, d or 0))
    assert token_codes.read(token_codes.write(nothing, PATH), crc, "crc", BIGINT).collect() == []


def test_token_lookup(spark, docs, nothing):
    written = token_codes.write(docs, PATH, segment_ids=50)
    held = token_codes.read(written, lambda ids: ids.tolist(), "ids", ("array<bigint>", pa.list_(pa.int64()))).collect()
    stream = [i for r in sorted(held, key=lambda r: (r.start, r.start + r.n_tokens)) for i in r.ids]
    at = [0, 7, 7, 49, 50, 51, 999, len(stream) - 1, len(stream), -1, None]
    wanted = spark.createDataFrame([(p, "x") for p in at], "position long, codes string")
    got = {r.position: r.id for r in token_codes.lookup(written, wanted).collect()}
    assert got == {p: stream[p] for p in at if p is not None and 0 <= p < len(stream)}
    assert token_codes.lookup(token_codes.write(nothing, PATH), wanted).collect() == []


@pytest.mark.parametrize("top", [1, 200, 256, 70_000, 2**32 - 1])
def test_codes_round_trip(top):
    rng = np.random.default_rng(top)
    for n in (0, 1, 63, 64, 65, 513, 5000):
        ids = (rng.integers(0, top, n, endpoint=True) >> rng.integers(0, 32, n)).astype(np.uint32)
        codes = token_codes.Codes(token_codes.encode_codes(ids))
        assert len(codes) == n
        assert codes.get(np.arange(n)).tolist() == ids.tolist()
        at = rng.integers(0, n, 100) if n else np.zeros(0, dtype=np.int64)
        assert codes.get(at).tolist() == ids[at].tolist()
        for a, b in rng.integers(0, n + 1, (20, 2)):
            assert codes.span(min(a, b), max(a, b)).tolist() == ids[min(a, b) : max(a, b)].tolist()
    with pytest.raises(ValueError):
        token_codes.Codes(b"other bytes")


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_words_alone_give_the_library_ids(rows, name):
    with open(queries.vocabulary(name), encoding="utf-8") as f:
        coder = token_codes.Library(f.read())
    t = Tokenizer.from_file(queries.vocabulary(name))
    rng = np.random.default_rng(3)
    odd = list("aA zΣσς\x1c\x1f\x85\xa0 　é́̈ǅİ<|>endoftext'sΐ漢12\n\tᲉꟚ\U00010d50")
    texts = [t or "" for _, t in rows] + ["".join(rng.choice(odd, rng.integers(0, 30))) for _ in range(3000)] + ["x<|ENDOFTEXT|>y", "<|endoftext|>", " <|startoftext|> a"]
    flat, sizes = coder.encode(texts)
    want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    assert sizes.tolist() == list(map(len, want))
    assert flat.tolist() == [i for ids in want for i in ids]


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_manifest(rows, fields):
    """rows: (group, id, fields, claimed fields); all of (id, leaf, subroot, root, proof hash, folded root, verified)."""
    mark = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda values: H("".join(map(mark, values)))

    def tree(nodes):
        proofs, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for i, a in enumerate(at):
                run = nodes[a - a % 16 : a - a % 16 + 16]
                proofs[i].append(("".join(run[: a % 16]), "".join(run[a % 16 + 1 :])))
            nodes = [H("".join(nodes[i : i + 16])) for i in range(0, len(nodes), 16)]
            at = [a // 16 for a in at]
        return nodes[0], proofs

    groups = {}
    for g, i, own, claimed in rows:
        groups.setdefault(g, []).append((i is not None, i or 0, leaf(own), leaf(claimed)))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    built = {g: (sorted(groups[g]), *tree([x[2] for x in sorted(groups[g])])) for g in names}
    root, upper = tree([built[g][1] for g in names])
    out = []
    for g, above in zip(names, upper):
        for (known, i, own, claimed), proof in zip(built[g][0], built[g][2]):
            h = claimed
            for left, right in proof + above:
                h = H(left + h + right)
            out.append((i if known else None, own, built[g][1], root, H("".join(a + b for a, b in proof + above)), h, h == root))
    return out


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


@pytest.mark.parametrize("levels", [1, 3])
@pytest.mark.parametrize("many", [0, 600])
def test_manifest(spark, rows, levels, many):
    full = [(d, [None, "", "s", "é", "t"][k % 5], "x" if k % 3 else None, k if k % 2 else None, t) for k, (d, t) in enumerate(rows)]
    full += [(1000 + k % 590, "hot" if k % 3 else f"g{k}", "de", 5, f"Text {k % 7}") for k in range(many)]
    df = spark.createDataFrame([(*r, 1, "p", True) for r in full], "doc_id long, source string, lang string, n_chars long, text string, pos int, group string, size boolean").repartition(7)
    touched = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 0
    low = lambda t: None if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    expected = plain_manifest([(r[1], r[0], r, (*r[:4], low(r[4])) if touched(r[0]) else r) for r in full], FIELDS)
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    proved = merkle.manifest(merkle.leaves(df, FIELDS, held, F.translate("text", merkle.UPPER, merkle.LOWER)), levels)
    got = proved.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256), "folded_root", "verified").collect()
    key = lambda r: (r[0] is not None, r[0] or 0, *map(str, r[1:]))
    assert sorted(map(tuple, got), key=key) == sorted(expected, key=key)
    assert len({r[2] for r in got}) > 1 and True in {r[-1] for r in got}
    assert many == 0 or False in {r[-1] for r in got}


def test_manifest_of_nothing_and_of_one(spark, nothing):
    df = spark.createDataFrame([(1, None)], "doc_id long, source string")
    assert merkle.manifest(merkle.leaves(df.where("false"), ["doc_id"])).collect() == []
    (r,) = merkle.manifest(merkle.leaves(df, ["doc_id", "source"])).collect()
    assert r.leaf == r.subroot == r.root == r.folded_root == H("1:1-") and r.proof == "" and r.verified


def plain_whitening(vectors, k):
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors], dtype=object)
    fit = np.array(sorted({tuple(v) for v in x}), dtype=object)
    n, total = len(fit), fit.sum(axis=0)
    y = np.array((n * fit - total) / n, dtype=float)
    values, vecs = np.linalg.eigh(y.T @ y / n)
    values, vecs = values[::-1], vecs[:, ::-1]
    return n, ((n * x - total) ** 2).sum(axis=1), np.array((n * x - total) / n, dtype=float) @ vecs[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


def test_whitening(spark):
    rng = np.random.default_rng(5)
    good = (rng.normal(size=(300, 6)) * [3, 2.9, 1, 0.5, 0.2, 0.1]).astype(np.float32)
    good[200:] = good[0]  # a third are copies
    rows = [(i if i else None, v.tolist(), "x", 7) for i, v in enumerate(good)]
    bad = [(900, None, "x", 7), (901, [None] * 6, "x", 7), (902, [float("nan")] * 6, "x", 7), (903, [1.0, float("-inf"), 0.0, 0.0, 0.0, 0.0], "x", 7), (904, [], "x", 7)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, x string, n int").repartition(4)
    got = whitening.whiten(df, 4).toPandas()
    n, deviation, white, explained = plain_whitening(good, 4)
    assert len(got) == 1200 and set(got["n"]) == {n} == {200} and got["identity_error"].max() < 1e-9
    own = got[got["component"] == 1].set_index(got[got["component"] == 1]["vec_id"].fillna(0).astype(int))
    assert own.loc[range(300), "deviation"].tolist() == deviation.tolist()
    for c in range(4):
        part = got[got["component"] == c + 1]
        values = part.set_index(part["vec_id"].fillna(0).astype(int)).loc[range(300), "whitened"].to_numpy()
        assert np.abs(values * np.sign(values @ white[:, c]) - white[:, c]).max() < 1e-9
        assert abs(part["explained"].iloc[0] / explained[c] - 1) < 1e-9
    assert whitening.whiten(df.where("vec_id >= 900"), 4).collect() == []
    assert whitening.whiten(df.where("false"), 4).columns == got.columns.tolist()


def test_whitening_of_flat_single_mixed_and_huge_vectors(spark):
    rows = [(i, [1.0, float(i % 4), 2.0 * (i % 4)]) for i in range(12)]  # one direction only
    (share,) = {(r.component, round(r.explained, 12)) for r in whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 3).collect()}
    assert share == (1, 1.0)
    assert whitening.whiten(spark.createDataFrame(rows[:1] * 3, "vec_id long, embedding array<double>"), 3).collect() == []
    mixed = spark.createDataFrame([(i, [float(i)] * (1 + i % 2)) for i in range(10)], "vec_id long, embedding array<double>")
    assert sorted((r.vec_id, r.n) for r in whitening.whiten(mixed, 1).collect()) == [(i, 5) for i in range(10)]
    huge = whitening.whiten(spark.createDataFrame([(1, [1e300]), (2, [-1e300]), (3, [0.0])], "vec_id long, embedding array<double>"), 1).collect()
    assert {r.vec_id: r.deviation for r in huge} == {1: None, 2: None, 3: 0} and all(abs(r.identity_error) < 1e-9 for r in huge)


@pytest.mark.parametrize("values", [[5, 4, 3, 2, 1], [5, 5, 5, 1, 1], [5, 5 + 1e-7, 5 + 2e-7, 1, 1 - 1e-9], [1] * 6, [1e-12, 3, 3, 0, 0]])
def test_refinement_of_clustered_eigenvalues(values):
    q, _ = np.linalg.qr(np.random.default_rng(1).normal(size=(len(values), len(values))))
    a = q @ np.diag(values) @ q.T
    a = (a + a.T) / 2
    found, x = whitening.eigen(a)
    assert np.abs(found - np.sort(values)[::-1]).max() < 1e-13 * max(values) * 10
    assert np.abs(x.T @ x - np.eye(len(values))).max() < 1e-13
    assert np.abs(a @ x - x * found).max() < 1e-13 * max(values) * 10
    rough = np.linalg.eigh(a.astype(np.float32))[1].astype(float)
    assert np.abs(rough.T @ rough - np.eye(len(values))).max() > 1e-9 or len(set(values)) == 1


def test_long_text_is_one_document(spark):
    df = spark.createDataFrame([(1, prose(1, 60_000)), (0, "a")], "doc_id long, text string")
    got = token_codes.read(token_codes.write(df, PATH, segment_ids=1000), len, "n", BIGINT).orderBy("doc_id").collect()
    assert [r.start for r in got] == [0, got[0].n] and got[1].n == got[1].n_tokens > 60_000


def test_known_words_cost_less_than_a_list_of_scalars():
    """Looking up words seen before takes less time than ``to_pylist`` alone, which the look-up used to call."""
    import time

    with open(PATH, encoding="utf-8") as f:
        coder = token_codes.Library(f.read())
    words = [a + b + c + d for a in "abcdefghijklmnopqrst" for b in "aeiou" for c in "bcdfgklmnprstvwz" for d in "abcdefghijklmnopqrst"]
    text, column = [" ".join(words)], pa.array(words)

    def cost(run) -> float:
        best = float("inf")
        for _ in range(9):
            begin = time.process_time()
            run()
            best = min(best, time.process_time() - begin)
        return best

    first = coder.encode(text)[0]
    assert first.tolist() == coder.tokenizer.encode(text[0], add_special_tokens=False).ids
    assert (coder.encode(text)[0] == first).all()
    assert cost(lambda: coder.encode(text)) < cost(column.to_pylist)
