"""Operators that search or learn: against plain versions, planted cases and held-out rows."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from freshet.llm import decontaminate, fingerprints, language_id, ngram_join, pii, quality_crf, queries
from tests.llm import brute
from tests.llm.conftest import prose
from tests.llm.test_exact import key, same

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("left", [0, 10**9])
def test_jaccard_join(docs, nothing, rows, monkeypatch, left):
    monkeypatch.setattr(ngram_join, "LEFT_PER_ENTRY", left)
    same(ngram_join.jaccard_join(docs, 4, 85).select("doc_id", "n_shingles", "component_id"), brute.jaccard_components(rows))
    same(ngram_join.jaccard_join(nothing, 4, 85), [])


@pytest.mark.parametrize("percent", [50, 80])
def test_jaccard_join_chains(spark, percent):
    """Chains of texts, each like the next but not like the one after: every hub misses some links."""
    base = prose(40, 400).split()
    made = [(100 + i, " ".join(base[i * 6 : i * 6 + 60])) for i in range(40)] + [(300 + i, " ".join(base[:50] + [f"own{i}"])) for i in range(30)]
    df = spark.createDataFrame(made, "doc_id long, text string").repartition(4)
    out = ngram_join.jaccard_join(df, 3, percent).select("doc_id", "n_shingles", "component_id")
    same(out, brute.jaccard_components(made, 3, percent))


def test_jaccard_join_of_near_copies_below_the_threshold(spark, monkeypatch):
    """240 copies of one text with words changed, most too far apart: the pairs looked at grow with the copies, not with their square."""
    import random

    rng, looked = random.Random(11), []
    base = [f"w{rng.randrange(2_000)}" for _ in range(60)]
    made = []
    for i in range(240):
        text = list(base)
        for _ in range(rng.choice([1, 1, 2, 3])):
            at = rng.randrange(len(text))
            text[at : at + rng.choice([0, 1, 1, 1])] = [f"w{rng.randrange(2_000)}"] * rng.choice([0, 1, 1, 1])
        made.append((i, " ".join(text)))
    overlaps = ngram_join.overlaps

    def counted(df, pairs, *more):
        looked.append(pairs.count())
        return overlaps(df, pairs, *more)

    monkeypatch.setattr(ngram_join, "overlaps", counted)
    df = spark.createDataFrame(made, "doc_id long, text string").repartition(4)
    same(ngram_join.jaccard_join(df, 4, 85).select("doc_id", "n_shingles", "component_id"), brute.jaccard_components(made))
    assert sum(looked) < 10 * len(made)


@pytest.mark.parametrize("percent", [60, 85])
def test_jaccard_join_hands_on_few_ngrams_of_differences(spark, monkeypatch, percent):
    """Copies of one text with words changed, taken out or added: of a difference no more is handed on than two linked sets may differ by."""
    import random

    rng, long = random.Random(5), []
    base = [f"w{rng.randrange(2_000)}" for _ in range(70)]
    made = []
    for i in range(150):
        text = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 6, 9])):
            at = rng.randrange(len(text))
            text[at : at + rng.choice([0, 1, 1, 2])] = [f"w{rng.randrange(2_000)}"] * rng.choice([0, 0, 1, 1, 2])
        made.append((i, " ".join(text)))
    differences = ngram_join.differences

    def measured(*given):
        found = differences(*given)
        long.extend((r["size"], len(r["elems"])) for r in found.collect())
        return found

    monkeypatch.setattr(ngram_join, "differences", measured)
    monkeypatch.setattr(ngram_join, "LEFT_PER_ENTRY", 1)
    df = spark.createDataFrame(made, "doc_id long, text string").repartition(4)
    same(ngram_join.jaccard_join(df, 4, percent).select("doc_id", "n_shingles", "component_id"), brute.jaccard_components(made, 4, percent))
    assert long and all(held <= ngram_join.apart(size + size * 100 // percent, percent) + 1 for size, held in long)


def near_copies(seed: int, words: int, n: int) -> list[tuple]:
    """Copies of one text with no to many words changed, each word into one of two others."""
    import random

    rng = random.Random(seed)
    base = [f"w{rng.randrange(2_000)}" for _ in range(words)]
    made = []
    for i in range(n):
        text = list(base)
        for at in rng.sample(range(words), min(words // 4, int(rng.expovariate(0.25)))):
            text[at] += rng.choice("xy")
        made.append((i, " ".join(text)))
    return made


def test_jaccard_join_of_near_copies_finds_their_middle(spark, monkeypatch):
    """Copies of one text, many too far apart: once they are written as differences, few pairs without a link are left to look at."""
    made, looked = near_copies(3, 120, 300), []
    overlaps = ngram_join.overlaps

    def counted(df, pairs, *more):
        found = overlaps(df, pairs, *more)
        looked.append((pairs.count(), found.count()))
        return found

    monkeypatch.setattr(ngram_join, "overlaps", counted)
    monkeypatch.setattr(ngram_join, "LEFT_PER_ENTRY", 2)
    df = spark.createDataFrame(made, "doc_id long, text string").repartition(4)
    same(ngram_join.jaccard_join(df, 4, 85).select("doc_id", "n_shingles", "component_id"), brute.jaccard_components(made))
    assert sum(pairs for pairs, _ in looked[1:]) <= len(made) // 4, looked


def test_jaccard_join_labels_sets_not_ngrams(spark, monkeypatch):
    """A label is joined once to each set of a hub, not to every n-gram of its difference."""
    made, labelled, handed = near_copies(4, 120, 150), [], []
    add, differences = ngram_join._labelled, ngram_join.differences

    def counted(df, labels):
        labelled.append(df.count())
        return add(df, labels)

    def measured(*given):
        found = differences(*given)
        handed.append((found.count(), found.agg(F.sum(F.size("elems"))).first()[0] or 0))
        return found

    monkeypatch.setattr(ngram_join, "_labelled", counted)
    monkeypatch.setattr(ngram_join, "differences", measured)
    monkeypatch.setattr(ngram_join, "LEFT_PER_ENTRY", 2)
    df = spark.createDataFrame(made, "doc_id long, text string").repartition(4)
    same(ngram_join.jaccard_join(df, 4, 85).select("doc_id", "n_shingles", "component_id"), brute.jaccard_components(made))
    assert handed and handed[0][1] > 2 * handed[0][0]
    assert all(sets in labelled for sets, _ in handed) and not any(elems in labelled for _, elems in handed), (labelled, handed)


def test_jaccard_join_joins_sketches_to_sets(spark, monkeypatch):
    """Sketches join the long columns once and then each set of a hub, not the n-grams of its difference."""
    made, joined, handed = near_copies(4, 120, 150), [], []
    join, differences = ngram_join.common.join_small, ngram_join.differences

    def counted(left, small, on, how):
        out = join(left, small, on, how)
        if "short" in small.columns:
            joined.append(out.count())
        return out

    def measured(*given):
        found = differences(*given)
        handed.append(found.count())
        return found

    monkeypatch.setattr(ngram_join.common, "join_small", counted)
    monkeypatch.setattr(ngram_join, "differences", measured)
    monkeypatch.setattr(ngram_join, "LEFT_PER_ENTRY", 2)
    df = spark.createDataFrame(made, "doc_id long, text string").repartition(4)
    same(ngram_join.jaccard_join(df, 4, 85).select("doc_id", "n_shingles", "component_id"), brute.jaccard_components(made))
    assert handed and joined[1:] == handed, (joined, handed)


def test_columns_of_one_family_share_a_hub(spark):
    """Columns whose middles are different members take the one that most of them propose, if they hold it."""
    short = {1: 0, 2: 1, 3: 6, 4: 3, 5: 8, 6: 0, 7: 0}
    columns = {100: [1, 2, 3], 101: [1, 2, 4], 102: [1, 2, 5], 103: [6, 7]}  # middles: 1, 2, 1, either
    lists = spark.createDataFrame([(g, c, 10 + c, [short[c], 0, 0, 0]) for g, m in columns.items() for c in m], "gram long, class long, size int, short array<long>")
    near = {tuple(r) for r in ngram_join._hubs(lists).collect()}
    assert near - {(6, 7, 17), (7, 6, 16)} == {(1, 2, 12), (1, 3, 12), (1, 4, 12), (1, 5, 12)} and len(near) == 5


def test_pii_spans(docs, nothing, rows):
    found = pii.digest(pii.spans(docs)).collect()
    by_text = {r["base"] for r in found}
    expected = {",".join(f"{k}:{a}:{b}" for k, a, b in brute.base_spans(t)) for _, t in rows}
    assert by_text == expected - {""}
    assert pii.spans(nothing).isEmpty()


def test_pii_patterns_on_hostile_texts(spark):
    texts = ["a" * 20_000 + "@" + "b." * 5_000 + "c", "1" * 20_000, "1.2.3.4" * 500, "+1" + " " * 20_000, "a@b@c.d a@b.c%x@d.e %@-.-", "256.1.1.1 0255.00.1.1 1.2.3"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["base"] for r in pii.digest(pii.spans(df)).collect()}
    for i, t in enumerate(texts):
        assert got.get(i, "") == ",".join(f"{k}:{a}:{b}" for k, a, b in brute.base_spans(t))


def test_pii_terms_and_sanitising(spark):
    rows = [(i, f"{prose(i, 12)} Codename Bluebird{'' if i < 40 else 'x'} is john@corp.org {prose(i + 500, 6)}") for i in range(6)]
    rows += [(100 + i, f"common Bluebirds and words {prose(i + 50, 20)}") for i in range(60)] + [(200, "where Bluebird was"), (201, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = pii.spans(df)
    out = {r["doc_id"]: r["sanitised"] for r in pii.sanitise(df, found).collect()}
    assert "john@corp.org" not in "".join(out.values()) and "[EMAIL]" in out[0]
    assert "Bluebird " not in out[0] and "Bluebird" not in out[200]
    assert out[101] == rows[7][1] and out[201] == ""


def test_pii_terms_anywhere_in_the_document(spark):
    """Names on another line, of two or three letters, with digits, and far from the entity disclose it too."""
    rows = [(i, f"{prose(i * 31, 5)}\nDr Li Zyx\njane@corp.org\n{prose(i * 17 + 300, 60)}\nroom B7, case 83321") for i in range(5)]
    rows += [(100 + i, f"{prose(i + 50, 20)} at the corp room") for i in range(300)] + [(900 + i, "same copy Qux1 of joe@corp.org") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = pii.spans(df).where("kind = 'term' AND doc_id < 5").collect()
    assert {"Dr", "Li", "Zyx", "B7", "case", "83321"} <= {r["value"] for r in found}
    assert {"room", "corp", "org", "jane"}.isdisjoint(r["value"] for r in found)
    out = {r["doc_id"]: r["sanitised"] for r in pii.sanitise(df, pii.spans(df)).collect()}
    assert not any(w in out[0] for w in ("Li", "Zyx", "83321", "jane")) and "Qux1" in out[900] and out[100] == rows[5][1]


def test_language_id(spark, docs, nothing):
    sample = spark.read.parquet(f"{SF}/documents.parquet")
    scored = queries.op2_language_id(spark, SF).join(sample.select("doc_id", "lang"), "doc_id").where("held_out")
    right, n = scored.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert right / n > 0.97
    model = language_id.fit(sample, F.lit(True))
    said = {r["doc_id"]: r for r in language_id.predict(docs, model).where("doc_id IN (7, 8, 11, 24)").collect()}
    assert {(r["lang_pred"], r["score"], r["rejected"]) for r in said.values()} == {("und", 0.0, True)}
    assert language_id.predict(nothing, model).isEmpty()
    empty = language_id.fit(nothing, F.lit(True))
    assert {r["lang_pred"] for r in language_id.predict(docs, empty).collect()} == {"und"}
    noise = spark.createDataFrame([(1, "zxqj" * 60), (2, "漢字仮名交じり文" * 30)], "doc_id long, text string")
    assert language_id.known(noise, model).count() < 2


def test_language_id_rejects_long_noise_and_keeps_clean_texts(spark):
    import random
    import string

    sample = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = language_id.fit(sample, ~held_out)
    rng = random.Random(5)
    kinds = [string.ascii_lowercase, *("".join(chr(a + i) for i in range(n)) for a, n in ((0x430, 32), (0x3B1, 24), (0x3042, 80), (0x4E00, 3000), (0x905, 50)))]
    for letters in kinds:
        for n in (300, 1000):
            for _ in range(5):
                assert model.predict(" ".join("".join(rng.choices(letters, k=rng.randint(2, 9))) for _ in range(n)))[2], (letters[0], n)
    texts = [r["text"] for r in sample.where(held_out).select("text").collect()]
    clean = [t for t in texts if any(c.isalpha() for c in t) and len(set(t.lower().split())) >= 0.35 * len(t.split())]
    assert len(clean) > 0.9 * len(texts)
    assert [t[:80] for t in clean if model.predict(t)[2]] == []


def test_language_id_floor_is_that_of_the_length():
    import numpy as np

    near, size = np.array([0.05] * 30 + [0.8] * 40 + [0.1]), np.array([2] * 30 + [12] * 40 + [12])
    floor = language_id.floors(near, size)
    assert floor[12] == floor[19] == 0.4 and floor[: language_id.SHORT].max() == 0


def test_quality(spark, docs, nothing):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scored = queries.op9_quality_crf(spark, SF).join(labels, "doc_id").where("held_out")
    right, n = scored.agg(F.sum((F.col("quality") == F.col("predicted")).cast("int")), F.count("*")).first()
    assert right / n > 0.95
    assert quality_crf.fit(nothing.withColumn("label", F.lit(1))) is None
    assert {r["score"] for r in quality_crf.score(docs, None).collect()} == {0.5}


def test_marginals_equal_enumeration():
    import itertools

    import numpy as np

    rng = np.random.default_rng(3)
    lines, move = np.array([1, 4, 3]), rng.normal(size=(2, 2))
    score = rng.normal(size=8)
    good, pairs = quality_crf.marginals(score, lines, move)
    begin, expected, expected_pairs = 0, [], np.zeros((2, 2))
    for n in lines:
        total, each, two = 0.0, np.zeros(n), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(score[begin + i] * y[i] for i in range(n)) + sum(move[a, b] for a, b in zip(y, y[1:])))
            total += w
            each += w * np.array(y)
            for a, b in zip(y, y[1:]):
                two[a, b] += w
        expected += list(each / total)
        expected_pairs += two / total
        begin += n
    assert np.allclose(good, expected) and np.allclose(pairs, expected_pairs)


def test_fingerprints(spark, docs, nothing, rows):
    for shuffles in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)
        out = fingerprints.compare_edited(docs).select("doc_id", "n_chars", F.sha2("edited", 256), "near_edited").collect()
        order = sorted(((d is None, d or 0, t or "") for d, t in rows), key=lambda r: r[:2])
        got = {(r[0], r[2]) for r in out}
        assert len(out) == len(rows)
        unique = [r for r in order if sum(x[:2] == r[:2] for x in order) == 1]
        for i, r in enumerate(order):
            after = order[(i + 1) % len(order)]
            if r in unique and after in unique:
                cut = len(r[2]) // 4
                assert (None if r[0] else r[1], brute.sha(r[2][: len(r[2]) - cut] + after[2][:cut])) in got
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert fingerprints.compare_edited(nothing).isEmpty()
    one = fingerprints.compare_edited(docs.where("doc_id = 9")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    made = {}
    for r in fingerprints.fingerprints(docs).join(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t")), "doc_id").collect():
        assert made.setdefault(r["t"], r["fingerprint"]) == r["fingerprint"]


def test_fingerprint_likeness():
    a, b = prose(70, 500), prose(71, 500)
    s = fingerprints.sketch
    cut = len(a) // 4
    assert fingerprints.likeness(s(a), s(a)) == 1.0
    assert 0.4 < fingerprints.likeness(s(a), s(a[:-cut] + b[:cut])) < 0.8
    assert fingerprints.likeness(s(a), s(b)) < 0.05
    # the same anchors in another order do not count as alike as the same text
    words = a.split()
    assert fingerprints.likeness(s(a), s(" ".join(words[250:] + words[:250]))) < 0.7


def test_syncmers_are_context_free():
    a = prose(80, 60)
    anchors = lambda t: set(fingerprints.sketch(t, size=10**6)[0].tolist())
    assert anchors(a) <= anchors("before it " + a + " after it")


@pytest.fixture(scope="module")
def items(spark):
    made = [(i, prose(900 + i, 30) + ". " + prose(950 + i, 6) + ".") for i in range(12)] + [(50, None), (51, ""), (52, prose(900, 30) + ". " + prose(950, 6) + ".")]
    return spark.createDataFrame(made, "item_id long, text string")


def test_decontamination(spark, docs, nothing, items):
    held = {r["item_id"]: r["text"] for r in items.collect()}
    words = held[3].split()
    paraphrase = " ".join(w for i, w in enumerate(words) if i % 6 != 2)
    planted = [(1, prose(20, 200) + " " + held[1].upper() + " " + prose(21, 90)), (2, paraphrase + "\n" + prose(22, 100)), (3, held[0]), (4, prose(23, 300)), (5, None), (6, "")]
    df = spark.createDataFrame(planted, "doc_id long, text string").union(docs.select("doc_id", "text"))
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(df, items).collect()}
    assert got == {(1, 1), (2, 3), (3, 0), (3, 52)}
    assert decontaminate.contaminated(nothing, items).isEmpty()
    assert decontaminate.contaminated(df, items.where("false")).isEmpty()


def test_decontamination_finds_every_verbatim_item(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    exact = {(d["doc_id"], b["item_id"]) for d in docs for b in bench if b["text"] in d["text"]}
    got = {(r["doc_id"], r["item_id"]) for r in queries.op10_benchmark_decontamination(spark, SF).collect()}
    assert exact <= got and len(got - exact) <= 0.05 * len(exact) + 1


def test_decontamination_finds_verbatim_copies_of_common_and_rare_items(spark):
    """500 passages, each in some document; ten of them in a third of all, partly beside rare ones."""
    made = [(i, " ".join(f"p{i}w{k}" if k % 3 else f"shared{(i * 7 + k) % 90}" for k in range(38))) for i in range(500)]
    made += [(900, " ".join(f"long{k}" for k in range(48 * 300)))]
    texts, expected = [], set()
    for d in range(300):
        held = [i for i in range(500) if i % 300 == d]
        order = [x for pair in zip(range(10), held * 10) for x in pair] if d % 3 == 0 else held
        texts.append((d, prose(d, d % 50) + " " + " ".join(made[i][1] for i in order) + " " + prose(d + 1000, 30)))
        expected |= {(d, i) for i in order}
    texts.append((900, made[500][1]))
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    found = decontaminate.contaminated(df, spark.createDataFrame(made, "item_id long, text string")).collect()
    got = {(r["doc_id"], r["item_id"]) for r in found}
    assert expected | {(900, 900)} == got and len(found) == len(got)


def test_common_words():
    def plain(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    for seed in range(30):
        a = [w.encode()[:2] for w in prose(seed, 30).split()]
        b = [w.encode()[:2] for w in prose(seed + 99, 45).split()]
        assert decontaminate.common_words(a, b) == plain(a, b)


def test_pipeline(spark):
    """Every stage against a plain version of it over what the stage before kept."""
    from tokenizers import Tokenizer

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, "/root/testdata/sf0.001").cache()
        rows, was = [tuple(r) for r in docs.collect()], [(r["doc_id"], r["text"]) for r in before.select("doc_id", "text").collect()]
        kept[name] = len(rows)
        if name != "bpe_encode_decode":
            assert docs.columns == columns
            now = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
        if name == "line_dedup":
            assert {d: brute.sha(t) for d, t in now.items()} == {r[0]: r[3] for r in brute.line_dedup(was)}
        elif name == "ngram_jaccard_join":
            assert set(now) == {d for d, size, c in brute.jaccard_components(was, 5, 80) if d == c}
        elif name == "benchmark_decontamination":
            bench = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
            assert set(now).isdisjoint({d for d, t in was if any(b in t for b in bench)})
            assert len(now) >= len(was) - sum(any(b[:40].lower() in t.lower() for b in bench) for _, t in was) - 1
        elif name == "bpe_encode_decode":
            path = queries.vocabulary("word_bpe_49k.json")
            t = Tokenizer.from_file(path)
            assert sorted((r[0], r[2]) for r in rows) == sorted((d, t.encode(x, add_special_tokens=False).ids) for d, x in was)
    assert kept["language_id"] >= 0.97 * 200
    assert sorted(map(tuple, corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()), key=key) == sorted(rows, key=key)


def test_pipeline_stages_take_awkward_rows(spark, rows):
    docs = spark.createDataFrame([(d, t, None, "s", 0) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for df in (docs, docs.where("false")):
        for _, stage in corpus_pipeline.STAGES[1:]:
            out = stage(spark, df, "/root/testdata/sf0.001")
            assert out.count() <= df.count()
