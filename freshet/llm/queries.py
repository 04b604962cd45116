"""The registered queries of the operators and their SQL."""

from __future__ import annotations

import importlib
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm import bpe, common, decontaminate, fingerprints, language_id, line_dedup, merkle, ngram_join, pii, quality_crf, substring_dedup, token_codes, token_counts, whitening
from freshet.session import store


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file on the driver; the operators broadcast its content."""
    return importlib.import_module("public_tokenizers").path(name)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _remainder(divisor: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % divisor


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data and of terms that disclose it in every document."""
    docs = _documents(spark, sf_dir)
    found = store(pii.digest(pii.spans(docs)), "digest")
    df = common.with_row(common.documents(docs)).drop("text")
    joined = common.join_small(df, found, ["doc_id", "row"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return joined.select(
        "doc_id", *[zero(f"n_{k}") for k in pii.KINDS],
        F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"), zero("n_term"),
    )


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learnt from four fifths of them."""
    docs = _documents(spark, sf_dir)
    model = language_id.fit(docs, _remainder(5) != 0)
    return language_id.predict(docs, model).select("doc_id", (_remainder(5) == 0).alias("held_out"), "lang_pred", "score")


def op3_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document under the word-level file, as digests."""
    coded = bpe.encode_decode(_documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document under the byte-level file."""
    return token_counts.token_counts(_documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents linked by a Jaccard similarity of at least 0.85 of their 4-word shingles."""
    return ngram_join.jaccard_join(_documents(spark, sf_dir), 4, 85).select("doc_id", "n_shingles", "component_id")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document before and after line dedup."""
    docs = _documents(spark, sf_dir)
    kept = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike they are."""
    compared = fingerprints.compare_edited(_documents(spark, sf_dir))
    return compared.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document before and after removal of repeated passages."""
    docs = _documents(spark, sf_dir)
    kept = substring_dedup.remove_repeats(docs, substring_dedup.repeated_windows(docs))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learnt from three quarters of the labels."""
    docs = _documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(_remainder(4) != 2).select("doc_id", F.col("quality").alias("label"))
    field = quality_crf.fit(docs, labels=labels)
    scored = quality_crf.score(docs, field)
    return scored.select("doc_id", (_remainder(4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents, verbatim or paraphrased."""
    found = decontaminate.contaminated(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.drop("row")


def op11_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place and ids, read back from the written code segments."""
    written = token_codes.write(_documents(spark, sf_dir), vocabulary("word_bpe_49k.json"), end=1)
    return token_codes.read(written, lambda ids: zlib.crc32(ids.astype("<u4").tobytes()), "ids_crc32", ("bigint", pa.int64()))


MANIFEST_FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of every document, and what a claimed leaf folds to."""
    lowered = F.translate("text", merkle.UPPER, merkle.LOWER)
    rows = merkle.leaves(_documents(spark, sf_dir), MANIFEST_FIELDS, _remainder(5) == 0, lowered)
    proved = merkle.manifest(rows)
    return proved.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", "verified")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable embedding, whitened on the first 16 components."""
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 16)


QUERIES = {q.__name__: q for q in (
    op1_pii, op2_language_id, op3_bpe_encode_decode, op4_token_counts, op5_ngram_jaccard_join, op6_line_dedup, op7_fingerprints, op8_substring_dedup, op9_quality_crf,
    op10_benchmark_decontamination, op11_token_codes, op12_merkle_manifest, op13_whitening,
)}

def _manifest_sql(levels: int = 6) -> str:
    """SQL of the manifest for groups of up to 16 ** ``levels`` rows, and as many groups."""
    mark = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END"
    fields = [f"d.{c}" for c in MANIFEST_FIELDS]
    lowered = f"translate(d.text, '{merkle.UPPER}', '{merkle.LOWER}')"
    plain, other = (f"sha256({' || '.join(map(mark, x))})" for x in (fields, [*fields[:-1], lowered]))
    # CRC-32 of the decimal id, bit by bit
    bits = "list_reduce(list_prepend(xor(c, b), list_transform(range(8), lambda i: CAST(0 AS BIGINT))), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))"
    held = (
        f"mod(xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(d.doc_id AS VARCHAR), ''), "
        f"lambda ch: CAST(ascii(ch) AS BIGINT))), lambda c, b: {bits})), 5) = 0"
    )
    parts = [
        f"""rows AS (SELECT d.doc_id, d.source AS g, {plain} AS leaf, CASE WHEN {held} THEN {other} ELSE {plain} END AS claimed FROM documents d),
a0 AS (SELECT g, leaf AS node, row_number() OVER (PARTITION BY g ORDER BY doc_id, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n, doc_id, claimed FROM rows)"""
    ]

    def tree(name: str, key: str) -> None:
        for k in range(levels):
            parts.append(
                f"""{name}{k + 1} AS (SELECT {key}, CASE WHEN n > 1 THEN sha256(string_agg(node, '' ORDER BY pos)) ELSE max(node) END AS node,
    pos // 16 AS pos, CAST(ceil(n / 16.0) AS BIGINT) AS n FROM {name}{k} GROUP BY {key}, pos // 16, n),
{name}s{k} AS (SELECT x.{key}, x.pos, coalesce(string_agg(y.node, '' ORDER BY y.pos) FILTER (WHERE y.pos < x.pos), '') AS l,
    coalesce(string_agg(y.node, '' ORDER BY y.pos) FILTER (WHERE y.pos > x.pos), '') AS r, x.n
    FROM {name}{k} x JOIN {name}{k} y ON x.{key} IS NOT DISTINCT FROM y.{key} AND x.pos // 16 = y.pos // 16 GROUP BY x.{key}, x.pos, x.n)"""
            )

    tree("a", "g")
    parts.append(f"b0 AS (SELECT 1 AS u, g, node, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM a{levels})")
    tree("b", "u")
    parts.append(f"f0 AS (SELECT a.doc_id, a.node AS leaf, a.g, a.pos, b.node AS subroot, b.pos AS gpos, t.node AS root, a.claimed AS h, '' AS proof FROM a0 a JOIN b0 b ON a.g IS NOT DISTINCT FROM b.g, b{levels} t)")
    step = 0
    for name, pos, key in (("a", "pos", "s.g IS NOT DISTINCT FROM f.g AND "), ("b", "gpos", "")):
        for k in range(levels):
            parts.append(
                f"f{step + 1} AS (SELECT f.* REPLACE (CASE WHEN s.n > 1 THEN sha256(s.l || f.h || s.r) ELSE f.h END AS h, f.proof || s.l || s.r AS proof) "
                f"FROM f{step} f JOIN {name}s{k} s ON {key}s.pos = f.{pos} // {16**k})"
            )
            step += 1
    return f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, h AS folded_root, h = root AS verified FROM f{step}"


SQL: dict[str, str] = {
    "op12_merkle_manifest": _manifest_sql(),
    "op5_ngram_jaccard_join": r"""
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
    FROM documents),
shingles AS (
    SELECT DISTINCT doc_id, array_to_string(w[s : s + 3], ' ') AS shingle
    FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 3, 1))) AS s FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
products AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o
    FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
    SELECT a, b FROM products JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
    WHERE 100 * o >= 85 * (x.n + y.n - o)),
reach AS (
    SELECT doc_id AS a, doc_id AS b FROM documents
    UNION
    SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(r.b) AS component_id
FROM documents d JOIN reach r ON r.a = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id GROUP BY d.doc_id
""",
    "op6_line_dedup": r"""
WITH lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
    FROM documents),
keyed AS (
    SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM lines),
firsts AS (SELECT key, min(doc_id) AS first_doc FROM keyed WHERE length(key) >= 10 GROUP BY key),
marked AS (
    SELECT k.doc_id, k.line, k.pos, coalesce(f.first_doc < k.doc_id, false) AS dropped
    FROM keyed k LEFT JOIN firsts f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
    "op8_substring_dedup": r"""
WITH words AS (
    SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
    FROM documents),
windows AS (
    SELECT doc_id, s, array_to_string(w[s : s + 34], ' ') AS body
    FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 34)) AS s FROM words WHERE len(w) >= 35)),
repeats AS (SELECT doc_id, s FROM windows WHERE body IN (SELECT body FROM windows GROUP BY body HAVING count(*) > 1)),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(s, s + 34)) AS pos FROM repeats),
all_words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM words),
kept AS (
    SELECT a.doc_id, count(*) AS n_words, count(g.pos) AS n_removed,
           string_agg(a.word, ' ' ORDER BY a.pos) FILTER (WHERE g.pos IS NULL) AS kept
    FROM all_words a LEFT JOIN gone g ON a.doc_id = g.doc_id AND a.pos = g.pos GROUP BY a.doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
""",
}
