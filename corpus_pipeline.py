"""From raw documents to token ids: language ID, line dedup, near duplicates, decontamination, BPE.

Every stage takes what its predecessor kept, written and read again. All but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm import bpe, common, decontaminate, language_id, line_dedup, ngram_join
from freshet.llm.queries import vocabulary
from freshet.session import store


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; rejected ones go."""
    return language_id.known(docs, language_id.fit(docs, F.lit(True)))


def lines_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that a document with a smaller id holds; a document may end up empty."""
    kept = line_dedup.drop_lines(docs, line_dedup.keep_bitmaps(docs))
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of at least 0.8 of their five-word shingles."""
    return ngram_join.one_per_component(docs, store(ngram_join.jaccard_join(docs, 5, 80), "joined"))


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    found = decontaminate.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return common.rows_in(docs, store(found.select("doc_id", "row").distinct(), "contaminated"), "left_anti")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, the number of tokens, their ids and the decoded text."""
    coded = bpe.encode_decode(docs, vocabulary("word_bpe_49k.json"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("language_id", known_language),
    ("line_dedup", lines_once),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", without_benchmarks),
    ("bpe_encode_decode", tokens),
]

#: No SQL expresses language ID and token merging; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
