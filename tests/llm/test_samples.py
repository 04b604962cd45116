"""Fitting samples that consist mostly of copies."""

import re

from pyspark.sql import functions as F

from freshet.llm import language_id, quality_crf
from tests.llm.conftest import prose


def test_a_language_of_copies_is_learnt(spark):
    """16,000 rows of four texts beside 2,000 different ones: the language stays in the model."""
    copies = [prose(k, 60).translate(str.maketrans("aeiou", "öäüéß")) for k in range(4)]
    rows = spark.range(16_000).select(F.lit("de").alias("lang"), F.element_at(F.array(*map(F.lit, copies)), (F.col("id") % 4 + 1).cast("int")).alias("text"))
    other = spark.createDataFrame([("en", prose(100 + i, 40)) for i in range(2_000)], "lang string, text string")
    model = language_id.fit(rows.union(other).repartition(8), F.lit(True))
    assert list(model.names) == ["de", "en"]
    assert model.predict(copies[1])[0] == "de" and model.predict(prose(7, 50))[0] == "en"


def test_a_label_of_copies_is_learnt(spark):
    """20,000 rows of three bad texts beside 1,500 different good ones."""
    bad = ["zz zz zz\n%%%% 111 222\nclick click", "$$$ $$$\n!!! 9 9 9 9", "#### buy\n0 0 0 0 0 ####"]
    rows = spark.range(20_000).select(F.lit(0).alias("label"), F.element_at(F.array(*map(F.lit, bad)), (F.col("id") % 3 + 1).cast("int")).alias("text"))
    good = spark.createDataFrame([(1, prose(100 + i, 30) + ".\n" + prose(5_000 + i, 30) + ".") for i in range(1_500)], "label int, text string")
    field = quality_crf.fit(rows.union(good).repartition(8))
    assert field is not None
    tried = spark.createDataFrame([(0, bad[0]), (1, prose(9_999, 30) + ".\n" + prose(8_888, 30) + ".")], "doc_id long, text string")
    score = {r["doc_id"]: r["score"] for r in quality_crf.score(tried, field).collect()}
    assert score[0] < 0.5 < score[1]


def test_texts_stay_where_labels_are_met(spark, monkeypatch):
    """A table of labels meets ids and hashes only, and gives the field that labelled rows give."""
    texts = [(i, prose(i, 30) + ".\n" + prose(5_000 + i, 30) + "." if i % 2 else f"$$$ {i} $$$\n!!! 9 9 9 9") for i in range(400)]
    docs = spark.createDataFrame([*texts, (None, "loose"), (900, None), (901, texts[1][1])], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(900, 0), (5, None), (7, 3), (None, 1)], "doc_id long, label int")
    plans, store = {}, quality_crf.store
    explain = spark.sparkContext._jvm.PythonSQLUtils.explainString

    def kept(df, name):
        plans[name] = explain(df._jdf.queryExecution(), "formatted")
        return store(df, name)

    monkeypatch.setattr(quality_crf, "store", kept)
    own = quality_crf.fit(docs, labels=labels)
    moved = re.findall(r"\(\d+\) \w*Exchange\nInput.*", plans["labelled"])
    assert moved and not any(re.search(r"\btext#", columns) for columns in moved), moved
    joined = quality_crf.fit(docs.join(labels, "doc_id"))
    assert (own.weights == joined.weights).all() and (own.curve == joined.curve).all()
