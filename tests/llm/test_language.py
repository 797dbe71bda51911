from pathlib import Path

import numpy as np
import pytest
from cases import documents, edge_documents, empty_documents, prose
from pyspark.sql import functions as F

from pairrank.llm import language
from pairrank.llm.queries import op4_language_id

SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_held_out_accuracy(spark):
    known = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = op4_language_id(spark, SF).join(known, "doc_id").where("held_out")
    right, of = got.select(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert of > 200 and right / of >= 0.99
    assert got.where("score < 0 OR score > 1").count() == 0


def samples(spark, n=40):
    words = {"en": "the and of to in is that it was for", "de": "der die und das nicht ein mit von sich auf",
             "fr": "le la les et que une des est pour dans", "es": "el los las que una por con para como del", "xx": "ka mo tu ri pe so na li wu ze"}
    draw = np.random.default_rng(0)
    rows = [(i, " ".join(draw.choice(words[w].split(), 30)), w) for i, w in enumerate(sorted(words) * n)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), words


def test_hierarchy(spark):
    docs, words = samples(spark)
    model = language.train(docs)
    assert model.members == {"germanic": ["de", "en"], "romance": ["es", "fr"], "xx": ["xx"]}
    assert set(model.pairs) == {("de", "en"), ("es", "fr")}
    for lang, text in words.items():
        found, score = model.predict(f"{text} {text}")
        assert found == lang and 0.5 < score <= 1


def test_the_sample_is_bounded(spark):
    docs, _ = samples(spark)
    few, all_rows = language.train(docs, per_language=10), language.train(docs, per_language=1000)
    assert few.predict("the and of the")[0] == all_rows.predict("the and of the")[0] == "en"


def test_only_the_text_decides(spark):
    docs, _ = samples(spark, 10)
    model = language.train(docs)
    a = language.identify(docs, model).select("doc_id", "lang_pred", "score")
    b = language.identify(docs.withColumn("lang", F.lit("xx")), model).select("doc_id", "lang_pred", "score")
    assert sorted(a.collect()) == sorted(b.collect())


def test_undetermined(spark):
    docs, _ = samples(spark, 5)
    model = language.train(docs)
    texts = [None, "", " \n", "123 !!", "\U0001f600", "é", prose(1, 100_000)]
    got = language.identify(documents(spark, texts), model).orderBy("doc_id").collect()
    assert [r.lang_pred == "und" for r in got] == [True] * 5 + [False] * 2
    assert [r.score for r in got[:5]] == [0.0] * 5


def test_edges(spark):
    docs = edge_documents(spark)
    model = language.train(docs)
    got = language.identify(docs, model)
    assert got.count() == docs.count() and set(docs.columns) | {"lang_pred", "score"} == set(got.columns)
    assert got.where("(text IS NULL OR text = '') AND lang_pred <> 'und'").count() == 0
    untaught = language.train(empty_documents(spark))
    assert {r.lang_pred for r in language.identify(docs, untaught).collect()} == {"und"}
    assert language.identify(empty_documents(spark), model).count() == 0
