"""Language ID and toxicity: held-out accuracy, edge rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evtab.llm import language, queries, toxicity

SF = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = queries.op1_language(spark, SF).join(truth, "doc_id").toPandas()
    assert len(got) == 1000 and got.score.between(0, 1).all()
    out = got[got.held_out]
    assert len(out) > 200 and (out.lang == out.lang_pred).mean() > 0.97


def test_language_edges(spark):
    rows = [(1, "the cat and the dog sat on the mat with the hat and the bat", "en"),
            (2, "le chat et le chien sont sur le tapis avec le chapeau", "fr"), (3, None, "en"), (4, "so", None),
            (5, "1234 -- !!", "fr"), (6, "", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("rejected", F.lit("old"))
    dictionaries = language.learn(docs)
    assert set(dictionaries) == {"en", "fr"}
    query = spark.createDataFrame([(10, None), (11, ""), (12, "42 ?!"), (13, "the dog and the cat sat on the mat"),
                                   (14, "le chien et le chat sont sur le tapis"), (14, "z"), (None, "the cat " * 40000)],
                                  "doc_id long, text string").withColumn("score", F.lit("old"))
    got = language.predict(query, dictionaries)
    assert got.columns == ["doc_id", "text", "lang_pred", "score", "rejected"]
    by = {(r.doc_id, (r.text or "")[:5]): r for r in got.collect()}
    for k in ((10, ""), (11, ""), (12, "42 ?!")):
        assert (by[k].lang_pred, by[k].score, by[k].rejected) == ("und", 0.0, True)
    assert by[13, "the d"].lang_pred == "en" and by[14, "le ch"].lang_pred == "fr"
    assert by[None, "the c"].lang_pred == "en" and by[14, "z"].lang_pred in ("en", "fr") and by[14, "z"].rejected
    assert language.learn(docs.limit(0)) == {}
    assert {r.lang_pred for r in language.predict(query, {}).collect()} == {"und"}
    assert language.predict(query.limit(0), dictionaries).count() == 0


def test_more_languages_than_the_bound(spark, monkeypatch):
    monkeypatch.setattr(language, "MAX_LANGUAGES", 1)
    docs = spark.createDataFrame([(1, "aa bb", "x"), (2, "cc dd", "y"), (3, "ee ff", "y")],
                                 "doc_id long, text string, lang string")
    assert set(language.learn(docs)) == {"y"}


def words(rng, n):
    return " ".join(rng.choice(["ka", "lo", "mi", "nu", "pe", "ra", "si"], n))


def test_toxicity_learns_words_and_pairs(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(600):
        bad = i % 4 == 0
        text = words(rng, 30)
        if bad:
            text += " gruk " if i % 8 else " zed zed "
        elif i % 3 == 0:
            text += " zed "
        rows.append((i, text + words(rng, 30), int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    weights = toxicity.train(toxicity.sample(df.where("doc_id < 400"), df.select("doc_id", "toxic")), epochs=8)
    got = toxicity.score(df.where("doc_id >= 400").withColumn("predicted", F.lit("old")), weights).toPandas()
    assert (got.predicted == got.toxic).mean() > 0.97 and got.score.between(0, 1).all()
    assert len(weights) < 3000


def test_toxicity_held_out(spark):
    marks = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "toxic")
    got = queries.op4_toxicity(spark, "/root/testdata/sf0.1").join(marks, "doc_id").toPandas()
    out = got[got.held_out]
    hit = (out.predicted == 1) & (out.toxic == 1)
    assert (out.predicted == out.toxic).mean() > 0.95
    assert hit.sum() >= 0.9 * (out.predicted == 1).sum()


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "gruk"), (3, "gruk"), (None, "gruk")],
                                 "doc_id long, text string")
    got = toxicity.score(docs, {0: -1.0, int(toxicity.features(toxicity.word_hashes("gruk", toxicity.WordHash()))[0]): 3.0})
    by = [(r.doc_id, r.text, round(r.score, 3), r.predicted) for r in got.collect()]
    assert by == [(1, None, 0.269, 0), (2, "", 0.269, 0), (3, "gruk", 0.881, 1), (3, "gruk", 0.881, 1),
                  (None, "gruk", 0.881, 1)]
    assert {(r.score, r.predicted) for r in toxicity.score(docs, {}).collect()} == {(0.0, 0)}
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 1), (3, 7)], "doc_id long, toxic int")
    assert toxicity.train(toxicity.sample(docs, labels)) == {}
    assert toxicity.train(toxicity.sample(docs.limit(0), labels.limit(0))) == {}


def test_sample_is_bounded_and_stable(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit(0).alias("toxic"))
    a = {r.k for r in toxicity.sample(df, df, rows=300).collect()}
    b = {r.k for r in toxicity.sample(df.repartition(7), df.repartition(3), rows=300).collect()}
    assert a == b and 200 < len(a) < 400


@pytest.mark.parametrize("key,folds,fold", [("17", 5, 0), ("100", 4, 2)])
def test_fold(spark, key, folds, fold):
    import zlib
    got = spark.range(1).select(language.held_out(F.lit(int(key)), folds, fold).alias("x")).first().x
    assert got == (zlib.crc32(key.encode()) % folds == fold)
