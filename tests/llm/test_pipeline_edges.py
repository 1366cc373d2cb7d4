"""Every pipeline stage over rows that are null, empty, repeated, long or oddly named, and over empty tables."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from evtab.llm import language, neardup
from evtab.llm.util import landed

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def docs(spark):
    base = spark.read.parquet(f"{SF}/documents.parquet")
    text = base.where("lang = 'en'").orderBy(F.length("text").desc()).first()["text"]
    odd = [(None, text, "en", "src1"), (None, text, None, None), (9001, None, "en", "src1"), (9002, "", "de", "src2"),
           (None, None, None, None), (9003, "12 + 34 = 46", "en", "src1"), (9004, (text + " ") * 40, "en", "src3"),
           (9005, "²½ ① Ⅷ", None, "src1"), (9006, text, "en", "src0"), (9006, text, "en", "src0")]
    rows = spark.createDataFrame([(*r, len(r[1] or "")) for r in odd],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    every = base.select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars"))
    every = every.unionByName(rows)
    # columns named like results of the operators
    return landed(every.select("*", F.lit("s").alias("score"), F.lit(7).alias("predicted"), F.lit("r").alias("rejected"),
                               F.lit("p").alias("lang_pred"), F.lit(3).alias("component_id"), F.lit(True).alias("kept"),
                               F.lit("w").alias("words"), F.lit("b").alias("block")), "edge-docs")


@pytest.mark.parametrize("name", ["toxicity", "language", "neardup", "mixing"])
def test_stage_keeps_columns_and_takes_odd_rows(spark, docs, name):
    out = landed(STAGES[name](spark, docs, SF), "edge-out")
    assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
    assert {tuple(r) for r in out.select("score", "predicted", "rejected", "words").collect()} == {("s", 7, "r", "w")}
    ids = [r.doc_id for r in out.select("doc_id").collect()]
    if name == "toxicity":
        assert {9001, 9002, None} <= set(ids) and ids.count(9006) == 2
    elif name == "language":
        assert not {9001, 9002, 9003, 9005} & set(ids) and {9004, 9006, None} <= set(ids)
        assert out.where("doc_id IS NULL AND lang IS NULL").count() == 0
    elif name == "neardup":
        left = [r.text for r in out.collect()]
        assert all(left.count(t) == 1 for t in left if t is not None)
        assert ids.count(None) == 1 and ids.count(9006) == 0       # null texts stay, copies and repeated rows go
    else:
        assert not {9001, 9002} & set(ids)
    empty = STAGES[name](spark, docs.limit(0), SF)
    assert empty.columns == docs.columns and empty.count() == 0


def test_tokens_and_the_whole_pipeline_over_empty_tables(spark, docs, tmpdir_path):
    out = STAGES["tokens"](spark, docs, SF)
    assert out.count() == docs.count() and out.where("doc_id IS NULL").count() == 3
    for name in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(os.path.join(tmpdir_path, f"{name}.parquet"))
    assert corpus_pipeline.run(spark, tmpdir_path).count() == 0
    spark.read.parquet(f"{SF}/documents.parquet").write.mode("overwrite").parquet(
        os.path.join(tmpdir_path, "documents.parquet"))
    assert corpus_pipeline.run(spark, tmpdir_path).count() > 0     # nothing is toxic without labels


def test_numbers_are_no_letters():
    assert language.letters("²½ ①② Ⅷ ٣ 42 _") == b"" and language.letters("x² Ⅷ y") == b"x y"
    assert language.Encoder({"en": b"the cat"}).best("²½")[0] == "und"


def test_one_id_with_two_texts_links_with_the_partners_of_each(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " y"), (4, "other words only here and now")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for part in (1, 5):
        got = {(r.doc_id, r.component_id) for r in neardup.near_duplicates(df.repartition(part)).collect()}
        assert got == {(1, 1), (2, 1), (3, 1), (4, 4)}
