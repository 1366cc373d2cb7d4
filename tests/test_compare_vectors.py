"""Prediction line-up (C19), word-vector vote and k-NN (C13-C15)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evtab.operators import compare, vectors


def test_model_matrix_missing_and_last_wins(spark):  # C19
    rows = [("m0", "d", "e1", 1, 0.9, 1, 0), ("m0", "d", "e2", 0, 0.6, 1, 1),
            ("m1", "d", "e1", 0, None, 1, 2), ("m1", "d", "e1", 1, None, 1, 3)]
    p = spark.createDataFrame(rows, "model string, docid string, eventid string, pred int, prob double, "
                                    "label int, row_pos int")
    m = {r.eventid: r for r in compare.model_matrix(p, ["m0", "m1"]).collect()}
    assert (m["e1"].m0, m["e1"].m0_conf, m["e1"].m0_is_correct) == (1, 0.9, 1)
    assert (m["e1"].m1, m["e1"].m1_is_correct) == (1, 1)       # the later row wins
    assert (m["e2"].m1, m["e2"].m1_conf, m["e2"].m1_is_correct) == (None, None, None)


def test_alignment_check(spark):
    a = spark.createDataFrame([("d", "e1"), ("d", "e2"), ("d", "e2")], "docid string, eventid string")
    b = spark.createDataFrame([("d", "e1"), ("d", "e3")], "docid string, eventid string")
    r = compare.alignment_check(a, b).first()
    assert (r.left_only, r.right_only, r.left_dup_keys, r.right_dup_keys, r.aligned) == (1, 1, 1, 0, False)
    assert compare.alignment_check(b, b).first().aligned


def test_review_sheets_and_eval(spark):
    df = spark.createDataFrame([(f"e{i}", "d", "fr", "test", "VERB" if i % 2 else "AUX", 1, 1.0)
                                for i in range(12)],
                               "eventid string, docid string, lang string, split string, pos string, "
                               "label int, label_confidence double")
    preds = spark.createDataFrame([("d", f"e{i}", i % 3 and 1 or 0, 0.7) for i in range(12)],
                                  "docid string, eventid string, pred int, prob double")
    allp, sample, blind = compare.review_sheets(df, preds, 5, 42, by=("lang", "split"))
    assert allp.count() == 12 and sample.count() == 5
    assert "pred" not in blind.columns and "label" not in allp.columns
    ann = sample.select("docid", "eventid", F.lit(1).alias("annotation"))
    ev = {r.subset: r for r in compare.review_eval(sample, ann).collect()}
    assert ev["all"].n == 5 and set(ev) <= {"all", "VERB"}


def test_verb_vote_rules(spark):  # C13
    rows = [("Go", 1, 0.9), ("go", 0, 0.8),            # count tie, conf 0.8 < 0.9 -> 1
            ("run", 1, 0.5), ("run", 0, 0.7),          # count tie, conf0 higher -> 0
            ("sit", 1, 0.6), ("sit", 0, 0.6),          # full tie -> 1
            ("eat", 0, 0.1), ("eat", 0, 0.1), ("eat", 1, 1.0)]  # majority 0
    df = spark.createDataFrame(rows, "verb string, label int, label_confidence double")
    got = {r.verb: r.label for r in vectors.verb_vote(df).collect()}
    assert got == {"go": 1, "run": 0, "sit": 1, "eat": 0}


def vec_table(spark, n, dim=6, seed=3):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dim)).astype("float32")
    return spark.createDataFrame([(f"w{i}", v[i].tolist()) for i in range(n)], "verb string, vector array<float>"), v


def brute_knn(q, r, qw, rw, k):
    qn = q / np.linalg.norm(q, axis=1, keepdims=True)
    rn = r / np.linalg.norm(r, axis=1, keepdims=True)
    s = qn.astype("float64") @ rn.astype("float64").T
    out = {}
    for i, w in enumerate(qw):
        order = sorted(range(len(rw)), key=lambda j: (-s[i, j], rw[j]))[:k]
        out[w] = [rw[j] for j in order]
    return out


def test_attach_predictions_never_multiplies_rows(spark):
    df = spark.createDataFrame([("d", "e1"), ("d", "e2")], "docid string, eventid string")
    p = spark.createDataFrame([("d", "e1", 1, 0.9), ("d", "e1", 0, 0.8)], "docid string, eventid string, pred int, prob double")
    with pytest.raises(Exception, match="two predictions"):
        compare.attach_predictions(df, p).collect()
    got = compare.attach_predictions(df, p, on_duplicate="first").collect()
    assert sorted((r.eventid, r.pred) for r in got) == [("e1", 0), ("e2", None)]


def test_knn_zero_vectors_and_repeated_words(spark):
    t = "verb string, vector array<float>"
    r = spark.createDataFrame([("a", [1.0, 0.0]), ("z", [0.0, 0.0]), ("b", [-1.0, 0.0])], t)
    q = spark.createDataFrame([("q", [2.0, 0.0]), ("n", [0.0, 0.0])], t)
    for k in (1, 2, 3):
        got = {}
        for row in vectors.knn_join(q, r, k).collect():
            got.setdefault(row.query, []).append((row["rank"], row.neighbor, row.similarity))
        assert sorted(got["q"]) == [(1, "a", 1.0), (2, "z", 0.0), (3, "b", -1.0)][:k]
        assert sorted(got["n"]) == [(1, "a", 0.0), (2, "b", 0.0), (3, "z", 0.0)][:k]
    twice = r.unionByName(spark.createDataFrame([("a", [0.0, 1.0])], t))
    with pytest.raises(Exception, match="two vectors"):
        vectors.knn_join(q, twice, 1).collect()


def test_knn_predict_looks_words_up_as_written(spark):
    """The lowered verb is looked up exactly: an upper-case entry of the vector table is another word."""
    train = spark.createDataFrame([("Go", 1, 1.0), ("stay", 0, 1.0)], "verb string, label int, label_confidence double")
    vecs = spark.createDataFrame([("Go", [0.0, 1.0]), ("go", [1.0, 0.0]), ("stay", [0.0, 1.0])],
                                 "verb string, vector array<float>")
    got = vectors.knn_predict(spark.createDataFrame([("GO",), ("stay",)], "verb string"), train, vecs, 1).collect()
    assert {r.verb: r.pred for r in got} == {"GO": 1, "stay": 0}


@pytest.mark.parametrize("block", [2048, 7])
def test_knn_join_exact(spark, block):
    df, v = vec_table(spark, 40)
    q = df.filter(F.col("verb").isin([f"w{i}" for i in range(0, 40, 4)]))
    r = df.filter(~F.col("verb").isin([f"w{i}" for i in range(0, 40, 4)]))
    nn = vectors.knn_join(q, r, 5, block_rows=block).collect()
    got = {}
    for row in sorted(nn, key=lambda x: (x.query, x.rank)):
        got.setdefault(row.query, []).append(row.neighbor)
    qi = list(range(0, 40, 4))
    ri = [i for i in range(40) if i % 4]
    ref = brute_knn(v[qi], v[ri], [f"w{i}" for i in qi], [f"w{i}" for i in ri], 5)
    assert got == ref


def test_knn_predict_half_even_and_missing(spark):  # C14, C15
    vecs = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.9, 0.1]), ("c", [0.0, 1.0]), ("q", [1.0, 0.05])],
                                 "verb string, vector array<float>")
    train = spark.createDataFrame([("a", 1, 1.0), ("b", 0, 1.0), ("c", 0, 1.0)],
                                  "verb string, label int, label_confidence double")
    test = spark.createDataFrame([("Q", 1)], "verb string, label int")
    p = vectors.knn_predict(test, train, vecs, k=2).first()
    assert p.pred == 0            # mean 0.5 rounds half to even
    missing = spark.createDataFrame([("zz", 1)], "verb string, label int")
    with pytest.raises(Exception, match="no vector"):
        vectors.knn_predict(missing, train, vecs, k=1).collect()
    rep = vectors.lookup_vectors(missing, vecs, missing="report").first()
    assert rep.found is False


def test_knn_holds_a_tile_at_a_time(spark, monkeypatch):
    """F16: a task gets a few blocks of either side, however many blocks meet; the results are those of one block."""
    from pyspark.sql import DataFrame
    monkeypatch.setattr(vectors, "TILE", 2)
    df, _ = vec_table(spark, 60)
    zero = spark.createDataFrame([("zz", [0.0] * len(df.first().vector))], df.schema)
    q, r = df.where(F.col("verb") < "w3"), df.where(F.col("verb") >= "w3").unionByName(zero)

    def rows(d: DataFrame):
        return sorted((x.query, x["rank"], x.neighbor, round(x.similarity, 9)) for x in d.collect())
    many = vectors.knn_join(q, r, 5, block_rows=3)
    assert rows(many) == rows(vectors.knn_join(q, r, 5))
    assert "FlatMapCoGroupsInArrow" in many._jdf.queryExecution().executedPlan().toString()
    assert vectors.knn_join(q.limit(0), r, 5).count() == 0 == vectors.knn_join(q, r.limit(0), 5).count()
