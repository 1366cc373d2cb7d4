"""Seeded ranks, samples, holdouts; metrics against numpy/Python formulas
(C18, C20, C21, C22)."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from evtab.operators.split import seeded_shuffle
from evtab.operators import metrics, split


def md5(s):
    return hashlib.md5(s.encode()).hexdigest()


def test_hash_rank_matches_python_order(spark):
    keys = [f"k{i}" for i in range(300)]
    groups = ["a" if i % 3 else "b" for i in range(300)]
    df = spark.createDataFrame(list(zip(keys, groups)), "k string, g string")
    got = {(r.g, r.k): r.rank for r in split.hash_rank(df, "k", 7, ["g"], bucket_chars=1).collect()}
    for g in "ab":
        ks = sorted([k for k, gg in zip(keys, groups) if gg == g], key=lambda k: (md5(f"7:{k}"), k))
        assert [got[(g, k)] for k in ks] == list(range(1, len(ks) + 1))


def test_seeded_sample_exact_and_short(spark):  # C22
    df = spark.createDataFrame([(f"e{i}", "fr" if i < 30 else "es", "test") for i in range(40)],
                               "eventid string, lang string, split string")
    s = split.seeded_sample(df, 10, "eventid", 42, by=("lang",), on_short="all")
    counts = {r.lang: r["count"] for r in s.groupBy("lang").count().collect()}
    assert counts == {"fr": 10, "es": 10}
    with pytest.raises(Exception, match="sample of 20"):
        split.seeded_sample(df, 20, "eventid", 42, by=("lang",)).collect()


def test_holdout_sizes(spark):
    df = spark.createDataFrame([(f"d{i % 23}", f"e{i}") for i in range(200)], "docid string, eventid string")
    g = split.group_holdout(df, 0.15, 42).collect()
    assert len(g) == 23 and sum(r.is_dev for r in g) == int(23 * 0.15)
    f = split.file_holdout(df.withColumn("lang", F.lit("fr")), 0.2, 42).collect()
    assert sum(r.is_test for r in f) == round(23 * 0.2)


def py_macro_f1(y, p):
    classes = sorted(set(y) | set(p))
    f = []
    for c in classes:
        tp = sum(1 for a, b in zip(y, p) if a == c and b == c)
        fp = sum(1 for a, b in zip(y, p) if a != c and b == c)
        fn = sum(1 for a, b in zip(y, p) if a == c and b != c)
        f.append(0.0 if 2 * tp + fp + fn == 0 else 2 * tp / (2 * tp + fp + fn))
    return sum(f) / len(f)


def py_kappa(y, p):
    n = len(y)
    classes = sorted(set(y) | set(p))
    po = sum(a == b for a, b in zip(y, p)) / n
    pe = sum(y.count(c) * p.count(c) for c in classes) / n / n
    return None if pe == 1 else (po - pe) / (1 - pe)


@pytest.mark.parametrize("y,p", [
    ([0, 1, 1, 0, 1, 2], [0, 1, 0, 0, 2, 2]),
    ([1, 1, 1], [1, 1, 0]),
    ([2, 2, 2, 2], [0, 0, 2, 2]),       # C18: a class only predicted counts with F1 0
])
def test_macro_f1_and_kappa(spark, y, p):
    df = spark.createDataFrame(list(zip(y, p)), "label int, pred int")
    assert math.isclose(metrics.macro_f1(df).first().macro_f1, py_macro_f1(y, p))
    k = metrics.cohen_kappa(df).first().kappa
    ref = py_kappa(y, p)
    assert (k is None and ref is None) or math.isclose(k, ref, abs_tol=1e-12)


def test_single_class_zero_f1_null_kappa(spark):  # C21
    df = spark.createDataFrame([(1, 1), (1, 1)], "label int, pred int")
    assert metrics.macro_f1(df).first().macro_f1 == 1.0
    assert metrics.cohen_kappa(df).first().kappa is None


def test_class_report_matches_formulas(spark):
    y = [0, 1, 1, 0, 1, 1, 0]
    p = [0, 1, 0, 0, 1, 0, 1]
    df = spark.createDataFrame(list(zip(y, p)), "label int, pred int")
    rep = {(r["class"], r.metric): r.value for r in metrics.class_report(df).collect()}
    for c in (0, 1):
        tp = sum(a == c and b == c for a, b in zip(y, p))
        prec = tp / sum(b == c for b in p)
        rec = tp / sum(a == c for a in y)
        assert math.isclose(rep[(str(c), "precision")], prec)
        assert math.isclose(rep[(str(c), "recall")], rec)
        assert math.isclose(rep[(str(c), "f1-score")], 2 * prec * rec / (prec + rec))
    assert math.isclose(rep[("accuracy", "accuracy")], sum(a == b for a, b in zip(y, p)) / len(y))
    assert math.isclose(rep[("macro avg", "f1-score")], py_macro_f1(y, p))


def py_fleiss(table):
    t = np.asarray(table, dtype=float)
    n_sub, _ = t.shape
    r = t.sum(1).max()
    p_cat = t.sum(0) / t.sum()
    p_rat = ((t * t).sum(1) - r) / (r * (r - 1))
    pe = (p_cat ** 2).sum()
    return (p_rat.mean() - pe) / (1 - pe)


def test_fleiss_kappa_nulls_count_negative(spark):  # C20
    votes = [(1, 1, 0), (0, 0, 0), (1, None, 1), (1, 1, 1), (0, 1, None)]
    df = spark.createDataFrame(votes, "a int, b int, c int")
    got = metrics.fleiss_kappa(df, ["a", "b", "c"]).first().fleiss_kappa
    table = [[3 - sum(v or 0 for v in row), sum(v or 0 for v in row)] for row in votes]
    assert math.isclose(got, py_fleiss(table))


def test_sorted_index(spark):
    from evtab.operators.features import sorted_index
    df = spark.range(0, 5000, numPartitions=7).selectExpr("cast((id * 7919) % 5000 as string) AS term")
    want = sorted(str((i * 7919) % 5000) for i in range(5000))
    got = sorted((r.idx, r.term) for r in sorted_index(df, ["term"], "idx").collect())
    assert [t for _, t in got] == want and [i for i, _ in got] == list(range(5000))


def test_seeded_rank_of_repeated_event_ids(spark):
    """Equal event ids in two documents: the rank follows the whole key, whatever the partitioning."""
    df = spark.createDataFrame([(f"d{i % 9}", f"e{i // 9}") for i in range(90)], "docid string, eventid string")
    ranks = [sorted((r.shuffle_pos, r.docid, r.eventid) for r in seeded_shuffle(
        d, ["docid", "eventid"]).collect()) for d in (df, df.repartition(7), df.orderBy("docid"))]
    assert ranks[0] == ranks[1] == ranks[2] and [r[0] for r in ranks[0]] == list(range(1, 91))


def test_null_predictions_are_not_lost(spark):
    df = spark.createDataFrame([(1, 1), (0, 0), (0, None)], "label int, pred int")
    with pytest.raises(Exception, match="without a prediction"):
        metrics.macro_f1(df).collect()
    assert metrics.confusion(df, nulls="drop").count() == 2


def test_hash_rank_with_a_hot_group(spark):
    rows = [("hot" if i % 3 else f"g{i % 5}", f"k{i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, k string")
    r = split.hash_rank(df, "k", 1, ["g"], size_col="n")
    agg = {row.g: (sorted(row.rs), row.n) for row in
           r.groupBy("g").agg(F.collect_list("rank").alias("rs"), F.first("n").alias("n")).collect()}
    for g, (ranks, n) in agg.items():
        assert ranks == list(range(1, n + 1))
    assert agg["hot"][1] == 2000


def test_kappa_unchanged_by_label_swap(spark):
    y = [0, 1, 1, 0, 1, 1, 0, 0]
    p = [0, 1, 0, 0, 1, 1, 1, 0]
    a = spark.createDataFrame(list(zip(y, p)), "label int, pred int")
    b = spark.createDataFrame([(1 - u, 1 - v) for u, v in zip(y, p)], "label int, pred int")
    assert math.isclose(metrics.cohen_kappa(a).first().kappa, metrics.cohen_kappa(b).first().kappa)


def test_results_unchanged_by_repartition(spark):
    from evtab.operators import clean
    rows = [(i, f"d{i % 4}", "v", f"e{i // 2}", i % 4 == 1, "golden" if i % 2 else "x") for i in range(40)]
    df = spark.createDataFrame(rows, "row_pos long, docid string, verb string, eventid string, "
                                     "_golden boolean, _unit_state string")
    base = sorted(r.row_pos for r in clean.dedup_golden(df, on_missing="first").collect())
    for n in (1, 3, 11):
        again = sorted(r.row_pos for r in clean.dedup_golden(df.repartition(n), on_missing="first").collect())
        assert again == base
    ranks = {r.k: r.rank for r in split.hash_rank(df.withColumn("k", F.col("eventid")), "row_pos").collect()}
    ranks2 = {r.k: r.rank for r in split.hash_rank(df.repartition(5).withColumn("k", F.col("eventid")),
                                                    "row_pos").collect()}
    assert ranks == ranks2
