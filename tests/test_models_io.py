"""SVM optimality against numpy, the head against numpy, file sources and
sinks, the streaming path, and the driver contract."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from evtab.operators import scoring, svm
from evtab.sinks import writers
from evtab.sources import readers


def np_objective(X, y, c, w, b, penalty):
    h = np.maximum(0, 1 - y * (X @ w + b))
    reg = np.abs(np.append(w, b)).sum() if penalty == "l1" else 0.5 * (w @ w + b * b)
    return reg + np.sum(c * h * h)


def np_fista(X, y, c, penalty, iters=20000):
    A = np.hstack([X, np.ones((len(X), 1))])
    L = 2 * np.sum(c[:, None] * A * A) + (1 if penalty == "l2" else 0)
    x = np.zeros(A.shape[1])
    z, t = x.copy(), 1.0
    for _ in range(iters):
        h = np.maximum(0, 1 - y * (A @ z))
        g = A.T @ (-2 * c * h * y)
        if penalty == "l2":
            xn = z - (g + z) / L
        else:
            u = z - g / L
            xn = np.sign(u) * np.maximum(np.abs(u) - 1 / L, 0)
        tn = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = xn + (t - 1) / tn * (xn - x)
        x, t = xn, tn
    return x[:-1], x[-1]


def test_a_failed_line_search_is_not_convergence():
    class Wall:                                        # the loss rises wherever the gradient points down
        size, jobs = 1, 0

        def along(self, x, d=None):
            steps = np.full(len(svm.STEPS), 10.0 if d is None else 1e6)
            return steps, np.array([-5.0])

        def gram(self, x, other, working):
            return np.eye(len(working))
    for penalty in ("l1", "l2"):
        x, _, it, converged = svm.minimise(Wall(), penalty, 50, 1e-2)
        assert x[0] == 0.0 and it == 0 and not converged


def test_a_step_counts_the_rows_of_all_its_trials():
    asked = []

    class Swinging:                                    # two whole steps run into rows, the third falls
        size, jobs = 1, 0

        def along(self, x, d=None):
            if d is None:
                return np.array([10.0]), np.array([-5.0])
            return np.full(len(svm.STEPS), 1e6 if len(asked) < 3 else 0.0), np.array([0.0])

        def gram(self, x, others, working):
            asked.append([float(o[0]) for o in others])
            return np.eye(len(working)) * len(asked)
    svm.minimise(Swinging(), "l2", 50, 1e-2)
    assert [len(a) for a in asked[:3]] == [0, 1, 2] and asked[2] == [2.5, 5 / 3]


def test_registered_svm_uses_the_tolerance_of_the_reference():
    from evtab.plans import features_q
    assert features_q.SVM_TOL == 1e-4


@pytest.mark.parametrize("penalty", ["l2", "l1"])
def test_fit_linear_svc_reaches_numpy_optimum(spark, penalty):
    rng = np.random.default_rng(0)
    n, d = 40, 5
    X = rng.normal(size=(n, d)) * (rng.random((n, d)) < 0.6)
    y01 = (X[:, 0] - X[:, 1] + 0.3 * rng.normal(size=n) > 0).astype(int)
    sw = 0.5 + rng.random(n)
    cells = [(f"r{i}", j, float(X[i, j])) for i in range(n) for j in range(d) if X[i, j] != 0]
    cdf = spark.createDataFrame(cells, "row string, col long, value double")
    rows = spark.createDataFrame([(f"r{i}", int(y01[i]), float(sw[i])) for i in range(n)],
                                 "row string, label int, sw double")
    m = svm.fit_linear_svc(cdf, rows, d, C=1.0, penalty=penalty, balanced=True, sample_weight="sw",
                           max_iter=250, tol=1e-6)
    assert m.converged
    with pytest.raises(RuntimeError, match="convergence"):
        svm.fit_linear_svc(cdf, rows, d, penalty=penalty, sample_weight="sw", max_iter=1, tol=1e-9)
    part = svm.fit_linear_svc(cdf, rows, d, penalty=penalty, sample_weight="sw", max_iter=1, tol=1e-9,
                              on_unconverged="report")
    assert not part.converged
    y = 2 * y01 - 1
    cw = {k: n / (2 * np.sum(y01 == k)) for k in (0, 1)}
    c = np.array([cw[k] for k in y01]) * sw
    w_ref, b_ref = np_fista(X, y, c, penalty)
    f_ref = np_objective(X, y, c, w_ref, b_ref, penalty)
    f_got = np_objective(X, y, c, m.weights, m.bias, penalty)
    assert f_got <= f_ref * (1 + 1e-5) + 1e-9
    assert np.isclose(m.objective, f_got, rtol=1e-6)
    pred = (X @ m.weights + m.bias > 0).astype(int)
    assert (pred == y01).mean() > 0.7


def test_score_head_matches_numpy(spark):
    rng = np.random.default_rng(1)
    w1, b1, w2, b2 = rng.normal(size=(4, 3)), rng.normal(size=4), rng.normal(size=(2, 4)), rng.normal(size=2)
    X = rng.normal(size=(6, 3))
    df = spark.createDataFrame([(i, X[i].tolist()) for i in range(6)], "i int, v array<double>")
    out = scoring.logit_predictions(scoring.score_head(df, "v", w1, b1, w2, b2)).orderBy("i").collect()
    z = np.tanh(X @ w1.T + b1) @ w2.T + b2
    for i, r in enumerate(out):
        assert np.allclose(r.logits, z[i])
        assert r.pred == int(np.argmax(z[i]))
        e = np.exp(z[i] - z[i].max())
        assert np.isclose(r.prob, (e / e.sum()).max())


def test_argmax_first_on_tie_and_loss(spark):
    df = spark.createDataFrame([([1.0, 1.0], 1, 2.0), ([0.0, 3.0], 0, 1.0)], "logits array<double>, label int, w double")
    p = scoring.logit_predictions(df).collect()
    assert [r.pred for r in p] == [0, 1]
    loss = scoring.weighted_log_loss(df, weight="w").first()
    ce = [np.log(2.0), np.log(1 + np.exp(3.0))]
    assert np.isclose(loss.loss, (2.0 * ce[0] + 1.0 * ce[1]) / 2)   # divided by rows, not weights
    assert np.isclose(loss.loss_plain, sum(ce) / 2)


def test_read_annotations_csv(spark, tmpdir_path):
    col = "can_the_verb_span_stylecolorblueverb_span_be_anchored_in_time"
    p1 = os.path.join(tmpdir_path, "a.csv")
    with open(p1, "w") as f:
        f.write(f'docid,eventid,verb,before,after,bodytext,_golden,_unit_state,{col},{col}:confidence\n')
        f.write('d1,e1,said,"He ""quoted""","multi\nline",<p>x</p>,true,golden,yes_its_anchorable,0.9\n')
        f.write('d1,e2,NA,,,<p></p>,false,finalized,,NA\n')
    p2 = os.path.join(tmpdir_path, "b.csv")
    with open(p2, "w") as f:
        f.write("docid,eventid,verb,extra\nd2,e9,run,kept\n")
    df = readers.read_annotations(spark, [p1, p2], ["tb", "dense"])
    rows = df.orderBy("file_priority", "row_pos").collect()
    assert rows[0].before == 'He "quoted"' and rows[0].after == "multi\nline"
    assert rows[1].verb is None                      # C23: 'NA' is missing, later ''
    assert rows[2].extra == "kept" and rows[2].source == "dense"
    assert [r.file_priority for r in rows] == [0, 0, 1]
    assert rows[0].row_pos < rows[1].row_pos
    conf = df.select(F.col(f"`{col}:confidence`")).first()[0]
    assert conf == 0.9
    types = dict(df.dtypes)
    assert types[f"{col}:confidence"] == "double" and types["_golden"] == "boolean"   # one NA changes no type


def test_id_lists_and_sinks(spark, tmpdir_path):
    tsv = os.path.join(tmpdir_path, "platinum.txt")
    with open(tsv, "w") as f:
        f.write("d1\tx\nd2\ty\nd1\tz\n")
    words = os.path.join(tmpdir_path, "dev.txt")
    with open(words, "w") as f:
        f.write("d3 d4\n d5\n")
    assert sorted(r.docid for r in readers.read_id_list(spark, tsv, "tsv").collect()) == ["d1", "d2"]
    ids = readers.read_id_list(spark, words, "words")
    assert sorted(r.docid for r in ids.collect()) == ["d3", "d4", "d5"]
    out = os.path.join(tmpdir_path, "ids")
    writers.write_id_list(ids, out)
    lines = []
    for name in sorted(os.listdir(out)):
        if name.startswith("part-"):
            lines += open(os.path.join(out, name)).read().split()
    assert lines == ["d3", "d4", "d5"]


def test_predictions_roundtrip(spark, tmpdir_path):
    df = spark.createDataFrame([("m0", "en", "dev", "d", "e1", "a", "b", "c", 1, 0.8, None),
                                ("m0", "en", "test", "d", "e2", "a", "b", "c", 0, 0.6, 1)],
                               "model string, lang string, split string, docid string, eventid string, "
                               "before string, verb string, after string, pred int, prob double, label int")
    path = os.path.join(tmpdir_path, "preds")
    writers.write_predictions(df, path, fmt="csv")
    back = spark.read.option("header", True).csv(path)
    got = {r.eventid: r for r in back.collect()}
    assert got["e1"].input == "a | b | c" and got["e1"].label is None or got["e1"].label == ""
    assert set(os.listdir(path)) >= {"model=m0"}
    p1 = os.path.join(tmpdir_path, "svm.csv")
    with open(p1, "w") as f:
        f.write(",lang,split,docid,eventid,input,pred,label\n0,en,dev,d,e1,x,1,1\n")
    p2 = os.path.join(tmpdir_path, "seq.csv")
    with open(p2, "w") as f:
        f.write(",lang,split,docid,eventid,input,pred,prob,label\n0,en,dev,d,e1,x,0,0.7,1\n")
    long = readers.read_predictions(spark, {"svm": p1, "seq": p2})
    rows = {r.model: r for r in long.collect()}
    assert rows["svm"].prob is None and rows["seq"].prob == 0.7
    rev = os.path.join(tmpdir_path, "rev.csv")
    with open(rev, "w") as f:
        f.write("docid;eventid;annotation\nd;e1;1\n")
    assert readers.read_review(spark, rev).first().annotation == 1


def test_a_second_model_leaves_the_first(spark, tmpdir_path):
    row = ("en", "dev", "d", "e1", "a", "b", "c", 1, 0.8, 1)
    cols = "model string, lang string, split string, docid string, eventid string, before string, verb string, " \
           "after string, pred int, prob double, label int"
    path = os.path.join(tmpdir_path, "two")
    for model in ("m0", "m1", "m1"):
        writers.write_predictions(spark.createDataFrame([(model, *row)], cols), path)
    assert sorted(r.model for r in spark.read.parquet(path).collect()) == ["m0", "m1"]


def test_quarantine_and_stream(spark, tmpdir_path):
    df = spark.createDataFrame([("a", "b", "c", "<p>a b c</p>"), ("a", "zz", "c", "<p>a b c</p>")],
                               "before string, verb string, after string, bodytext string")
    from evtab.operators.clean import flag_broken
    good = writers.write_quarantine(flag_broken(df), os.path.join(tmpdir_path, "broken"))
    assert good.count() == 1 and spark.read.parquet(os.path.join(tmpdir_path, "broken")).count() == 1
    from evtab.streaming.cleaning import start_flagging
    src = os.path.join(tmpdir_path, "in")
    os.makedirs(src)
    with open(os.path.join(src, "f1.csv"), "w") as f:
        f.write("before,verb,after,bodytext\na,b,c,<i>abc</i>\nx,y,z,<i>q</i>\n")
    schema = StructType([StructField(n, StringType()) for n in ["before", "verb", "after", "bodytext"]])
    q = start_flagging(spark, src, schema, os.path.join(tmpdir_path, "sink"), os.path.join(tmpdir_path, "chk"))
    q.awaitTermination(120)
    out = spark.read.parquet(os.path.join(tmpdir_path, "sink"))
    assert sorted((r.verb, r.broken) for r in out.collect()) == [("b", False), ("y", True)]


def test_driver_contract(spark):
    import __spark_entry__ as E
    e = E.entry(spark)
    assert e.count() > 0 and e.columns == ["split", "label", "n_events"]
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 60
    own = {k for k in q if k != "pipeline" and not k.startswith("op")}   # without the corpus queries, if present
    assert own - set(o) == {"score_head", "fit_linear_svc", "fit_head"}
