"""The classification head: gradients by differences, the fit against a numpy run, held-out quality."""

import numpy as np
import pytest

from evtab.operators import scoring
from evtab.plans import scoring_q

SF = "/root/testdata/sf0.01"


def data(rng, n=90, dim=5, classes=3):
    x = rng.normal(size=(n, dim))
    return x, rng.integers(0, classes, n), 0.5 + rng.random(n)


def test_gradient_equals_differences():
    rng = np.random.default_rng(1)
    x, y, w = data(rng, n=20)
    head = scoring.Head.new(5, 4, 3, seed=2)
    flat = head.flat() + rng.normal(size=head.flat().size) * 0.3
    got = scoring.head_gradient(head.with_flat(flat), x, y, w)
    for k in range(len(flat)):
        step = np.zeros(len(flat))
        step[k] = 1e-6
        up, down = (scoring.head_gradient(head.with_flat(flat + s), x, y, w)[0] for s in (step, -step))
        assert abs((up - down) / 2e-6 - got[2 + k]) < 1e-5
    assert got[1] == 20


def numpy_losses(x, y, w, steps, rate, **shape):
    head = scoring.Head.new(x.shape[1], **shape)
    flat, m, v, out = head.flat(), 0.0, 0.0, []
    for t in range(1, steps + 1):
        got = scoring.head_gradient(head.with_flat(flat), x, y, w) / len(y)
        out.append(got[0])
        g = got[2:]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        flat = flat - rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return out, flat


def test_fit_equals_a_numpy_run_and_leaves_odd_rows_out(spark):
    rng = np.random.default_rng(5)
    x, y, w = data(rng)
    rows = [(a.tolist(), int(b), float(c)) for a, b, c in zip(x, y, w, strict=True)]
    odd = [(None, 1, 1.0), ([0.0] * 5, None, 1.0), ([0.0] * 5, 1, None)]
    df = spark.createDataFrame(rows + odd, "vector array<double>, label int, w double").repartition(4)
    head = scoring.fit_head(df, "vector", "label", "w", hidden=6, classes=3, steps=12, rate=0.05, seed=3, tol=0.0)
    losses, flat = numpy_losses(x, y, w, 12, 0.05, hidden=6, classes=3, seed=3)
    assert np.allclose(head.losses, losses, rtol=1e-9) and np.allclose(head.flat(), flat, rtol=1e-6)
    assert losses[-1] < losses[0]
    with pytest.raises(ValueError, match="no row"):
        scoring.fit_head(df.limit(0), "vector", "label", "w")
    with pytest.raises(Exception, match="different lengths"):
        scoring.fit_head(spark.createDataFrame([([1.0], 0), ([1.0, 2.0], 1)], "vector array<double>, label int").coalesce(1),
                         "vector", "label")


def test_held_out_vectors_are_told_better_than_by_the_majority(spark):
    got = scoring_q.q_fit_head(spark, SF).select("label", "pred").toPandas()

    def macro(pred):
        f = []
        for c in (0, 1):
            tp = int(((got.label == c) & (pred == c)).sum())
            wrong = int(((got.label == c) != (pred == c)).sum())
            f.append(2 * tp / max(1, 2 * tp + wrong))
        return sum(f) / 2
    assert len(got) == 125
    assert macro(got.pred) > macro(np.full(len(got), got.label.mode()[0])) + 0.1
