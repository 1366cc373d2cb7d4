"""Top-k, embedding and text near-duplicates, components: against brute force."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from evtab.llm import neardup, topk, vecdup
from evtab.llm.components import components
from evtab.llm.util import prefix_sums

VEC = "vec_id long, embedding array<double>, score string"


def union_find(nodes, pairs):
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n
    for a, b in pairs:
        x, y = top(a), top(b)
        up[max(x, y)] = min(x, y)
    return {n: top(n) for n in nodes}


@pytest.mark.parametrize("shape", ["path", "random", "hub"])
def test_components(spark, shape):
    rng = np.random.default_rng(4)
    n = 120
    order = rng.permutation(n).tolist()
    pairs = {"path": list(zip(order, order[1:])), "hub": [(7, i) for i in range(60)],
             "random": [tuple(x) for x in rng.integers(0, n, (90, 2)).tolist()]}[shape]
    df = spark.createDataFrame([*pairs, (1, None), (3, 3)], "a long, b long")
    got = {r.id: r.component for r in components(df).collect()}
    want = union_find(range(n), pairs)
    touched = {x for p in pairs if p[0] != p[1] for x in p}
    assert got == {k: want[k] for k in touched}


def test_no_links(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_prefix_sums(spark):
    rows = [(k, i % 3, i, i * 2) for k in ("x", None) for i in range(10)]
    df = spark.createDataFrame(rows, "k string, b int, o long, v long")
    got = {(r.k, r.o): (r.s, r.n) for r in prefix_sums(df, ["k"], "b", ["o"], {
        "s": F.col("v"), "n": F.lit(1).cast("long")}).collect()}
    order = sorted(range(10), key=lambda i: (i % 3, i))
    for k in ("x", None):
        assert [got[k, i] for i in order] == [(sum(2 * j for j in order[:p]), p) for p in range(10)]


def brute_top(rows, k):
    best = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            best[i] = min(best.get(i, v), v)
    q = {i: np.floor(256 * np.array(v)).astype(object) for i, v in best.items()}
    width = max((len(v) for v in q.values()), default=0)
    q = {i: np.concatenate([v, np.zeros(width - len(v), dtype=object)]) for i, v in q.items()}
    out = set()
    for i in q:
        if i % 5 == 0:
            s = sorted(((-int((q[i] * q[j]).sum()), j) for j in q if j != i))[:k]
            out |= {(i, r + 1, j, -x) for r, (x, j) in enumerate(s)}
    return out


@pytest.mark.parametrize("big", [1.0, 1e5])
def test_top_k(spark, big):
    rng = np.random.default_rng(1)
    rows = [(i, (np.round(rng.standard_normal(6), 1) * big).tolist()) for i in range(150)]
    rows += [(200 + i, rows[0][1]) for i in range(20)]                     # ties
    rows += [(300, None), (301, [1.0, None] * 3), (302, [float("nan")] * 6), (303, [float("inf")] * 6),
             (None, [9.0] * 6), (5, [-9.0 * big] * 6), rows[7], (310, [2.0]), (315, [])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], VEC)
    got = topk.exact_top_k(df, F.col("vec_id") % 5 == 0, 4, shard_rows=40, block_rows=9)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert {tuple(r) for r in got.collect()} == brute_top(rows, 4)


def test_top_k_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0], "x"), (1, [2.0], "x")], VEC)
    assert [tuple(r) for r in topk.exact_top_k(df, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 131072)]
    assert topk.exact_top_k(df, F.col("vec_id") > 5).count() == 0
    assert topk.exact_top_k(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_tree_prunes_and_keeps_ties():
    rng = np.random.default_rng(2)
    rows = np.floor(rng.standard_normal((2000, 3)) * 40)
    tree = topk.Tree(np.arange(2000), rows)
    assert (tree.low <= tree.high).all() and sorted(tree.ids) == list(range(2000))
    q = rows[3]
    got = sorted(tree.search(q, tree.bounds(q[None])[0], 3, 7, float("-inf")), reverse=True)
    want = sorted(((float(rows[i] @ q), -i) for i in range(2000) if i != 3), reverse=True)[:7]
    assert [(float(a), int(b)) for a, b in got] == want


@pytest.mark.parametrize("kind", [np.float64, np.int64])
def test_queries_of_a_block_walk_a_tree_together(kind):
    rng = np.random.default_rng(6)
    rows = np.floor(rng.standard_normal((1500, 4)) * 9).astype(kind)       # many ties
    ids = rng.permutation(3000)[:1500]
    tree = topk.Tree(ids, rows)
    q, own = rows[:300], ids[:300].copy()
    reach = np.where(np.arange(300) % 3 == 0, -np.inf, np.arange(300) - 100.0)
    visits = []

    class Counted(type(rows)):                                             # numpy rows that count the products over them
        def __getitem__(self, at):
            visits.append(at)
            return super().__getitem__(at)
    tree.rows = tree.rows.view(Counted)
    at, found, scores = (np.asarray(c) for c in tree.search_block(q, tree.bounds(q), own, 6, reach))
    got = set(zip(at.tolist(), found.tolist(), scores.tolist(), strict=True))
    want = set()
    for i in range(300):
        best = sorted((-int(rows[j] @ q[i]), int(ids[j])) for j in range(1500) if ids[j] != own[i])
        want |= {(i, j, -x) for x, j in best[:6] if -x >= reach[i]}
    assert got == want and 0 < len(visits) < 300                           # far fewer than one for a query and leaf
    assert all(len(c) == 0 for c in tree.search_block(q[:0], tree.bounds(q[:0]), own[:0], 6, reach[:0]))


@pytest.mark.parametrize("kind,part_rows", [("double", 60), ("float", 8192)])
def test_vector_near_duplicates(spark, kind, part_rows):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, 12))
    rows = [(i, base[i]) for i in range(60)]
    rows += [(100 + i, base[i % 4] * (1 + i) + rng.standard_normal(12) * 0.2) for i in range(90)]
    rows += [(300 + i, base[9]) for i in range(30)]                        # one very common vector
    rows = [(i, np.asarray(v, dtype=kind).astype(float).tolist()) for i, v in rows]
    odd = [(400, None), (401, [0.0] * 12), (402, [None] * 12), (403, [float("nan")] * 12), (404, [])]
    df = spark.createDataFrame([(i, v) for i, v in [*rows, *odd, rows[5], (None, [1.0] * 12)]],
                               f"vec_id long, embedding array<{kind}>").withColumn("id", F.lit("clash"))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept)
           for r in vecdup.near_duplicates(df, part_rows=part_rows).collect()}
    ids, x = [i for i, _ in rows], np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    pairs = [(ids[i], ids[j]) for i, j in zip(*np.nonzero(np.triu(near, 1)), strict=True)]
    comp = union_find(ids, pairs)
    want = {i: (int(near[k].sum()) - 1, comp[i], comp[i] == i) for k, i in enumerate(ids)}
    want |= {i: (0, i, True) for i, _ in odd}
    assert got == want
    assert len(pairs) > 400
    assert vecdup.near_duplicates(df.limit(0)).count() == 0


def shingle_set(text):
    words = text.split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_float_vectors_at_the_threshold(spark):
    rng = np.random.default_rng(17)
    rows, want = [], {}
    while len(rows) < 1200:
        a, b = rng.standard_normal((2, 64))
        a /= np.linalg.norm(a)
        b -= (a @ b) * a
        c = 0.9 + rng.uniform(-1e-7, 1e-7)
        b = c * a + np.sqrt(1 - c * c) * b / np.linalg.norm(b)
        x, y = a.astype(np.float32), b.astype(np.float32)
        u, v = x.astype(np.longdouble), y.astype(np.longdouble)
        exact = float((u @ v) / np.sqrt((u @ u) * (v @ v)) - np.longdouble(0.9))
        if 1e-12 < abs(exact) <= 1e-7:
            for e in (x, y):
                want[len(rows)] = int(exact > 0)
                rows.append((len(rows), e.tolist()))
    assert 200 < sum(want.values()) < 1000
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vecdup.near_duplicates(df, part_rows=500).collect()}
    assert got == {i: (n, i - i % 2 if n else i) for i, n in want.items()}


def test_text_near_duplicates(spark, monkeypatch):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choice(vocabulary, rng.integers(1, 120))) for _ in range(60)]
    for k in range(80):                                                   # near copies at all distances
        words = texts[k % 12].split()
        for _ in range(k // 16):
            words[rng.integers(len(words))] = "other"
        texts.append(" ".join(words))
    texts += ["word " * 20_000, "word " * 20_001, "", "", "   ", "a b", "a b", "a  b"]
    rows = [*enumerate(texts), (500, None), (501, None), (3, texts[3])]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, sig string")
    df = df.unionByName(spark.createDataFrame([(None, texts[0], "x")], df.schema))
    monkeypatch.setattr(neardup, "PART_ROWS", 7)
    got = neardup.near_duplicates(df).collect()
    assert len(got) == len(rows) + 1
    sets = [shingle_set(t) for t in texts]
    pairs = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if texts[a] == texts[b]
             or (sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))]
    comp = union_find(range(len(texts)), pairs)
    for r in got:
        if r.doc_id is None:
            assert (r.class_id, r.component_id, r.kept) == (None, None, True)
        elif r.doc_id >= 500:
            assert (r.class_id, r.component_id, r.kept) == (r.doc_id, r.doc_id, True)
        else:
            assert r.class_id == texts.index(texts[r.doc_id])
            assert (r.component_id, r.kept) == (comp[r.doc_id], comp[r.doc_id] == r.doc_id)
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_unresolved_buckets_are_compared(spark, monkeypatch):
    """With one-row bands nearly everything shares buckets: components inside them must still be found."""
    monkeypatch.setattr(neardup, "PART_ROWS", 5)
    rng = np.random.default_rng(6)
    shared = " ".join(f"s{i}" for i in range(60))
    texts = [shared + " " + " ".join(f"t{g}x{i}" for i in range(40)) for g in range(6)]
    texts = [" ".join(w if rng.random() > 0.002 else "zz" for w in t.split()) for t in texts for _ in range(6)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(df).collect()}
    sets = [shingle_set(t) for t in texts]
    pairs = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2)
             if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert got == union_find(range(len(texts)), pairs)


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(7)
    items = rng.integers(0, 2 ** 62, 300).astype(np.uint64)
    w = np.ones(300)
    heavy = w.copy()
    heavy[:100] = 7
    got = []
    for k in range(30):
        s = neardup.signatures([neardup.mixed(items + np.uint64(k))] * 2, [w, heavy])
        got.append((s[0] == s[1]).mean())
    assert abs(np.mean(got) - 300 / 900) < 0.03
    one = neardup.signatures([items[:1], items[:1], items[:3]])
    assert one.shape == (3, neardup.K) and (one[0] == one[1]).all()


def test_count_weights_change_the_similarity(spark):
    a, b = "x y z u v " * 30, "x y z u v " * 60
    df = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    assert sum(r.kept for r in neardup.near_duplicates(df).collect()) == 1
    assert sum(r.kept for r in neardup.near_duplicates(df, weights="count").collect()) == 2
