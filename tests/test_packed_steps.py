"""Steps that pack their rows before a shuffle, against plain Python."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evtab.functions import text as T
from evtab.operators import corpus, features, tasks
from evtab.plans.fixtures import piece_tokenizer


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def plain_contexts(rows):
    sents = {}
    for lang, doc, o, tok, e, pos in rows:
        sents.setdefault((lang, doc), []).append((o, tok, e, pos))
    out = []
    for k, toks in sents.items():
        toks.sort(key=lambda r: tuple((x is not None, x) if x is not None else (False,) for x in r))
        for i, (o, tok, e, pos) in enumerate(toks):
            if (e or "").startswith("e") and pos in ("VERB", "AUX"):
                out.append((*k, o, e, tok, pos, " ".join(t for _, t, _, _ in toks[:i] if t is not None),
                            " ".join(t for _, t, _, _ in toks[i + 1:] if t is not None)))
    return Counter(out)


def test_contexts_of_sentences_in_many_packs(spark):
    rng = random.Random(3)
    rows = []
    for s in range(40):
        key = (rng.choice(["it", None]), None if s == 7 else f"d{s % 11}")
        for o in range(rng.randint(1, 60)):
            rows.append((*key, rng.choice([o, o, o, max(0, o - 1), None]),
                         rng.choice(["a", "bé", "", "x\x00y", "\\N", "\\", "c d", None]),
                         rng.choice(["", "O", "e1", "e2", "f", None]), rng.choice(["VERB", "AUX", "NOUN", None])))
    schema = "lang string, docid string, tok_pos int, token string, eventid string, pos string"
    want = plain_contexts(rows)
    names = ["lang", "docid", "tok_pos", "eventid", "verb", "pos", "before", "after"]
    for df in (spark.createDataFrame(rows, schema).coalesce(1),
               spark.createDataFrame(rng.sample(rows, len(rows)), schema).repartition(7)):
        got = corpus.event_contexts(df, key=["lang", "docid"]).select(names)
        assert Counter(map(tuple, got.collect())) == want
    assert "Aggregate" not in plan(got) and corpus.event_contexts(df.limit(0), key=["lang", "docid"]).count() == 0


def test_whole_sentences_are_cut_together():
    """The packs that need no merging give, all at once, what the merge gives for each."""
    rng = random.Random(11)
    kind = pa.list_(pa.struct([("i", pa.int32()), ("f0", pa.string()), ("f1", pa.string()), ("v", pa.bool_())]))
    text, first, marks = [], [], []
    for _ in range(60):
        toks = [rng.choice(["a", "", "bé", "c d", "日本", "😀x"]) for _ in range(rng.randint(1, 12))]
        text.append("\0".join(toks))
        first.append(rng.randint(0, 5))
        marks.append([{"i": i, "f0": f"e{i}", "f1": rng.choice(["VERB", None]), "v": rng.random() < 0.5}
                      for i in range(len(toks)) if rng.random() < 0.4])
    rows = np.array([r for r in range(60) if r % 3])
    at, whole, fields, sizes = corpus._plain_sentences(rows, pa.array(text), pa.array(first, pa.int64()),
                                                       pa.array(marks, kind), pa.int32())
    events, got = list(zip(*(f.to_pylist() for f in fields), strict=True)), []
    for n, text_ in zip(sizes, whole.to_pylist(), strict=True):
        got.append((text_, events[:n]))
        events = events[n:]
    want = [corpus._whole_sentence([(text[r], first[r], None, marks[r])]) for r in rows]
    kept = [r for r, (_, found) in zip(rows, want, strict=True) if found]
    assert at.tolist() == kept and not events
    assert got == [(t, [tuple(x[n] for n in ("f0", "f1", "o", "t", "s", "e")) for x in found]) for t, found in want if found]


def test_tokens_before_the_target_are_cut_once(spark):
    sides = [("a ``b'' -LRB- c", "''d''"), (None, ""), ("", " `` "), ("x`", "`y"), ("  p\u00a0q\x1c", "r\ns"), ("'", "'")]
    rows = [(b, v, a, 1, 1.0, "d", f"e{i}") for i, (b, a) in enumerate(sides) for v in ("v", "", None, "`", "v w")]
    df = spark.createDataFrame(rows, "before string, verb string, after string, label int, label_confidence double, "
                                     "docid string, eventid string")

    def norm(x):
        for old, new in T.QUOTE_REPLACEMENTS:
            x = (x or "").replace(old, new)
        return x
    for brackets, frame in ((True, tasks.seq_clf_verbtok(df, include_brackets=True)), (False, tasks.seq_clf_verbtok(df)),
                            (None, tasks.tok_clf(df))):
        assert "size(filter(" not in plan(frame)
        names = ("sentence", "tgt_idx") if brackets is None else ("input", "target_token_id")
        for (b, v, a, *_), r in zip(rows, frame.collect(), strict=True):
            mid = ["["] * bool(brackets) + (norm(v) if brackets is None else v or "").split() + ["]"] * bool(brackets)
            assert r[names[0]] == norm(b).split() + mid + norm(a).split()
            assert r[names[1]] == len((b or "").split()) + bool(brackets)


def test_token_metrics_reads_its_input_once(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), [rng.choice([-100, 0, 1, 2, None]) for _ in range(9)],
             [rng.choice([0, 1, 2, 2, None]) for _ in range(9)]) for _ in range(80)]
    rows.append(("o", [2, 2, -100], [2, 0, 1]))
    rows.append(("none", [-100, None], [2, 0]))
    df = spark.createDataFrame(rows, "k string, label_ids array<int>, pred_ids array<int>")
    for by in ([], ["k"]):
        m = tasks.token_metrics(df, by=by)
        assert plan(m).count("Scan ") == 1
        cells = {}
        for k, ls, ps in rows:
            for x, p in zip(ls, ps, strict=True):
                if x is not None and x != -100:
                    cells.setdefault(k if by else 0, Counter())[x, p] += 1
        got = {r.k if by else 0: (r.fps, r.macro_f1, r.n_true) for r in m.collect()}
        assert got.keys() == cells.keys()
        for key, c in cells.items():
            picked = sum(n for (x, p), n in c.items() if p in (0, 1))
            false = sum(n for (x, p), n in c.items() if p in (0, 1) and x == 2)
            true = {xp: n for xp, n in c.items() if xp[0] != 2}
            f1 = [2 * true.get((q, q), 0) / sum(n * ((x == q) + (p == q)) for (x, p), n in true.items())
                  for q in {q for xp in true for q in xp}]
            want = false / picked if picked else 0.0, 0.0 if key is None or not f1 else sum(f1) / len(f1), sum(true.values())
            assert all(math.isclose(a, b, abs_tol=1e-9) for a, b in zip(got[key], want, strict=True)), (key, got[key], want)
    assert tasks.token_metrics(df.limit(0)).count() == 0


def test_first_mention_does_not_shuffle_the_sides_of_an_event(spark):
    import __spark_entry__ as E
    shuffled = [x for x in plan(E.queries()["first_mention"](spark, "/root/testdata/sf0.001")).splitlines()
                if "SortAggregate" in x or "HashAggregate" in x]
    assert shuffled and not any("before" in x for x in shuffled)


@pytest.mark.parametrize("max_len", [None, 2, 5, 40])
def test_piece_ids_of_all_lists_at_once(spark, max_len):
    rng = random.Random(5)
    lists = [[rng.choice(["", "a", "naïve", "abcdefghij", "日本語の"]) for _ in range(rng.randint(0, 9))] for _ in range(50)]
    tok = piece_tokenizer(3, max_len)
    kind = pa.list_(pa.string())
    assert tok.arrays(pa.array(lists, kind)).to_pylist() == [tok(w) for w in lists]
    assert tok.arrays(pa.array(lists, kind).slice(3, 9)).to_pylist() == [tok(w) for w in lists[3:12]]
    df = spark.createDataFrame(list(enumerate(lists)), "k int, w array<string>")
    for hook in (tok, lambda w: [*range(len(w))]):
        got = df.select("k", tasks.word_ids_udf(hook, 4)("w").alias("i")).union(
            tasks.with_word_ids(df, hook, "w", "i").select("k", "i")).collect()
        assert len(got) == 100 and all(r.i in (hook(lists[r.k]), hook(lists[r.k])[:4]) for r in got)


def test_strip_takes_no_pattern(spark):
    cells = ["", " ", "　\x1ca b\x85 ", "x", "​x​", "é \n"]
    df = spark.createDataFrame([(c,) for c in cells], "c string").select("c", T.py_strip("c").alias("s"))
    assert [r.s for r in df.collect()] == [c.strip() for c in cells] and "regexp" not in plan(df)
    text = spark.createDataFrame([("\n DCT 2020\n a\n",), ("DCT",), ("aDCT\nb",), (None,)], "c string")
    assert [r[0] for r in text.select(T.strip_header("c")).collect()] == ["a", "DCT", "aDCT\nb", None]


def feature_table(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(120):
        words = [rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(rng.randint(0, 14))]
        rows.append((None if i == 5 else f"r{i % 100}", words, [rng.choice(["noun", "verb", "odd"]) for _ in words],
                     rng.randint(0, 15)))
    return spark.createDataFrame(rows, "row string, words array<string>, tags array<string>, verb_idx int")


def near(a, b):
    return a.keys() == b.keys() and all(math.isclose(a[k], b[k], rel_tol=1e-9) for k in a)


@pytest.mark.parametrize("bow", [True, False])
def test_features_are_those_of_the_joins(spark, monkeypatch, bow):
    rows = feature_table(spark, 8)
    pf = features.PositionalFeatures(2, 2, bow, 30, (1, 2))

    def found():
        fit = pf.fit(rows.where("row < 'r6'"))
        cells = {(r.row, r.col): r.value for r in pf.transform(rows, fit).collect()}
        values = {(r.row, r.term): r.value for r in pf.text_tfidf(rows, fit.vocab).collect()}
        return [r.col for r in fit.kept.orderBy("fidx").collect()], cells, values
    held = found()
    assert "Generate" not in plan(pf.raw_cells(rows, pf.fit(rows)))
    monkeypatch.setattr(features, "CANDIDATES", 1)
    assert features._held_terms(pf.vocabulary(rows, 120)) is None
    joined = found()
    assert held[0] == joined[0] and near(held[1], joined[1]) and near(held[2], joined[2])


def test_terms_of_a_key_in_many_rows(spark):
    rows = feature_table(spark, 9)
    want = Counter()
    for r in rows.collect():
        want.update((r.row, t) for t in [*r.words, *map(" ".join, zip(r.words, r.words[1:]))])
    tf = features.term_frequency(rows.repartition(9), n_max=2)
    assert Counter({(r.row, r.term): r.tf for r in tf.collect()}) == want and "Generate" not in plan(tf)
