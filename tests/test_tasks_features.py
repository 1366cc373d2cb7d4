"""Token task records (C16, C17), subword alignment, positional tf-idf
features against a plain numpy implementation (C10-C12)."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from evtab.operators import features as FE
from evtab.operators import tasks
from evtab.plans.fixtures import piece_tokenizer


def test_prepare_unknown_task(spark):
    df = spark.createDataFrame([("a", "b", "c", 1, 1.0, "d", "e")],
                               "before string, verb string, after string, label int, label_confidence double, "
                               "docid string, eventid string")
    with pytest.raises(ValueError, match="no task"):
        tasks.prepare(df, "nope")
    r = tasks.prepare(df, "seq_clf_verbtok", include_brackets=True).first()
    assert r.input == ["a", "[", "b", "]", "c"] and r.target_token_id == 2
    c = tasks.prepare(df, "seq_clf_clstok", with_weight=False, with_label=False)
    assert "sample_weight" not in c.columns and "label" not in c.columns


def test_group_sentences_order_and_last_label(spark):  # C16
    rows = [  # sample order: row_pos; events out of position order, two on token 3
        (0, "s", "d", "a b c", "d", "e", 1, "ev3"),
        (1, "s", "d", "a", "b", "c d e", 0, "ev1"),
        (2, "s", "d", "a b c", "d", "e", None, "ev3b"),
    ]
    df = spark.createDataFrame(rows, "row_pos int, split string, docid string, before string, verb string, "
                                     "after string, label int, eventid string")
    s = tasks.prepare(df, "tok_clf").first()
    assert s.input == ["a", "[", "b", "]", "c", "[", "d", "]", "e"]
    assert s.labels == ["O", "O", "TGT-0", "O", "O", "O", "TGT-X", "O", "O"]
    assert s.event_ids == ["ev3", "ev1", "ev3b"]
    assert s.target_event_ids == ["ev1", "ev3b"]
    n_targets = len(s.target_event_ids)
    assert len(s.labels) == len(s.input) == len(s.sentence.split()) + 2 * n_targets


@pytest.mark.parametrize("max_len,pieces", [
    # one character column per piece: word index, label id, whether a target starts there (worked out by hand)
    (None, [(None, -100, 0), (0, 2, 0), (1, 2, 0), (2, 0, 1), (2, -100, 0), (2, -100, 0), (2, -100, 0), (3, 2, 0),
            (4, 2, 0), (5, 2, 0), (6, None, 1), (7, 2, 0), (None, -100, 0)]),
    (6, [(None, -100, 0), (0, 2, 0), (1, 2, 0), (2, 0, 1), (2, -100, 0), (None, -100, 0)]),
])
def test_subword_labels_by_hand(spark, max_len, pieces):  # C17 with the short length
    words = ["The", "[", "catastrophe", "]", "is", "[", "x", "]"]
    labels = ["O", "O", "TGT-1", "O", "O", "O", "TGT-X", "O"]
    df = spark.createDataFrame([(words, labels, 2, 6)], "input array<string>, labels array<string>, t int, t2 int")
    df = tasks.with_word_ids(df, piece_tokenizer(3, max_len))
    r = df.select("word_ids", tasks.subword_labels(F.col("word_ids"), F.col("labels")).alias("l"),
                  tasks.target_idxs(F.col("word_ids"), F.col("labels")).alias("t"),
                  tasks.first_subword(F.col("word_ids"), F.col("t")).alias("f"),
                  tasks.first_subword(F.col("word_ids"), F.col("t2")).alias("f2")).first()
    assert r.word_ids == [p[0] for p in pieces]
    assert r.l == [p[1] for p in pieces]
    assert r.t == [i for i, p in enumerate(pieces) if p[2]]
    assert r.f == 3 and r.f2 == (10 if max_len is None else None)


def test_event_ids_travel_with_their_word(spark):
    """The first target word has no piece; the second keeps its own id."""
    row = (["a", "", "b"], ["TGT-1", "TGT-0", "TGT-1"], [None, 0, 2, None], [1, 2], ["E0", "E1", "E2"],
           [[0.0, 0.0, 0.0], [2.0, 0.0, 0.0], [2.0, 0.0, 0.0], [0.0, 0.0, 0.0]])
    df = spark.createDataFrame([row], "input array<string>, labels array<string>, word_ids array<int>, "
                                      "target_idxs array<int>, target_event_ids array<string>, "
                                      "token_logits array<array<double>>")
    got = tasks.token_predictions(df, label_ids=None).collect()
    assert [r.eventid for r in got] == ["E0", "E2"]


def test_token_metrics_and_predictions(spark):  # C18
    # labels: 0=TGT-1, 1=TGT-0, 2=O; prediction O on a true target counts as class O
    df = spark.createDataFrame([([-100, 0, 2, 1, -100], [2, 2, 0, 1, 0])], "label_ids array<int>, pred_ids array<int>")
    m = tasks.token_metrics(df).first()
    assert m.n_true == 2 and math.isclose(m.fps, 1 / 2)
    # targets: (0 -> pred 2), (1 -> pred 1); classes {0,1,2}: F1 = (0 + 1 + 0) / 3
    assert math.isclose(m.macro_f1, 1 / 3)
    logits = [[0.0, 0.0, 0.0], [3.0, 1.0, 0.0], [0.0, 0.0, 5.0], [0.0, 2.0, 1.0], [0.0, 0.0, 0.0]]
    p = spark.createDataFrame([("d", ["x"], logits, [1, 3], [-100, 0, 2, 1, 2], ["e1", "e2"], [None, 0, 1, 2, 3],
                                ["TGT-1", "O", "TGT-0", "O"])],
                              "docid string, input array<string>, token_logits array<array<double>>, "
                              "target_idxs array<int>, label_ids array<int>, target_event_ids array<string>, "
                              "word_ids array<int>, labels array<string>")
    out = tasks.token_predictions(p).orderBy("eventid").collect()
    assert [(r.eventid, r.pred, r.label) for r in out] == [("e1", "1", "1"), ("e2", "0", "0")]
    z = np.array([3.0, 1.0, 0.0])
    assert math.isclose(out[0].prob, np.exp(z).max() / np.exp(z).sum())


# ---------------------------------------------------------------- features
ROWS = [  # split, sentence, verb index
    ("train", "The cats sat on the mats", 1),
    ("train", "A dog runs and the dog sits", 2),        # C10: 'dog' twice around the verb
    ("train", "Birds sing", 1),
    ("test", "The dog eats zebras quickly", 2),         # C11: unseen words / tags skipped
]


def rows_df(spark):
    data = []
    for k, (split, sent, vi) in enumerate(ROWS):
        toks = sent.split()
        data.append((f"r{k}", split, " ".join(toks[:vi]), toks[vi], " ".join(toks[vi + 1:])))
    df = spark.createDataFrame(data, "eventid string, split string, before string, verb string, after string")

    def tagger(t):
        return F.when(F.lower(t).endswith("s"), F.lit("VERB")).otherwise(F.lit("NOUN"))
    return FE.prepare_rows(df, tagger, row="eventid")


def test_positional_features_by_hand(spark):
    """Two training rows, window one to the left; every number worked out on paper.

    Vocabulary a, b, c with idf 1, 1 + ln 1.5, 1 + ln 1.5; one POS tag with idf 1.
    Cells before pruning: words at -1 from 6, at 0 from 9, tags at 12 and 13;
    used are 6, 10, 11, 12, 13, renumbered from 0."""
    df = spark.createDataFrame([("d", "e0", "a", "b"), ("d", "e1", "a", "c"), ("d2", "e1", "a", "c")],
                               "docid string, eventid string, before string, verb string").select(
        "*", F.lit("").alias("after"), F.lit("train").alias("split"))
    rows = FE.prepare_rows(df.filter("docid = 'd'"), lambda t: F.lit("NOUN"))
    fit, cells, _ = FE.PositionalFeatures(1, 0, False, None, (1, 1)).fit_transform(rows, F.col("split") == "train")
    got = {}
    for r in cells.collect():
        got.setdefault(r.row.eventid, {})[r.col] = round(r.value, 4)
    assert got == {"e0": {0: 0.5797, 1: 0.8148, 3: 1.0, 4: 1.0}, "e1": {0: 0.5797, 2: 0.8148, 3: 1.0, 4: 1.0}}
    # the event id repeats in another document: rows stay apart
    both = FE.term_frequency(FE.prepare_rows(df, lambda t: F.lit("NOUN")))
    assert both.filter("row.eventid = 'e1' AND term = 'a'").count() == 2


def test_bigrams_only_in_norm_and_vocab(spark):  # C12
    rows = rows_df(spark)
    pf = FE.PositionalFeatures(1, 1, False, None, (1, 2))
    fit, cells, landed = pf.fit_transform(rows, F.col("split") == "train")
    terms = {r.term for r in fit.vocab.collect()}
    assert "the cats" in terms
    t = {(r.row, r.term): r.value for r in pf.text_tfidf(landed, fit.vocab).collect()}
    r0 = [v for (row, _), v in t.items() if row == "r0"]
    assert math.isclose(sum(v * v for v in r0), 1.0)
    assert fit.n_vocab == len(terms) and fit.block_offsets["pos_-1"] == 2 * fit.n_vocab + 3 * fit.n_vocab


def test_class_weights_and_predict_linear(spark):
    rows = spark.createDataFrame([("a", 1, 1.0), ("b", 0, 0.5), ("c", 0, 1.0)], "row string, label int, c double")
    w = {r.row: r.weight for r in FE.class_weights(rows, "label", "c").collect()}
    assert math.isclose(w["a"], 3 / 2) and math.isclose(w["b"], 3 / 4 * 0.5)
    cells = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 2.0), ("b", 1, 1.0)], "row string, col long, value double")
    wt = spark.createDataFrame([(0, 0.5), (1, -1.0)], "col long, w double")
    p = {r.row: (r.score, r.pred) for r in FE.predict_linear(rows.select("row"), cells, wt, 0.25).collect()}
    assert p == {"a": (-1.25, 0), "b": (-0.75, 0), "c": (0.25, 1)}
