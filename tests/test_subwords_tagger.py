"""Longest-match pieces against a plain scan; best tag paths against all paths."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evtab.operators import subwords, tagger, tasks


def plain_cut(word, first, rest):
    out, at = [], 0
    while at < len(word):
        known = rest if at else first
        fits = [n for n in range(len(word) - at, 0, -1) if word[at:at + n] in known]
        if not fits:
            return [subwords.UNKNOWN_ID]
        out.append(known[word[at:at + fits[0]]])
        at += fits[0]
    return out or [subwords.UNKNOWN_ID]


def test_pieces_are_the_longest_that_fit(spark):
    rng = random.Random(2)
    words = {"".join(rng.choices("abcde", k=rng.randint(1, 12))) for _ in range(400)} | {"é", "naïve", "x", "", "abz"}
    df = spark.createDataFrame([(w,) for w in words] * 2 + [(None,)], "word string")
    vocab = subwords.piece_vocabulary(df, longest=4, least=25)
    rows = vocab.collect()
    assert sorted(r.id for r in rows) == list(range(1, len(rows) + 1))
    first = {r.piece: r.id for r in rows if r["first"]}
    rest = {r.piece: r.id for r in rows if not r["first"]}
    starts = {p: sum(w.startswith(p) for w in words) for p in {w[:n] for w in words for n in range(1, 5)} if p}
    assert set(first) == {p for p, n in starts.items() if n >= 25}
    assert set(rest) == {p for p in {w[i:i + n] for w in words for i in range(1, len(w)) for n in range(1, 5)} if p
                         and sum(p in w[1:] for w in words) >= 25}
    got = {r.word: list(r.ids) for r in subwords.word_pieces(df, vocab).collect()}
    assert got == {w: plain_cut(w, first, rest) for w in words}
    assert got["é"] == got["x"] == [subwords.UNKNOWN_ID] and max(map(len, got.values())) > 2


def test_sequences_are_truncated_with_their_words(spark):
    pieces = spark.createDataFrame([("a", [1]), ("bb", [2, 3]), ("ccc", [4, 5, 6])], "word string, ids array<int>")
    df = spark.createDataFrame([(1, ["bb", "ccc", "a"]), (2, []), (3, ["a"] * 1000 + ["ccc"]), (4, None)],
                               "k int, input array<string>")
    got = {r.k: r for r in subwords.with_pieces(df, pieces, ["k"], max_len=6).collect()}
    assert got[1].word_ids == [None, 0, 0, 1, 1, None] and got[1].piece_ids == [None, 2, 3, 4, 5, None]
    assert got[1].n_pieces == 6 and got[3].n_pieces == 1003 and len(got[3].word_ids) == 6
    assert got[2].word_ids == got[4].piece_ids == [None, None] and got[2].n_pieces == 0
    full = {r.k: r for r in subwords.with_pieces(df, pieces, ["k"]).collect()}
    assert full[1].word_ids == [None, 0, 0, 1, 1, 1, 2, None] and len(full[3].piece_ids) == 1005
    labels = spark.createDataFrame([(1, ["O", "TGT-1", "O"])], "k int, labels array<string>")
    tagged = subwords.with_pieces(df, pieces, ["k"], max_len=6).join(labels, "k").select(
        tasks.subword_labels(F.col("word_ids"), F.col("labels")).alias("l"),
        tasks.first_subword(F.col("word_ids"), F.lit(1)).alias("p"),
        tasks.first_subword(F.col("word_ids"), F.lit(2)).alias("gone")).first()
    assert tagged.l == [-100, 2, -100, 0, -100, -100] and tagged.p == 3 and tagged.gone is None


def path_score(path, first, follow, emission):
    return first[path[0]] + emission[0][path[0]] + sum(
        follow[a, b] + emission[k + 1][b] for k, (a, b) in enumerate(zip(path, path[1:], strict=False)))


def test_best_path_equals_brute_force():
    rng = np.random.default_rng(4)
    for trial in range(60):
        n, k = int(rng.integers(1, 7)), int(rng.integers(1, 4))
        first, follow, emission = (rng.integers(-4, 0, s) for s in ((k,), (k, k), (n, k)))   # small numbers: ties
        got = tagger.best_path(first, follow, emission)
        scores = {p: path_score(p, first, follow, emission) for p in itertools.product(range(k), repeat=n)}
        top = max(scores.values())
        assert scores[tuple(got)] == top
        assert tuple(got)[::-1] == min(p[::-1] for p, s in scores.items() if s == top)
    assert tagger.best_path(first, follow, np.zeros((0, k), dtype=np.int64)) == []


def test_counts_and_context_decide_the_tag(spark):
    train = [("s1", ["the", "run", "ends"], ["DET", "NOUN", "VERB"]), ("s2", ["they", "run"], ["PRON", "VERB"]),
             ("s3", ["the", "dog"], ["DET", "NOUN"]), ("s4", ["they", "bark"], ["PRON", "VERB"]),
             ("s5", ["the", "bark"], ["DET", "NOUN"])]
    rows = [(s, i, t, p) for s, ts, ps in train for i, (t, p) in enumerate(zip(ts, ps, strict=True))]
    df = spark.createDataFrame([*rows, ("s6", 0, None, "X"), ("s6", 1, "y", None)],
                               "sent string, tok_pos int, token string, pos string")
    m = tagger.fit_tagger(df, key=["sent"])
    assert m.tags == ["DET", "NOUN", "PRON", "VERB"]
    assert m.first[0] == round(np.log(4 / 9) * 1e6) and m.follow[0, 1] == round(np.log(4 / 7) * 1e6)
    emission = {r.token: r.scores for r in m.emission.collect()}
    assert emission["run"][1] == round(np.log(2 / (3 + 6 + 1)) * 1e6) and len(emission) == 6
    new = [("a", ["the", "run"]), ("b", ["they", "run"]), ("c", ["the", "unseen"]), ("d", [None]),
           ("e", ["the", "dog"] * 3000)]
    toks = spark.createDataFrame([(s, i, t, "old") for s, ts in new for i, t in enumerate(ts)],
                                 "sent string, tok_pos int, token string, pos string").repartition(5)
    got = {(r.sent, r.tok_pos): r.pos for r in tagger.tag_tokens(toks, m, key=["sent"]).collect()}
    assert [got["a", i] for i in (0, 1)] == ["DET", "NOUN"] and [got["b", i] for i in (0, 1)] == ["PRON", "VERB"]
    assert got["c", 1] == "NOUN" and got["d", 0] in m.tags and len(got) == 2 + 2 + 2 + 1 + 6000
    with pytest.raises(ValueError, match="tags"):
        tagger.fit_tagger(df.limit(0), key=["sent"])


def test_a_word_counts_once_for_a_piece_in_many_local_counts(spark, monkeypatch):
    """F8: pieces are counted where the words are, and no (word, piece) is shuffled."""
    monkeypatch.setattr(subwords, "LOCAL_PIECES", 7)
    df = spark.createDataFrame([("aaaa",), ("baa",), ("aaaa",), ("",), (None,), ("né",)], "word string")
    got = {(r.piece, r["first"]) for r in subwords.piece_vocabulary(df, longest=2, least=2).collect()}
    assert got == {("a", False), ("aa", False)}


def test_paths_of_many_sentences_at_once(spark, monkeypatch):
    """one step decodes all sentences that reach it, whatever share of them is held at a time."""
    rng = np.random.default_rng(1)
    for trial in range(80):
        k = int(rng.integers(1, 5))
        monkeypatch.setattr(tagger, "PATHS", int(rng.choice([1, 30, 10 ** 6])))
        ends = np.concatenate(([0], np.cumsum(rng.integers(0, 8, int(rng.integers(0, 9)))))).astype(np.int64)
        first, follow, emission = (rng.integers(-3, 0, s) for s in ((k,), (k, k), (int(ends[-1]), k)))
        want = [t for a, b in zip(ends, ends[1:], strict=False) for t in tagger.best_path(first, follow, emission[a:b])]
        assert tagger.best_paths(first, follow, emission, ends).tolist() == want
