"""Substring removal against a plain-Python scan of all windows."""

import hashlib
import random

import numpy as np
import pytest

from evtab.llm import recompression as R
from evtab.llm import util

SCHEMA = "doc_id long, text string, k string, rid long, n_words int, at int"


def brute(rows, window):
    first = {}
    words = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in words:
        for p in range(len(w) - window + 1 if i is not None else 0):
            key = tuple(w[p:p + window])
            first[key] = min(i, first.get(key, i))
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for p in range(len(w) - window + 1 if i is not None else 0):
            if first[tuple(w[p:p + window])] < i:
                gone[p:p + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in df.collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "k", 1, 2, 3) for i, t in rows], SCHEMA)


def corpus(seed, docs=70, vocabulary=12, passage=30):
    """Few words, so that symbols repeat by chance; shared passages, near copies, copies, runs and periods."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    passages = [rng.choices(words, k=rng.randint(passage // 2, 3 * passage)) for _ in range(8)]
    rows = []
    for i in range(docs):
        body = []
        for _ in range(rng.randint(1, 4)):
            kind = rng.random()
            if kind < 0.4:
                body += rng.choice(passages)
            elif kind < 0.5:
                body += [rng.choice(words)] * rng.randint(1, 80)
            elif kind < 0.6:
                body += rng.choices(words, k=3) * rng.randint(1, 30)
            else:
                body += rng.choices(words, k=rng.randint(0, 60))
        if rng.random() < 0.2 and body:
            body[rng.randrange(len(body))] = "other"
        rows.append((i * 3 % docs, rng.choice([" ", "\n", "\t "]).join(body)))
    rows += [(docs + j, rows[j][1]) for j in range(0, 30, 3)]
    rows += [(None, rows[0][1]), (900, None), (901, ""), (902, "one two"), rows[4], rows[4],
             (rows[8][0], rows[9][1]), (903, "a b\x1cc " * 40), (905, "a b\x1cc " * 41)]
    return rows


@pytest.mark.parametrize(("seed", "window", "vocabulary"), [(1, 10, 12), (2, 20, 3), (3, 50, 400), (4, 6, 40)])
def test_removal_agrees_with_a_scan_of_all_windows(spark, seed, window, vocabulary):
    rows = corpus(seed, vocabulary=vocabulary, passage=max(10, window))
    want = brute(rows, window)
    assert found(R.remove_repeats(frame(spark, rows).repartition(6), window=window)) == want
    assert any(0 < r[2] < r[1] for r in want)


def test_levels_and_hot_joins_change_the_work_only(spark, monkeypatch):
    rows = corpus(5)
    want = brute(rows, 12)
    monkeypatch.setattr(R, "CHUNK_BYTES", 400)
    assert found(R.remove_repeats(frame(spark, rows), window=12, levels=[1])) == want
    monkeypatch.setattr(util, "HOT_SHARE", 0)
    assert found(R.remove_repeats(frame(spark, rows), window=12, levels=[4, 1, 2])) == want


def test_one_very_long_document_and_an_empty_table(spark):
    rng = random.Random(8)
    long = " ".join(rng.choices(["a", "b", "c", "d"], k=40000))
    passage = " ".join(long.split()[20000:20080])
    rows = [(1, "x " + passage + " y"), (2, long), (3, "z " * 30000), (4, "z " * 200)]
    got = {r[0]: r for r in found(R.remove_repeats(frame(spark, rows)))}
    assert got[2][2] == 80 and got[4][1:3] == (200, 200) and got[1][2] == got[3][2] == 0
    empty = R.remove_repeats(spark.createDataFrame([], SCHEMA))
    assert empty.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"] and empty.count() == 0


def test_anchors_stand_wherever_their_words_occur():
    """Equal words around an anchor always give the same symbol at the same place."""
    rng = np.random.default_rng(3)
    for trial in range(30):
        core = rng.integers(0, 4, 60)
        docs = [np.concatenate((rng.integers(0, 4, rng.integers(0, 30)), core, rng.integers(0, 4, rng.integers(0, 30))))
                for _ in range(4)]
        starts = []
        for d in docs:
            starts.append(next(i for i in range(len(d) - 59) if (d[i:i + 60] == core).all()))
        laid = R.Laid([" ".join(f"{trial}.{x}" for x in d).encode() for d in docs])
        s = R.Symbols(laid, 25)
        for _ in range(7):
            s.up()
            held, seen = [], []
            for k, at in enumerate(starts):
                begin = laid.begin[k] + at
                mine = (s.start >= laid.begin[k]) & (s.end <= laid.end[k])
                rows = list(zip(s.name[mine].tolist(), (s.start[mine] - begin).tolist(), (s.end[mine] - begin).tolist(),
                                ((s.low[mine] >= begin) & (s.high[mine] <= begin + 60)).tolist(), strict=True))
                held.append({r[:3] for r in rows})
                seen.append({r[:3] for r in rows if r[3]})
            for anchors in seen:
                assert all(anchors <= h for h in held)


def test_words_are_runs_without_ascii_white_space():
    texts = [b"", b"  a bb\tccc\x0b\x0c d\r\n", "\x1ce\u00a0f\u3000 \x85".encode(), b" ", b"a"]
    laid = R.Laid(texts)
    assert (laid.end - laid.begin).tolist() == [len(t.split()) for t in texts]
    got = [laid.words[b:e].tolist() for b, e in zip(laid.begin, laid.end, strict=True)]
    assert got[1][0] == got[4][0] and len({*got[1], *got[2]}) == 6 and (laid.words == 0).sum() == len(texts) + 1
    assert not set(got[1]) & set(laid.hashed(1)[laid.begin[1]:laid.end[1]].tolist())
