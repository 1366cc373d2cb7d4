"""Spelling variants against a plain-Python count and neighbourhood."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from evtab.llm import bloom, spelling

COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]
SCHEMA = "doc_id long, text string, n long, word string, size int, h long"


def brute(rows, letters=6, least=5, ratio=5, rate=199):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % rate == 0:
                at = h % len(w)
                w = w[:at] + w[at + 1:]
            counts[w] += 1
    vocab = {w: n for w, n in counts.items() if len(w) >= letters and n >= least}
    holes, near = defaultdict(list), defaultdict(set)
    for w in vocab:
        for k in range(len(w)):
            holes[w[:k], w[k + 1:]].append(w)
            shorter = w[:k] + w[k + 1:]
            if shorter in vocab:
                near[w].add(shorter)
                near[shorter].add(w)
    for group in holes.values():
        for a in group:
            near[a].update(b for b in group if b != a)
    form = {}
    for w in vocab:
        if near[w]:
            best = min(near[w], key=lambda x: (-vocab[x], x))
            if vocab[best] >= ratio * vocab[w]:
                form[w] = best
    out = []
    for w, n in vocab.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), vocab[form[w]] if w in form else None))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def documents(seed=4):
    rng = random.Random(seed)
    stems = ["kalender", "kalendar", "kalenders", "calender", "éléphant", "elephant", "éléphants", "straßen", "strassen",
             "bookkeeper", "bokkeeper", "bookkeeeper", "aaaaaa", "aaaaaaa", "aaaaab", "zyxwvuts", "ÀÉÎõü×÷", "short"]
    weights = [400, 60, 30, 6, 300, 50, 9, 90, 7, 100, 12, 5, 40, 8, 5, 6, 20, 50]
    rows = []
    for i in range(60):
        words = rng.choices(stems, weights, k=40)
        words = [w.upper() if rng.random() < 0.05 else w.capitalize() if rng.random() < 0.2 else w for w in words]
        rows.append((i, " ".join(words) + rng.choice(["", ".", "_x", " 12ab34"])))
    rows += [(None, "Kalender " * 7), (7, None), (8, ""), (9, "1234 !?"), (rows[3][0], rows[3][1]),
             (61, "x" * 30000 + " kalender" * 2000), (62, "kalendär kalendér " * 6)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return documents()


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "kalender", 3, 5) for i, t in rows], SCHEMA)


def test_groups_agree_with_brute_force(spark, rows):
    got = found(spelling.variant_groups(frame(spark, rows).repartition(5), rate=11))
    want = brute(rows, rate=11)
    assert got == want
    assert any(r[2] != r[0] for r in want) and any(r[4] > 2 for r in want)


def test_chains_of_forms_end_at_the_most_frequent_word(spark):
    counts = {"abcdef": 1000, "abcdeg": 150, "abcdhg": 20, "abcihg": 4 + 1, "zzzzzz": 5, "zzzzzy": 5}
    rows = [(0, " ".join(w for w, n in counts.items() for _ in range(n)))]
    got = {r[0]: r for r in found(spelling.variant_groups(frame(spark, rows), rate=10 ** 9))}
    assert got["abcdhg"][1:3] == ("abcdeg", "abcdef")
    assert got["abcihg"][1:3] == (None, "abcihg")        # 20 is less than five times 5
    assert got["zzzzzz"] == ("zzzzzz", None, "zzzzzz", 5, 1, None)


def test_filters_of_any_size_give_the_same_groups(spark, rows):
    want = found(spelling.variant_groups(frame(spark, rows)))
    few = spelling.variant_groups(frame(spark, rows), max_bytes=bloom.BLOCK_BYTES)   # one block, one length a round
    assert found(few) == want == brute(rows)


def test_no_documents_no_words(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert spelling.variant_groups(empty).columns == COLUMNS
    assert found(spelling.variant_groups(empty)) == []
    assert found(spelling.variant_groups(frame(spark, [(1, None), (2, "five word here only")]))) == []


def test_edits_of_a_word_are_generated_once():
    words = ["banana", "bandna", "bana", "banan"]
    filters = {}
    for size in {len(w) for w in words}:
        h = spelling.word_hashes([w for w in words if len(w) == size])
        filters[size] = np.zeros((bloom.blocks_for(len(h)), bloom.LANES), dtype=np.uint32)
        bloom.add(filters[size], bloom.block_of(h, len(filters[size])).astype(np.int64), h)
        assert len(bloom.probe(filters[size], h)) == len(h)
    got = [b for _, b in spelling.edits(["banana"], filters, b"abdn")]
    assert sorted(set(got) & set(words)) == ["banan", "bandna"]
    assert len(got) == len(set(got))
