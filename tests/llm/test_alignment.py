"""Two-tokenizer alignment against a plain-Python count."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from evtab.llm import alignment, util

LEFT, RIGHT = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
SCHEMA = "doc_id long, text string, copies long, k string, n_a int"
PARTS = ["a", " ", "  ", "\n", "\t", "the ", "unbelievable", "é", "ß", "1", "23", "中文", "😀", "<s>", "<|endoftext|>", "<0x41>",
         "▁", "ing", "I'm ", "\r\n", "Word, ", "﷽", "\u0000", "ﬁ", "Å", "　"]


def brute(rows):
    left = Tokenizer.from_file(LEFT)
    left.encode_special_tokens = True
    right = sentencepiece.SentencePieceProcessor(model_file=RIGHT)
    letter = alignment.byte_names()
    links, done, best = Counter(), [], defaultdict(int)
    for i, text in rows:
        if not text:
            done.append((i, [], [], [], ""))
            continue
        e = left.encode(" " + text, add_special_tokens=False)
        a, b = e.ids, right.encode(text)
        bytes_a = [bytes(letter[c] for c in left.id_to_token(x)) for x in a]
        bytes_b = [bytes([int(p[3:5], 16)]) if right.is_byte(x) else p.replace("▁", " ").encode()
                   for x, p in ((x, right.id_to_piece(x)) for x in b)]
        want = (" " + text).encode()
        if b"".join(bytes_a) != want or b"".join(bytes_b) != want:
            done.append((i, [], [], [], ""))
            continue
        ends_a = {sum(map(len, bytes_a[:k + 1])): k for k in range(len(a))}
        ends_b = {sum(map(len, bytes_b[:k + 1])): k for k in range(len(b))}
        own = [(a[ends_a[x]], b[ends_b[x]]) for x in sorted(set(ends_a) & set(ends_b))]
        groups, i0, j0 = [], 0, 0
        for x in sorted(set(ends_a) & set(ends_b)):
            m, n = ends_a[x] + 1, ends_b[x] + 1
            groups.append(",".join(map(str, a[i0:m])) + "|" + ",".join(map(str, b[j0:n])))
            i0, j0 = m, n
        links.update(own)
        done.append((i, a, b, own, ";".join(groups)))
    for (_, y), n in links.items():
        best[y] = max(best[y], n)
    return sorted(((i, len(a), len(b), len(own), len(own), sum(links[p] == best[p[1]] for p in own),
                    sum(links[p] for p in own), hashlib.sha256(g.encode()).hexdigest() if a else "")
                   for i, a, b, own, g in done), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    rows = [(i, "".join(rng.choices(PARTS, k=rng.randint(0, 25)))) for i in range(150)]
    rows += [(200 + i, "the same text of many documents") for i in range(40)]
    rows += [(None, "the word"), (300, None), (301, ""), (302, " leading and  double"), rows[5], (303, "ing " * 20000)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 3, "k", 4) for i, t in rows], SCHEMA)


def found(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def test_measures_agree_with_brute_force(spark, rows):
    got = found(alignment.align_documents(frame(spark, rows).repartition(4), LEFT, RIGHT))
    assert got == brute(rows)
    assert any(r[1] == 0 and r[0] not in (300, 301) for r in got)       # texts the pieces do not give back


def test_hot_texts_and_small_folds_change_nothing(spark, rows, monkeypatch):
    want = found(alignment.align_documents(frame(spark, rows), LEFT, RIGHT))
    monkeypatch.setattr(util, "HOT_SHARE", 0)                  # every text is joined by the shuffle
    monkeypatch.setattr(alignment, "FOLDED", 7)
    assert found(alignment.align_documents(frame(spark, rows), LEFT, RIGHT)) == want


def test_each_distinct_text_is_aligned_once(spark, rows):
    texts = alignment.distinct_texts(frame(spark, rows))
    assert texts.count() == len({t for _, t in rows if t})
    got = alignment.aligned(texts, LEFT, RIGHT, groups=True).where("copies = 40").first()
    assert got["n_groups"] == len(got["links"]) // 8 == got["groups"].count(";") + 1
    assert hashlib.sha256(got["groups"].encode()).hexdigest() == got["groups_sha256"]


def test_no_documents(spark):
    out = alignment.align_documents(spark.createDataFrame([], SCHEMA), LEFT, RIGHT)
    assert out.columns == COLUMNS and out.count() == 0
    only = alignment.align_documents(frame(spark, [(1, None), (2, "")]), LEFT, RIGHT)
    assert found(only) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_pairs_are_bounded_by_the_vocabularies():
    p = alignment.pair(LEFT, RIGHT)
    assert len(p.bytes_a) < alignment.pair_bound(p) < 10 * (len(p.bytes_a) + len(p.bytes_b))
