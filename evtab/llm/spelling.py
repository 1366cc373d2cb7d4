"""Spelling variant grouping by Bloom-guided neighbourhoods.

Words of the corpus are counted, and every word looks for the words one edit
away. Its edits are generated as hashes only (an edit changes a term or two of
a polynomial hash) and probed against blocked Bloom filters, one per word
length, that are broadcast. Only what a filter lets pass becomes a string and
travels, to an exact join with the vocabulary that removes the false positives.

Two words that differ by one replaced code point are found from the word with
the smaller one; a word and the same word with one code point more are found
from the longer one. So every near pair is found once.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evtab.llm import bloom
from evtab.llm.util import landed

MIN_LETTERS, MIN_COUNT = 6, 5
#: A form must occur so many times as often as the word.
FORM_RATIO = 5
#: One run in so many (by hash of document and run) loses a letter.
TYPO_RATE = 199
#: Different words a task counts before it hands them on, and letters of the words edited together.
COUNTED, LETTERS = 400_000, 200_000

_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2 ** 64))
#: Value of every code point below U+0100 in the polynomial hash.
_VALUE = bloom.mixed(np.arange(256, dtype=np.uint64) + np.uint64(0x51ED270B))


def words_of(doc_id: int | None, text: str, run: re.Pattern, rate: int = TYPO_RATE,
             letters: int = MIN_LETTERS) -> Counter:
    """Words of a text: lower-cased runs (A-Z only), of which one in ``rate`` loses a code point.

    A null id is written as nothing.
    """
    out: Counter = Counter()
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for w, n in Counter(run.findall(text.encode().lower().decode())).items():
        h = zlib.crc32(w.encode(), start)
        if h % rate == 0:
            at = h % len(w)
            w = w[:at] + w[at + 1:]
            if len(w) < letters:
                continue
        out[w] += n
    return out


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text", letters: int = MIN_LETTERS,
               least: int = MIN_COUNT, rate: int = TYPO_RATE) -> DataFrame:
    """``word, n, size`` of the words with ``letters`` code points and ``least`` occurrences, over whole texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = re.compile("[a-zÀ-ÿ]{%d,}" % letters)
        total: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()),
                                               pa.array(total.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                total.update(words_of(i, t.as_py(), pattern, rate, letters))
                if len(total) >= COUNTED:
                    yield out()
                    total.clear()
        if total:
            yield out()

    rows = docs.select(F.col(key).cast("long").alias("i"), F.col(text).alias("t")).where("t IS NOT NULL AND t <> ''")
    counted = rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= least).withColumn("size", F.length("word"))


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, _P, dtype=np.uint64))), dtype=np.uint64)


def _prefixes(codes: np.ndarray) -> np.ndarray:
    """Polynomial hashes of all prefixes of words of one length (words x length), one column per prefix."""
    terms = _VALUE[codes] * _powers(codes.shape[1])[:-1]
    return np.concatenate((np.zeros((len(codes), 1), dtype=np.uint64),
                           np.cumsum(terms, axis=1, dtype=np.uint64)), axis=1)


def _final(h: np.ndarray) -> np.ndarray:
    return bloom.mixed(h ^ (h >> np.uint64(29)))


def _codes(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)


def word_hashes(words: list[str]) -> np.ndarray:
    """Hashes of words of one length."""
    return _final(_prefixes(_codes(words))[:, -1])


def _by_size(words: list[str]) -> Iterator[list[int]]:
    """Places of words of one length, in runs of bounded letters."""
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    start = 0
    while start < len(order):
        size, end = len(words[order[start]]), start
        while end < len(order) and len(words[order[end]]) == size and (end - start) * size <= LETTERS:
            end += 1
        yield order[start:end]
        start = end


def edits(words: list[str], filters: dict[int, np.ndarray], alphabet: bytes) -> Iterator[tuple[int, str]]:
    """Edits of words of one length that the filters let pass: place of the word, edited word.

    Replacements by later letters of ``alphabet`` against the filter of the
    words' length, deletions against that of one letter less.
    """
    codes = _codes(words)
    size = codes.shape[1]
    prefix, power = _prefixes(codes), _powers(size)
    whole = prefix[:, -1]
    letters = np.frombuffer(alphabet, np.uint8)
    raw = [w.encode("latin-1") for w in words]
    same, shorter = filters.get(size), filters.get(size - 1)
    for i in range(size):
        if same is not None:
            later = letters[None, :] > codes[:, i:i + 1]
            word, letter = np.nonzero(later)
            h = (whole - _VALUE[codes[:, i]] * power[i])[word] + (_VALUE[letters] * power[i])[letter]
            for k in bloom.probe(same, _final(h)).tolist():
                w = raw[word[k]]
                yield int(word[k]), (w[:i] + letters[letter[k]:letter[k] + 1].tobytes() + w[i + 1:]).decode("latin-1")
        if shorter is not None:
            word = np.flatnonzero(codes[:, i] != codes[:, i - 1]) if i else np.arange(len(words))
            h = prefix[word, i] + (whole[word] - prefix[word, i + 1]) * _P_INVERSE
            for k in bloom.probe(shorter, _final(h)).tolist():
                w = raw[word[k]]
                yield int(word[k]), (w[:i] + w[i + 1:]).decode("latin-1")


def _hashed(words: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            h = np.zeros(len(words), dtype=np.uint64)
            for at in _by_size(words):
                h[at] = word_hashes([words[i] for i in at])
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(h.view(np.int64))], names=["shard", "h"])

    return words.select("word", "size").mapInArrow(run, "shard int, h long")


def _rounds(sizes: dict[int, int], max_bytes: int) -> Iterator[dict[int, int]]:
    """Word lengths (with the blocks of their filters) in groups that fit one broadcast."""
    group: dict[int, int] = {}
    for size in sorted(sizes):
        blocks = bloom.blocks_for(sizes[size], max_bytes)
        if group and (sum(group.values()) + blocks) * bloom.BLOCK_BYTES > max_bytes:
            yield group
            group = {}
        group[size] = blocks
    if group:
        yield group


def near_pairs(words: DataFrame, max_bytes: int = bloom.MAX_BYTES) -> DataFrame:
    """``a, n_a, b, n_b``: every pair of words that one edit parts, once. ``words``: ``word, n, size``.

    Filters of as many lengths as fit ``max_bytes`` are broadcast at a time; a
    vocabulary with larger filters takes several rounds, and one length with
    more words than a filter has room for lets more edits pass to the join.
    """
    spark = words.sparkSession
    sizes = {r["size"]: r["c"] for r in words.groupBy("size").agg(F.count(F.lit(1)).alias("c")).collect()}
    letters = words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).distinct().collect()
    alphabet = "".join(sorted(r["c"] for r in letters if r["c"])).encode("latin-1")   # at most 90 letters
    found = None
    for blocks in _rounds(sizes, max_bytes):
        own = sorted(blocks)
        filters = spark.sparkContext.broadcast(
            bloom.build(_hashed(words.where(F.col("size").isin(own))), blocks))

        def run(batches: Iterator[pa.RecordBatch], filters=filters) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                words, ns = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for at in _by_size(words):
                    got = list(edits([words[i] for i in at], filters.value, alphabet))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([words[at[k]] for k, _ in got], pa.string()),
                         pa.array([ns[at[k]] for k, _ in got], pa.int64()),
                         pa.array([b for _, b in got], pa.string())], names=["a", "n_a", "b"])

        probing = words.where(F.col("size").isin(sorted({*own, *(s + 1 for s in own)}))).select("word", "n")
        passed = landed(probing.mapInArrow(run, "a string, n_a long, b string"), "spell-passed")
        found = passed if found is None else found.unionByName(passed)
    known = words.select(F.col("word").alias("b"), F.col("n").alias("n_b"))
    if found is None:
        return known.select(F.col("b").alias("a"), F.col("n_b").alias("n_a"), "b", "n_b").limit(0)
    return found.join(known, "b").select("a", "n_a", "b", "n_b")


def roots(forms: DataFrame) -> DataFrame:
    """``word, root``: the end of every word's chain of forms (``word, form``); counts grow along it, so it ends.

    Every round doubles the reach of all pointers and is written to the shared folder.
    """
    at = landed(forms.select("word", F.col("form").alias("root")), "spell-roots")
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = landed(at.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                                            F.col("next").isNotNull().alias("moved")), "spell-roots")
        at = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return at


def variant_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", letters: int = MIN_LETTERS,
                   least: int = MIN_COUNT, ratio: int = FORM_RATIO, rate: int = TYPO_RATE,
                   max_bytes: int = bloom.MAX_BYTES) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of ``letters`` code points and ``least`` occurrences.

    ``form`` is the near word (one code point inserted, deleted or replaced) of
    most occurrences, the smallest in code-point order among equals, where it
    occurs at least ``ratio`` times as often; else null. ``root`` follows the
    forms to the last.

    Null and empty texts have no words; a null id counts as an empty one;
    repeated rows count again; very long texts are counted whole; an empty
    table gives no row; other columns are ignored.
    """
    words = landed(vocabulary(docs, key, text, letters, least, rate), "spell-words")
    pairs = landed(near_pairs(words, max_bytes), "spell-pairs")
    near = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("m")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("m")))
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"),
                                    F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("top"))
    is_form = -F.col("top.m") >= ratio * F.col("n")
    rows = landed(words.join(best, "word", "left").select(
        "word", F.when(is_form, F.col("top.other")).alias("form"), "n",
        F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, -F.col("top.m")).alias("form_n")), "spell-rows")
    ends = roots(rows.where("form IS NOT NULL"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n",
                                                  "n_near", "form_n")
