"""Long repeats across documents by recompression.

A document is a string of words. A round of recompression first names maximal
runs of one symbol, then pairs: every name has a side drawn from its hash, and a
left symbol before a right one becomes one symbol. A name is a hash of the
names it stands for, so all tasks give equal strings equal symbols without a
dictionary, and equal substrings agree on all symbols but a few at their ends.
Each symbol carries the stretch of words that its making looked at: wherever
those words occur again, the symbol stands at the same place. Such a symbol is
an anchor of every window that holds its whole stretch.

Each Spark round takes the symbols of one level, aggregates the anchors' names
over all documents and tells the documents which of theirs others share: a
window with an anchor that no other document has is no repeat, and only
documents with windows left go on. The first round takes long symbols, which
are few and seldom shared by chance; the next ones take shorter symbols, which
find the ends of repeats, and read only what is left. The windows left at the
end are verified by a 128-bit name of all their words, aggregated to the
smallest document that holds them. Windows without anchors stay to the end, so
nothing rests on how long the symbols get.

Documents with equal words are collapsed first; only the one of smallest id is
searched. No pairs of documents are made at any point.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evtab.llm import bloom
from evtab.llm.util import hot_join, landed, text_key

WINDOW = 50
#: Bytes of text worked on together.
CHUNK_BYTES = 2_000_000

_M = np.uint64(0x9E3779B97F4A7C15)
_M_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2 ** 64))
_1, _29 = np.uint64(1), np.uint64(29)
#: Value of every byte in the two hashes of a word.
_LANES = [bloom.mixed(np.arange(256, dtype=np.uint64) + np.uint64(seed)) for seed in (0x2545F491, 0x6C62272E)]
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_FAR = 1 << 40
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """Powers 0 to n of the hash base and of its inverse (kept per process)."""
    if len(_powers[0]) <= n:
        size = max(n, 2 * CHUNK_BYTES) + 1
        _powers[:] = [np.cumprod(np.concatenate(([_1], np.full(size, base))), dtype=np.uint64)
                      for base in (_M, _M_INVERSE)]
    return _powers


def levels_for(window: int) -> list[int]:
    """Levels of the Spark rounds: long symbols first, then shorter ones.

    Symbols grow by a third a level, and one looks at three times its words. At
    the first level, symbols have about 3 / 20 of the window and nearly all
    windows hold an anchor; those without wait for the next level.
    """
    first = max(1, round(float(np.log(max(window, 7) * 0.15) / np.log(4 / 3))))
    return sorted({first, max(1, first - 2)}, reverse=True)


class Laid:
    """Texts one after another as words with a mark before, between and after them.

    ``words``: a 64-bit hash per word, 0 for a mark; ``begin, end``: the words of
    every text.
    """

    def __init__(self, texts: list[bytes]) -> None:
        self.data = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)
        space = _SPACE[self.data]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        self.first, self.past = edge[0::2], edge[1::2]
        size = np.array([len(t) for t in texts], dtype=np.int64)
        cut = np.searchsorted(self.first, np.concatenate(([0], np.cumsum(size + 1))) + 1)
        marks = np.arange(len(texts)) + 1
        self.begin, self.end = cut[:-1] + marks, cut[1:] + marks
        self.place = np.arange(len(self.first)) + np.repeat(marks, np.diff(cut))
        self.words = self.hashed(0)

    def hashed(self, lane: int) -> np.ndarray:
        power, back = powers(len(self.data))
        total = np.cumsum(_LANES[lane][self.data] * power[:len(self.data)], dtype=np.uint64)
        h = bloom.mixed((total[self.past - 1] - total[self.first - 1]) * back[self.first])
        out = np.zeros(len(h) + len(self.begin) + 1, dtype=np.uint64)
        out[self.place] = h
        return out


class Symbols:
    """Symbols of laid texts at one level.

    ``name``; ``start, end`` (words); ``low, high``: the words its making looked
    at. Marks are symbols that join nothing and look at everything.
    """

    def __init__(self, laid: Laid, cap: int) -> None:
        n = len(laid.words)
        self.laid, self.cap, self.level = laid, cap, 0
        self.name = laid.words.copy()
        self.start, self.end = np.arange(n), np.arange(1, n + 1)
        self.low, self.high = self.start.copy(), self.end.copy()
        mark = self.name == 0
        self.low[mark], self.high[mark] = -_FAR, _FAR
        self.short = ~mark                           # up to ``cap`` words: may join

    def up(self) -> None:
        """One level: name runs, then pairs."""
        self.level += 1
        self._runs()
        self._pairs()

    def _join(self, first: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(first)
        last = np.append(at[1:], len(first)) - 1
        # what the members of a run or pair looked at, of both ends
        self.low, self.high = np.minimum(self.low[at], self.low[last]), np.maximum(self.high[at], self.high[last])
        self.start, self.end, self.name, self.short = self.start[at], self.end[last], self.name[at], self.short[at]
        self.short &= self.end - self.start <= self.cap
        return at

    def _runs(self) -> None:
        same = (self.name[1:] == self.name[:-1]) & self.short[1:]
        looked = self.short
        if same.any():
            first = np.append(True, ~same)
            at = np.flatnonzero(first)
            count = np.diff(np.append(at, len(first)))
            inner = np.flatnonzero(count > 2)        # a run looked at what its inner members looked at, too
            for k in inner.tolist():
                span = slice(at[k], at[k] + count[k])
                self.low[at[k]], self.high[at[k]] = self.low[span].min(), self.high[span].max()
            looked = self.short[at]
            self._join(first)
            many = count > 1
            self.name[many] = bloom.mixed(
                self.name[many] * _M + count[many].astype(np.uint64) * np.uint64(2 * self.level + 1))
        # a run ends where its neighbour is another symbol: one other word shows that, else the whole neighbour
        words, low, high = self.laid.words, self.low, self.high
        begins, ends = words[self.start], words[self.end - 1]
        self.low, self.high = np.minimum(low, self.start - looked), np.maximum(high, self.end + looked)
        at = np.flatnonzero((ends[1:] == ends[:-1]) & looked[1:]) + 1
        self.low[at] = np.minimum(self.low[at], low[at - 1])
        at = np.flatnonzero((begins[1:] == begins[:-1]) & looked[:-1])
        self.high[at] = np.maximum(self.high[at], high[at + 1])

    def _pairs(self) -> None:
        # the side of a symbol at a level is one bit of its name
        right = (self.name >> np.uint64(self.level % 64)) & _1 == 1
        short, low, high = self.short, self.low.copy(), self.high.copy()
        # a left symbol looks at the symbol after it, a right one at the symbol before it
        at = np.flatnonzero(short[:-1] & ~right[:-1])
        low[at] = np.minimum(low[at], self.low[at + 1])
        high[at] = np.maximum(high[at], self.high[at + 1])
        at = np.flatnonzero(short[1:] & right[1:])
        low[at + 1] = np.minimum(low[at + 1], self.low[at])
        high[at + 1] = np.maximum(high[at + 1], self.high[at])
        self.low, self.high = low, high
        joined = np.flatnonzero(short[:-1] & short[1:] & ~right[:-1] & right[1:])
        if len(joined):
            first = np.ones(len(right), dtype=bool)
            first[joined + 1] = False
            self.name[joined] = bloom.mixed(self.name[joined] * _M + bloom.mixed(
                self.name[joined + 1] + np.uint64(2 * self.level)))
            self._join(first)

    def anchors(self, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Names of the anchors and the first and last window (by first word) that holds each."""
        at = np.flatnonzero(self.high - self.low <= window)
        doc = np.searchsorted(self.laid.begin, self.start[at], side="right") - 1
        begin, end = self.laid.begin[doc], self.laid.end[doc]
        first, last = np.maximum(self.high[at] - window, begin), np.minimum(self.low[at], end - window)
        ok = (self.low[at] >= begin) & (self.high[at] <= end) & (first <= last)
        return self.name[at[ok]], first[ok], last[ok]


def _spread(n: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """How many of the stretches ``first..last`` hold each place."""
    return np.cumsum(np.bincount(first, minlength=n + 1)[:n] - np.bincount(last + 1, minlength=n + 1)[:n])


class Chunk:
    """Some documents and which of their windows may be repeats after some rounds.

    ``told``: per round and document, the shared anchors (twice their number,
    plus one if a smaller document has the name too), as the rounds found.
    ``open`` marks windows that another document may hold, ``lower`` those that
    a smaller one may hold. ``name, first, last, cut``: the anchors of the next
    round, where there is one.
    """

    def __init__(self, texts: list[bytes], window: int, levels: list[int], told: list[list[list[int] | None]]) -> None:
        self.laid = laid = Laid(texts)
        n = len(laid.words)
        enough = laid.end - laid.begin >= window
        self.open = _spread(n, laid.begin[enough], laid.end[enough] - window) > 0
        self.lower = self.open.copy()
        symbols, at_level = Symbols(laid, max(1, window // 2)), {}
        while symbols.level < max(levels):
            symbols.up()
            if symbols.level in levels:
                at_level[symbols.level] = symbols.anchors(window)
        for k, level in enumerate(levels):
            name, first, last = at_level[level]
            seen = np.concatenate(([0], np.cumsum(self.open)))
            use = seen[last + 1] > seen[first]       # anchors of windows that are still open
            name, first, last = name[use], first[use], last[use]
            cut = np.searchsorted(first, np.append(laid.begin, n))
            if k == len(told):
                self.name, self.first, self.last, self.cut = name, first, last, cut
                return
            shared, lower = np.zeros(len(name), dtype=bool), np.zeros(len(name), dtype=bool)
            for d, codes in enumerate(told[k]):
                if codes:
                    at = np.array(codes, dtype=np.int64)
                    shared[cut[d] + (at >> 1)] = True
                    lower[cut[d] + (at >> 1)] = at & 1
            self.open &= _spread(n, first[~shared], last[~shared]) == 0
            self.lower &= self.open & (_spread(n, first[~lower], last[~lower]) == 0)

    def free(self) -> np.ndarray:
        """Documents with an open window that holds no anchor of the next round."""
        bare = self.open & (_spread(len(self.open), self.first, self.last) == 0)
        seen = np.concatenate(([0], np.cumsum(bare)))
        return seen[self.laid.end] > seen[self.laid.begin]


def window_names(words: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """64-bit polynomial name of the ``window`` words from each place in ``at``."""
    power, back = powers(len(words))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * power[:len(words)], dtype=np.uint64)))
    h = (total[at + window] - total[at]) * back[at]
    return bloom.mixed(h ^ (h >> _29))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows (first cell the text, in UTF-8) in groups of bounded size."""
    rows, size = [], 0
    for batch in batches:
        texts, others = batch.column(0), [c.to_pylist() for c in batch.columns[1:]]
        for t, *rest in zip(texts, *others, strict=True):
            rows.append((t.as_py().encode(), *rest))
            size += len(rows[-1][0])
            if size >= CHUNK_BYTES:
                yield rows
                rows, size = [], 0
    if rows:
        yield rows


def word_counts(docs: DataFrame) -> DataFrame:
    """``doc_id, tk, k, n_words``: id, key of the text, digest of its words joined by one space, their number.

    ``docs``: ``t, doc_id, tk``.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, counts = [], []
            for t in batch.column(0):
                words = (t.as_py() or "").encode().split()
                keys.append(hashlib.sha256(b" ".join(words)).digest())
                counts.append(len(words))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(keys, pa.binary()),
                                              pa.array(counts, pa.int64())], names=["doc_id", "tk", "k", "n_words"])

    return docs.select("t", "doc_id", "tk").mapInArrow(run, "doc_id long, tk binary, k binary, n_words long")


def anchor_names(docs: DataFrame, window: int, levels: list[int]) -> DataFrame:
    """``doc_id, tk, free, names``: anchors of the windows left open, at the last of ``levels``.

    ``docs``: ``t, doc_id, tk`` and one column ``told`` per level but the last.
    """
    told = [f"told{i}" for i in range(len(levels) - 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _chunks(batches):
            c = Chunk([r[0] for r in rows], window, levels, [[r[3 + i] for r in rows] for i in range(len(told))])
            names = pa.ListArray.from_arrays(pa.array(c.cut, pa.int32()), pa.array(c.name.view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary()),
                 pa.array(c.free()), names], names=["doc_id", "tk", "free", "names"])

    return docs.select("t", "doc_id", "tk", *told).mapInArrow(
        run, "doc_id long, tk binary, free boolean, names array<long>")


def told_of(names: DataFrame) -> DataFrame:
    """``rid, told``: the shared anchors of every row of ``names`` (``rid, doc_id, names``).

    Names are aggregated with their smallest and largest document. A Bloom
    filter of the shared names, of bounded size, keeps most others out of the
    join that brings them back.
    """
    spark = names.sparkSession
    held = names.select("doc_id", F.explode("names").alias("name")).groupBy("name").agg(
        F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("copies"))
    shared = landed(held.where("lo < hi").select("name", "lo", "copies"), "repeat-shared")
    blocks = {0: bloom.blocks_for(shared.count())}
    sent = spark.sparkContext.broadcast(
        bloom.build(shared.select(F.lit(0).alias("shard"), F.col("name").alias("h")), blocks)[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lanes = sent.value
        for batch in batches:
            lists = batch.column(2)
            name = lists.flatten().to_numpy(zero_copy_only=False)
            size = np.diff(lists.offsets.to_numpy())
            place = np.arange(len(name)) - np.repeat(np.cumsum(size) - size, size)
            hit = bloom.probe(lanes, name.view(np.uint64))
            row = np.repeat(np.arange(len(lists)), size)[hit]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)),
                 pa.array(place[hit].astype(np.int32)), pa.array(name[hit])], names=["rid", "doc_id", "at", "name"])

    passed = names.select("rid", "doc_id", "names").mapInArrow(run, "rid long, doc_id long, at int, name long")
    known = hot_join(passed, shared, ["name"], "copies", ["rid", "at"]).where("lo IS NOT NULL")
    return known.groupBy("rid").agg(F.sort_array(F.collect_list(
        F.col("at") * 2 + (F.col("lo") < F.col("doc_id")).cast("int"))).alias("told"))


def _edges(mask: np.ndarray) -> list[int]:
    """Begins and ends of the stretches that are set, in turn."""
    return np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0])))).tolist()


def open_ranges(live: DataFrame, window: int, levels: list[int]) -> DataFrame:
    """``t, doc_id, tk, open, lower`` of the documents with windows left open: stretches of those windows' first words.

    ``live``: ``t, doc_id, tk`` and one column ``told`` per level.
    """
    told = [f"told{i}" for i in range(len(levels))]
    ints = pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _chunks(batches):
            c = Chunk([r[0] for r in rows], window, levels, [[r[3 + i] for r in rows] for i in range(len(told))])
            out = []
            for r, b, e in zip(rows, c.laid.begin.tolist(), c.laid.end.tolist(), strict=True):
                if c.open[b:e].any():
                    out.append((r[0], r[1], r[2], _edges(c.open[b:e]), _edges(c.lower[b:e])))
            cols = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.binary()).cast(pa.string()), pa.array(cols[1], pa.int64()),
                 pa.array(cols[2], pa.binary()), pa.array(cols[3], ints), pa.array(cols[4], ints)],
                names=["t", "doc_id", "tk", "open", "lower"])

    return live.select("t", "doc_id", "tk", *told).mapInArrow(
        run, "t string, doc_id long, tk binary, open array<int>, lower array<int>")


def windows(live: DataFrame, window: int, stretches: str) -> DataFrame:
    """``x, y, doc_id, rid, at``: 128-bit name and place of the windows in ``open`` or ``lower`` stretches."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _chunks(batches):
            laid = Laid([r[0] for r in rows])
            mask = np.zeros(len(laid.words) + 1, dtype=np.int64)
            for r, b in zip(rows, laid.begin.tolist(), strict=True):
                edges = np.array(r[3], dtype=np.int64) + b
                mask[edges[0::2]] += 1
                mask[edges[1::2]] -= 1
            at = np.flatnonzero(np.cumsum(mask))
            x, y = (window_names(w, at, window) for w in (laid.words, laid.hashed(1)))
            doc = np.searchsorted(laid.begin, at, side="right") - 1
            ids, rids = (np.array([r[k] for r in rows], dtype=np.int64) for k in (1, 2))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x.view(np.int64)), pa.array(y.view(np.int64)), pa.array(ids[doc]), pa.array(rids[doc]),
                 pa.array((at - laid.begin[doc]).astype(np.int32))], names=["x", "y", "doc_id", "rid", "at"])

    return live.where(F.size(stretches) > 0).select("t", "doc_id", "rid", stretches).mapInArrow(
        run, "x long, y long, doc_id long, rid long, at int")


def without(rows: DataFrame, window: int) -> DataFrame:
    """``doc_id, tk, n_removed, kept_sha256`` of documents (``t, doc_id, tk, hits``) less their repeated windows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests = [], []
            for t, hits in zip(batch.column(0), batch.column(3), strict=True):
                words = t.as_py().encode().split()
                at = hits.values.to_numpy(zero_copy_only=False).astype(np.int64)
                gone = _spread(len(words), at, at + window - 1) > 0
                counts.append(int(gone.sum()))
                digests.append(hashlib.sha256(b" ".join([words[j] for j in np.flatnonzero(~gone).tolist()])).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(2), pa.array(counts, pa.int64()), pa.array(digests, pa.string())],
                names=["doc_id", "tk", "n_removed", "kept_sha256"])

    return rows.select("t", "doc_id", "tk", "hits").mapInArrow(
        run, "doc_id long, tk binary, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW,
                   levels: list[int] | None = None) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every row.

    Removes every word that lies in a window of ``window`` consecutive words
    which also starts in a document of smaller id. ``levels``: the levels of
    the Spark rounds; they change the work, not the result.

    Null and empty texts have no words. A row with a null id neither loses
    words nor makes others lose them. Rows with one id do not count as smaller
    than each other, whether their texts are equal or not. Very long texts are
    worked on whole; an empty table gives no row; other columns are ignored.
    """
    levels = levels_for(window) if levels is None else levels
    docs = docs.select(F.col(text).alias("t"), F.col(key).cast("long").alias("doc_id"),
                       text_key(F.coalesce(text, F.lit(""))).alias("tk"))
    known = docs.where("doc_id IS NOT NULL AND t IS NOT NULL")
    meta = landed(word_counts(docs), "repeat-meta")
    copies = landed(meta.where((F.col("n_words") >= window) & F.col("doc_id").isNotNull()).groupBy("k").agg(
        F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")).where("copies > 1"), "repeat-copies")
    fate = landed(hot_join(meta, copies, ["k"], "copies", ["doc_id"]).select(
        "doc_id", "tk", "k", "n_words", F.coalesce((F.col("rep") < F.col("doc_id")) & (F.col("n_words") >= window),
                                                   F.lit(False)).alias("copy")), "repeat-fate")

    live, told = known, []
    for n in range(len(levels)):
        names = anchor_names(live, window, levels[:n + 1])
        if n == 0:
            names = names.join(fate.where("copy").select("doc_id", "tk").distinct(), ["doc_id", "tk"], "left_anti")
        names = landed(names.where("free OR size(names) > 0").withColumn("rid", F.monotonically_increasing_id()),
                       "repeat-names")
        state = names.select("rid", "doc_id", "tk", "free").join(told_of(names), "rid", "left") \
            .where("free OR told IS NOT NULL").dropDuplicates(["doc_id", "tk"])
        state = landed(state.select("doc_id", "tk", F.col("told").alias(f"told{n}")), "repeat-state")
        told = [f"told{i}" for i in range(n + 1)]
        live = live.join(state, ["doc_id", "tk"]).select("t", "doc_id", "tk", *told)
        if n < len(levels) - 1:
            live = landed(live, "repeat-live", "zstd")
    live = landed(open_ranges(live, window, levels).withColumn("rid", F.monotonically_increasing_id()),
                  "repeat-live", "zstd")

    held = windows(live, window, "open").groupBy("x", "y").agg(
        F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("copies"))
    held = landed(held.where("lo < hi").drop("hi"), "repeat-held")
    hits = hot_join(windows(live, window, "lower"), held, ["x", "y"], "copies", ["rid", "at"]) \
        .where("lo < doc_id").groupBy("rid").agg(F.sort_array(F.collect_list("at")).alias("hits"))
    cut = without(live.join(hits, "rid"), window).dropDuplicates(["doc_id", "tk"])

    return fate.join(cut, ["doc_id", "tk"], "left").select(
        "doc_id", "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(F.col("copy"), F.lit(hashlib.sha256(b"").hexdigest()))
        .otherwise(F.coalesce("kept_sha256", F.lower(F.hex("k")))).alias("kept_sha256"))
