"""Subword pieces by longest match over a vocabulary, one table row per distinct word.

A vocabulary lists pieces that may start a word and pieces that may continue
one. A word is cut from its start, each time at the longest piece that fits; a
word that cannot be cut to its end is one unknown piece. Words are cut once
each, whatever their number of occurrences, and the pieces are joined back to
the token sequences, which are truncated like a model's input.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values ------------------------------------------------------------
UNKNOWN_ID = 0        # piece id of a word that cannot be cut; vocabulary ids start at 1
# ------------------------------------------------------------------------------

#: Pieces a vocabulary may have: it is held by every worker.
MAX_PIECES = 1_000_000
#: Different pieces a task counts at a time.
LOCAL_PIECES = 300_000


class Trie:
    """Longest match over the pieces of one position (start or inside of a word)."""

    def __init__(self, pieces: Iterator[tuple[str, int]]) -> None:
        self.root: dict = {}
        for piece, i in pieces:
            node = self.root
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = i

    def longest(self, word: str, at: int) -> tuple[int, int]:
        """(id, end) of the longest piece of ``word`` from ``at``; id -1 where none fits."""
        node, best, end = self.root, -1, at
        for k in range(at, len(word)):
            node = node.get(word[k])
            if node is None:
                break
            if "" in node:
                best, end = node[""], k + 1
        return best, end


def cut(word: str, first: Trie, rest: Trie) -> list[int]:
    """Piece ids of a word."""
    out, at = [], 0
    while at < len(word):
        i, at = (rest if at else first).longest(word, at)
        if i < 0:
            return [UNKNOWN_ID]
        out.append(i)
    return out or [UNKNOWN_ID]


def piece_vocabulary(words: DataFrame, word: str = "word", longest: int = 6, least: int = 20) -> DataFrame:
    """(piece, first, id): prefixes (``first``) and inner substrings of up to ``longest`` characters that ``least``
    distinct words hold at some place; ids from 1 in order of (first, piece). Words are counted once each."""
    from evtab.operators.features import sorted_index
    w = words.select(F.col(word).alias("w")).where("w <> ''").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: Counter = Counter()
        rest: Counter = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            for side, counts in ((True, first), (False, rest)):
                yield pa.RecordBatch.from_arrays([pa.array([side] * len(counts), pa.bool_()),
                                                  pa.array(counts.keys(), pa.string()),
                                                  pa.array(counts.values(), pa.int64())], names=["first", "piece", "n"])
                counts.clear()
        for batch in batches:
            for w in batch.column(0).to_pylist():
                for n in range(1, min(longest, len(w)) + 1):     # a word counts once for a piece, and for each length apart
                    first[w[:n]] += 1
                    rest.update({w[i:i + n] for i in range(1, len(w) - n + 1)})
                if len(first) + len(rest) >= LOCAL_PIECES:
                    yield from out()
        yield from out()
    often = w.mapInArrow(run, "first boolean, piece string, n long").groupBy("first", "piece") \
        .agg(F.sum("n").alias("c")).where(F.col("c") >= least)
    return sorted_index(often.select("first", "piece"), ["first", "piece"], "_i") \
        .select("piece", "first", (F.col("_i") + 1).cast("int").alias("id"))


def word_pieces(words: DataFrame, vocabulary: DataFrame, word: str = "word") -> DataFrame:
    """(word, ids): the pieces of every distinct word. ``vocabulary``: ``piece, first, id``."""
    found = vocabulary.select("piece", "first", "id").limit(MAX_PIECES + 1).toArrow()
    if found.num_rows > MAX_PIECES:
        raise ValueError(f"a vocabulary has at most {MAX_PIECES} pieces")
    sent = words.sparkSession.sparkContext.broadcast(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = list(zip(*(sent.value.column(c).to_pylist() for c in ("piece", "first", "id")), strict=True))
        first, rest = (Trie((p, i) for p, f, i in rows if bool(f) is side) for side in (True, False))
        for batch in batches:
            ids = [cut(w, first, rest) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))],
                                             names=["word", "ids"])

    return words.select(F.col(word).alias("word")).where("word IS NOT NULL").distinct() \
        .mapInArrow(run, "word string, ids array<int>")


def with_pieces(df: DataFrame, pieces: DataFrame, key: Sequence[str], words: str = "input",
                max_len: int | None = None) -> DataFrame:
    """Adds ``word_ids`` and ``piece_ids`` (null for the special piece at either end) and ``n_pieces`` to the rows of
    ``df``; ``key`` identifies a row, ``pieces``: ``word, ids``.

    ``n_pieces`` counts all pieces of the row; the arrays hold what a model of ``max_len`` pieces reads (None: all).
    Every word has a piece, so words past ``max_len`` are only counted, and no array grows with a long text. A row
    without words has the special pieces alone."""
    key = list(key)
    room = None if max_len is None else max(0, max_len - 2)
    w = df.select(*key, F.posexplode(words).alias("_w", "word")).join(pieces, "word")
    kept: Column = F.struct("_w", "ids")
    if room is not None:
        kept = F.when(F.col("_w") < room, kept)
    g = w.groupBy(*key).agg(F.array_sort(F.collect_list(kept)).alias("_p"), F.sum(F.size("ids")).alias("n_pieces"))

    def ends(body: Column) -> Column:
        return F.concat(F.array(F.lit(None).cast("int")), body if room is None else F.slice(body, 1, room),
                        F.array(F.lit(None).cast("int")))
    own = F.flatten(F.transform("_p", lambda x: F.transform(x["ids"], lambda _: x["_w"].cast("int"))))
    g = g.select(*key, ends(own).alias("word_ids"), ends(F.flatten("_p.ids")).alias("piece_ids"), "n_pieces")
    none = F.array(F.lit(None).cast("int"), F.lit(None).cast("int"))
    out = df.join(g, key, "left")
    return out.withColumn("word_ids", F.coalesce("word_ids", none)) \
        .withColumn("piece_ids", F.coalesce("piece_ids", none)) \
        .withColumn("n_pieces", F.coalesce("n_pieces", F.lit(0)))
