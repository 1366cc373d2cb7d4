"""Alignment of two tokenizers over exact-deduplicated texts.

Texts are shuffled by their full content, so every distinct text is tokenised
and aligned once, however many documents hold it. Byte offsets where tokens of
both sides end cut a text into groups; the two tokens that end a group are
linked. Pairs of linked ids are counted over the corpus with every text's
multiplicity, and the measures of a text are joined back to its documents.

The last tokens of a group end at one byte, so the bytes of one end with all
bytes of the other. An id has at most as many such partners as it has bytes
(times the ids that share a byte string), which bounds the table of pair counts
by the vocabularies, whatever the corpus: ``pair_bound`` computes it, and the
table is sent to the tasks.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evtab.llm.bpe import byte_names
from evtab.llm.util import hot_join, landed, text_key

#: Fixed value: how byte-level vocabularies split a text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Links a task sums before it folds them into its counts.
FOLDED = 2_000_000


@dataclass
class Aligned:
    """Token ids of a text on both sides and the places where a token of either side ends a group."""
    a: np.ndarray
    b: np.ndarray
    last_a: np.ndarray
    last_b: np.ndarray


def byte_level(path: str):
    """``encode(text) -> ids`` of a byte-level vocabulary file, no special tokens, and the bytes of every id.

    Where ids follow the merges (the id of a merge's token grows with its
    rank), ranks of byte strings say all that the merges say and tiktoken
    encodes; else the tokenizers library does.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    names, vocab, merges = byte_names(), spec["model"]["vocab"], spec["model"]["merges"]
    known = {bytes(names[c] for c in t): i for t, i in vocab.items() if all(c in names for c in t)}
    out = [b""] * (max([*vocab.values(), *(t["id"] for t in spec.get("added_tokens", []))]) + 1)
    for t, i in vocab.items():
        out[i] = t.encode()
    for x, i in known.items():
        out[i] = x
    order = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in merges]
    single = {vocab[c] for c in names if c in vocab}
    if len(single) == 256 and order == sorted(set(order)) and max(single) < order[0]:
        import tiktoken
        mergeable = single | set(order)
        ranks = {x: i for x, i in known.items() if i in mergeable}
        return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary, out
    os.environ["TOKENIZERS_PARALLELISM"] = "false"   # tasks share the machine already
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    library.encode_special_tokens = True
    return lambda text: library.encode(text, add_special_tokens=False).ids, out


class Pair:
    """The two tokenizers with the bytes of their ids."""

    def __init__(self, left: str, right: str) -> None:
        import sentencepiece
        self.encode_a, self.bytes_a = byte_level(left)
        model = sentencepiece.SentencePieceProcessor(model_file=right)
        self.encode_b = model.encode
        n = model.get_piece_size()
        self.bytes_b = [bytes([int(p[3:-1], 16)]) if model.is_byte(i) else p.replace("\u2581", " ").encode()
                        for i, p in ((i, model.id_to_piece(i)) for i in range(n))]
        self.size_a = np.array([len(x) for x in self.bytes_a], dtype=np.int64)
        self.size_b = np.array([len(x) for x in self.bytes_b], dtype=np.int64)
        a, b = map(str, range(len(self.bytes_a))), map(str, range(n))
        a, b = list(a), list(b)
        # every id as it is written inside a group and at the end of its side
        self.written_as = [x + "," for x in a] + [x + "|" for x in a] + [x + "," for x in b] + [x + ";" for x in b]

    def align(self, text: str) -> Aligned | None:
        """None for a text whose joined tokens are not a space and the text on either side."""
        a, b = self.encode_a(" " + text), self.encode_b(text)
        want = (" " + text).encode()
        if b"".join(map(self.bytes_a.__getitem__, a)) != want or b"".join(map(self.bytes_b.__getitem__, b)) != want:
            return None
        a, b = np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        at = np.searchsorted(ends_b, ends_a)         # both end with the text: every place is inside
        last_a = np.flatnonzero(ends_b[at] == ends_a)
        return Aligned(a, b, last_a, at[last_a])

    def written(self, x: Aligned) -> str:
        """Groups as text: ``a1,a2|b1;a3|b2,b3``."""
        end_a, end_b = np.zeros(len(x.a), dtype=np.int64), np.zeros(len(x.b), dtype=np.int64)
        end_a[x.last_a], end_b[x.last_b] = 1, 1
        group_a, group_b = np.cumsum(end_a) - end_a, np.cumsum(end_b) - end_b
        # an A token comes after the B tokens of earlier groups, a B token after the A tokens of its group
        cells = np.empty(len(x.a) + len(x.b), dtype=np.int64)
        before = np.concatenate(([0], x.last_b + 1))
        cells[np.arange(len(x.a)) + before[group_a]] = x.a + len(self.bytes_a) * end_a
        cells[np.arange(len(x.b)) + x.last_a[group_b] + 1] = \
            x.b + len(self.bytes_b) * end_b + 2 * len(self.bytes_a)
        return "".join(map(self.written_as.__getitem__, cells.tolist()))[:-1]

    def codes(self, x: Aligned) -> np.ndarray:
        """One number per link: A id times B's vocabulary plus B id."""
        return x.a[x.last_a] * len(self.bytes_b) + x.b[x.last_b]


_PAIRS: dict[tuple[str, str], Pair] = {}


def pair(merges: str, pieces: str) -> Pair:
    """The worker's tokenizers (loaded once per process)."""
    if (merges, pieces) not in _PAIRS:
        _PAIRS[merges, pieces] = Pair(merges, pieces)
    return _PAIRS[merges, pieces]


def pair_bound(p: Pair) -> int:
    """Most id pairs that can end at one byte: one token's bytes end with all of the other's."""
    def ends(long: list[bytes], short: list[bytes]) -> int:
        ids = Counter(short)
        return sum(ids[x[i:]] for x in long if x for i in range(len(x)))
    return ends(p.bytes_a, p.bytes_b) + ends(p.bytes_b, p.bytes_a)


def distinct_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``text, copies``: every distinct non-empty text, shuffled by its full content."""
    rows = docs.select(F.col(text).alias("text")).where("text IS NOT NULL AND text <> ''")
    return rows.groupBy("text").agg(F.count(F.lit(1)).alias("copies"))


def aligned(texts: DataFrame, merges: str, pieces: str, groups: bool = False) -> DataFrame:
    """Alignment of each distinct text: ``k, copies, n_a, n_b, n_groups, groups_sha256, links`` [, ``groups``].

    ``links`` holds one little-endian 64-bit code per link. A text that the tokens do not
    give back has no tokens: zeros and empty columns.
    """
    shape = "k binary, copies long, n_a long, n_b long, n_groups long, groups_sha256 string, links binary" + \
        (", groups string" if groups else "")
    names = [c.strip().split(" ")[0] for c in shape.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pair(merges, pieces)
        for batch in batches:
            rows: list[tuple] = []
            for t, n in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                t = t.as_py()
                k, x = hashlib.md5(t.encode()).digest(), p.align(t)
                if x is None:
                    rows.append((k, n, 0, 0, 0, "", b"", ""))
                    continue
                w = p.written(x)
                rows.append((k, n, len(x.a), len(x.b), len(x.last_a), hashlib.sha256(w.encode()).hexdigest(),
                             p.codes(x).astype("<i8").tobytes(), w if groups else None))
            cols = list(zip(*rows, strict=True)) or [()] * 8
            kinds = [pa.binary(), *[pa.int64()] * 4, pa.string(), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)][:len(names)],
                                             names=names)

    return texts.select("text", "copies").mapInArrow(run, shape)


def link_counts(rows: DataFrame) -> DataFrame:
    """``code, n``: links of every id pair over the corpus, each text weighted by its copies."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, weights, held = np.zeros(0, np.int64), np.zeros(0, np.int64), []

        def fold() -> tuple[np.ndarray, np.ndarray]:
            every = np.concatenate([codes, *[c for c, _ in held]])
            weight = np.concatenate([weights, *[np.full(len(c), m, dtype=np.int64) for c, m in held]])
            order = np.argsort(every, kind="stable")
            every, weight = every[order], weight[order]
            start = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1]))) if len(every) else []
            return every[start], (np.add.reduceat(weight, start) if len(every) else weight)

        size = 0
        for batch in batches:
            for m, cell in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held.append((np.frombuffer(cell.as_py(), "<i8"), m))
                size += len(held[-1][0])
                if size >= FOLDED:
                    codes, weights = fold()
                    held, size = [], 0
        codes, weights = fold()
        yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(weights)], names=["code", "n"])

    return rows.select("copies", "links").mapInArrow(run, "code long, n long") \
        .groupBy("code").agg(F.sum("n").alias("n"))


def measured(rows: DataFrame, counts: DataFrame, merges: str, pieces: str) -> DataFrame:
    """Adds ``n_links, n_best, count_sum`` to aligned texts; ``counts`` (``code, n``) is bounded by ``pair_bound``."""
    p = pair(merges, pieces)
    table = counts.toArrow()
    if table.num_rows > pair_bound(p):
        raise ValueError("more linked id pairs than the vocabularies allow")
    code, n = (table.column(c).to_numpy() for c in ("code", "n"))
    order = np.argsort(code)
    code, n = code[order], n[order]
    b = code % len(p.bytes_b)
    top = np.zeros(len(p.bytes_b), dtype=np.int64)
    np.maximum.at(top, b, n)
    sent = rows.sparkSession.sparkContext.broadcast((code, n, n == top[b]))
    kept = ["k", "copies", "n_a", "n_b", "n_groups", "groups_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, n, best = sent.value
        for batch in batches:
            got = []
            for cell in batch.column(len(kept)):
                at = np.searchsorted(code, np.frombuffer(cell.as_py(), "<i8"))
                got.append((len(at), int(best[at].sum()), int(n[at].sum())))
            cols = list(zip(*got, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[pa.array(c, pa.int64()) for c in cols]],
                                             names=[*kept, "n_links", "n_best", "count_sum"])

    return rows.select(*kept, "links").mapInArrow(
        run, "k binary, copies long, n_a long, n_b long, n_groups long, groups_sha256 string, "
             "n_links long, n_best long, count_sum long")


def align_documents(docs: DataFrame, merges: str, pieces: str, key: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row.

    Null and empty texts, and texts that the tokens of either side do not give
    back (a normalising tokenizer), have no tokens: zeros and the empty string.
    Equal texts share one alignment and count once per row; a null id keeps its
    row; very long texts are aligned whole; an empty table gives no row; other
    columns are ignored.
    """
    rows = landed(aligned(distinct_texts(docs, text), merges, pieces), "align-texts", "zstd")
    counts = landed(link_counts(rows), "align-counts")
    facts = landed(measured(rows, counts, merges, pieces), "align-facts")
    text_col: Column = F.col(text)
    ids = docs.select(F.col(key).cast("long").alias("doc_id"),
                      F.when(text_col != "", text_key(text_col)).alias("k"))
    numbers = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    out = hot_join(ids, facts, ["k"], "copies", ["doc_id"])
    return out.select("doc_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in numbers],
                      F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
