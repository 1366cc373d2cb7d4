"""BPE encoding and decoding with a tokenization automaton.

The merges of a byte-level BPE vocabulary are compiled into a deterministic
automaton over token labels: it accepts exactly the label sequences that BPE
produces. Compilation starts from one state that allows every byte after every
byte and applies one gadget per merge ``(u, v) -> w`` in rank order:

* the state reached by ``u`` is copied without its arc ``v`` (the pair u v can
  no longer stand side by side) and every ``u`` arc is led to the copy;
* every state that still has an arc ``u`` gets an arc ``w`` to the state that
  ``v`` led to.

All arcs with one label lead to one state, so the automaton is five integer
arrays: the target state of each label, and per state its parent, the arc it
lost and when it was made. An arc test walks those arrays; the tests that
occurred are kept in a table.

A word is encoded by following arcs from the start, longest label first. Every
prefix of it has one accepted label sequence, so an end from which no arc leads
on is dead for good and the search is linear in the word. Decoding emits the
bytes of each label.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: How byte-level vocabularies split a text before merging (fixed values).
SPLIT = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d"
    r"| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?![^\p{White_Space}])|\p{White_Space}+")

#: Entries a worker keeps in each of its tables before it starts them anew.
TABLE_ENTRIES = 400_000


def byte_names() -> dict[str, int]:
    """Character that names each byte in a byte-level vocabulary.

    Printable Latin-1 characters name themselves; the other bytes, in order,
    are named by the characters from U+0100 on.
    """
    named = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(named)]
    return {chr(b): b for b in named} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    """Compiled merges. Labels are token ids; state 0 is the start."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]],
                 special: dict[str, int] | None = None) -> None:
        names = byte_names()
        self.special = dict(special or {})
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.bytes[i] = bytes(names[c] for c in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.left = [-1] * size          # first part of a merged label
        self.born = [-1] * size          # rank of its merge; -1 for bytes
        self.target = [0] * size         # state every arc with this label leads to
        self.parent, self.lost, self.made = [-1], [-1], [-1]
        usable = {vocab[c] for c in names if c in vocab}
        for rank, (a, b) in enumerate(merges):
            u, v, w = vocab[a], vocab[b], vocab[a + b]
            if w in usable or u not in usable or v not in usable:
                raise ValueError(f"merge {rank} is out of order or repeats a token")
            before_u, before_v = self.target[u], self.target[v]
            self.parent.append(before_u)
            self.lost.append(v)
            self.made.append(rank)
            self.target[u] = len(self.parent) - 1
            self.target[w] = before_v
            self.left[w], self.born[w] = u, rank
            usable.add(w)
        self.by_bytes = {self.bytes[i]: i for i in usable}
        self.longest = max(map(len, self.by_bytes), default=1)
        self.arcs: dict[int, bool] = {}
        self.size = size

    def has_arc(self, state: int, label: int) -> bool:
        key = state * self.size + label
        known = self.arcs.get(key)
        if known is None:
            if len(self.arcs) >= TABLE_ENTRIES * 4:
                self.arcs.clear()
            known = self.arcs[key] = self._walk(state, label)
        return known

    def _walk(self, state: int, label: int) -> bool:
        parent, lost, made, left, born = self.parent, self.lost, self.made, self.left, self.born
        while state:
            if born[label] >= made[state]:
                label = left[label]      # gained with its merge iff the first part was there
            elif label == lost[state]:
                return False
            else:
                state = parent[state]    # an older arc: as in the state it was copied from
        return True

    def encode_word(self, word: bytes) -> list[int]:
        """Labels of one pre-split word."""
        whole = self.by_bytes.get(word)
        if whole is not None:
            return [whole]
        n, find, target, longest = len(word), self.by_bytes.get, self.target, self.longest
        arcs, size = self.arcs, self.size
        path: list[int] = []             # labels from the start to ``at``
        at, state, end = 0, 0, min(n, longest)
        dead: set[int] = set()           # ends without an accepted way to the end of the word
        while at < n:
            while end > at:
                label = find(word[at:end])
                if label is not None and end not in dead:
                    known = arcs.get(state * size + label)
                    if known if known is not None else self.has_arc(state, label):
                        break
                end -= 1
            if end > at:
                path.append(label)
                state, at = target[label], end
                end = min(n, at + longest)
            else:                        # no arc leads on: step back and try shorter labels
                if not path:
                    raise ValueError("the vocabulary lacks a byte of the text")
                dead.add(at)
                end = at - 1
                at -= len(self.bytes[path.pop()])
                state = target[path[-1]] if path else 0
        return path


class Codec:
    """An automaton with the tables a worker reuses from text to text.

    Texts are cut at single spaces first: between two characters that are not
    white space, a word always starts at the space. Pieces repeat, so their
    label sequences are kept (as little-endian 32-bit ids). A piece that
    touches other white space sends the text down the plain split instead.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.automaton = Automaton(spec["model"]["vocab"], merges, special)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") \
            if special else None
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes | None] = {}
        self.older: dict[str, bytes | None] = {}  # the table before the last restart

    def _word(self, word: str) -> bytes:
        got = self.words.get(word)
        if got is None:
            labels = self.automaton.encode_word(word.encode())
            got = pack(f"<{len(labels)}I", *labels)
            if len(word) <= 64:
                if len(self.words) >= TABLE_ENTRIES:
                    self.words.clear()
                self.words[word] = got
        return got

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self._word, SPLIT.findall(text)))

    def _piece(self, piece: str) -> bytes | None:
        """Ids of a space and ``piece``; None if its ends are white space."""
        old = self.older.get(piece, 0)
        if old != 0:
            got = old
        elif piece.isalpha():            # one word, no need to split
            got = self._word(" " + piece)
        elif not piece or piece[0].isspace() or piece[-1].isspace():
            got = None
        else:
            got = self._plain(" " + piece)
        if len(piece) <= 64:
            if len(self.pieces) >= TABLE_ENTRIES:
                self.older = dict(self.pieces)
                self.pieces.clear()
            self.pieces[piece] = got
        return got

    def _segment(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        if rest and (not first or first[-1].isspace()):
            return self._plain(text)
        out, known, missing = [self._plain(first)], self.pieces.get, self._piece
        for piece in rest:
            ids = known(piece) or missing(piece)
            if ids is None:
                return self._plain(text)
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids of a text, little-endian unsigned 32-bit."""
        if self.cut is None or not self.cut.search(text):
            return self._segment(text)
        special = self.automaton.special
        return b"".join(np.array([special[s]], dtype="<u4").tobytes() if s in special else self._segment(s)
                        for s in self.cut.split(text) if s)

    def decode(self, ids: bytes) -> str:
        label = self.automaton.bytes.__getitem__
        return b"".join(map(label, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace")


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The worker's codec for a vocabulary file (compiled once per process)."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode_decode(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None,
                  ids: bool = True, decoded: bool = False) -> DataFrame:
    """Encode ``text`` with the vocabulary at ``path`` and decode it again.

    Returns the ``keep`` columns (default: all but ``text``) and ``n_tokens``
    (long), ``ids_sha256``, ``decoded_sha256``; with ``ids`` the ids themselves
    (``token_ids``, binary, little-endian unsigned 32-bit), with ``decoded`` the
    decoded text. A null text counts as empty: no ids, the digests of nothing.
    Repeated rows stay repeated; an empty table gives an empty table. A kept
    column named like a result column is replaced by it.

    One narrow pass: no shuffle, rows stay in their partition.
    """
    made = {"n_tokens", "ids_sha256", "decoded_sha256", "token_ids", "decoded"}
    kept = [c for c in (df.columns if keep is None else keep)
            if c.lower() not in made and (keep is not None or c != text)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        sha = hashlib.sha256
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            got = [c.encode(t) if t else b"" for t in (x.as_py() for x in texts)]
            back = [c.decode(b) for b in got]
            cols = [*batch.columns[:-1],
                    pa.array([len(b) // 4 for b in got], pa.int64()),
                    pa.array([sha(b).hexdigest() for b in got], pa.string()),
                    pa.array([sha(t.encode()).hexdigest() for t in back], pa.string())]
            if ids:
                cols.append(pa.array(got, pa.binary()))
            if decoded:
                cols.append(pa.array(back, pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=names)

    kept_fields = [df.schema[c] for c in kept]
    out = T.StructType([*kept_fields, T.StructField("n_tokens", T.LongType()),
                        T.StructField("ids_sha256", T.StringType()),
                        T.StructField("decoded_sha256", T.StringType())])
    if ids:
        out = out.add("token_ids", T.BinaryType())
    if decoded:
        out = out.add("decoded", T.StringType())
    names = out.fieldNames()
    return df.select(*kept, F.col(text).alias("_text")).mapInArrow(run, out)
