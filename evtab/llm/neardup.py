"""MinHash near-duplicates of texts: DartMinHash signatures, banded join, exact check.

A text is the weighted set of its five-word shingles. Darts are thrown at every
element of the universe by hash: an element's region (its weight by the rank
axis) is hit at ranks with exponential gaps, and every dart falls on one of k
coordinates. The signature keeps, per coordinate, the earliest dart that hit
the text's regions. Two texts agree on a coordinate with the probability of
their weighted Jaccard similarity, and only as many darts are generated as it
takes to hit all coordinates (about k ln k), however long the text is.

Signatures are cut into bands; texts that share a band are candidates. Equal
texts form a class first. Candidates are not expanded into all pairs: every
member of a band bucket is checked against the bucket's smallest id, and only
where a bucket still holds several components are the members of different
components compared. Links are checked on the whole texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evtab.llm.components import components
from evtab.llm.util import hot_join, landed

WORDS = 5
SIMILARITY = 0.8
#: Bands and rows: a pair at 0.8 is missed with a probability of 5e-8.
BANDS, ROWS = 32, 4
K = BANDS * ROWS
#: Agreeing coordinates a pair of one bucket needs to be checked: five standard
#: deviations below what a pair at the threshold has.
SLACK = 5.0
REMEMBERED = 400_000
#: Texts signed together, and members (rows, characters) of an unresolved group in one part.
BATCH_WORDS = 200_000
PART_ROWS, PART_CHARS = 1024, 4_000_000

_M = np.uint64(0x9E3779B97F4A7C15)
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_30, _27, _31, _11, _32 = (np.uint64(x) for x in (30, 27, 31, 11, 32))


def _seed(n: int) -> np.uint64:
    return np.uint64(n * int(_M) & (2 ** 64 - 1))


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finalizer: every bit of the result depends on all bits of x."""
    x = (x ^ (x >> _30)) * _A
    x = (x ^ (x >> _27)) * _B
    return x ^ (x >> _31)


class WordHash(dict):
    """64-bit hash of a word, remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        got = self[word] = xxhash.xxh64_intdigest(word)
        return got


def shingles(text: str | None, known: WordHash) -> np.ndarray:
    """Hashes of the five-word shingles of a text, repeats included.

    Words are runs between white space. A text of one to four words is one
    shingle; a text without words has none.
    """
    words = text.split() if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    n = max(1, len(h) - WORDS + 1)
    x = np.zeros(n, dtype=np.uint64)
    for i in range(min(WORDS, len(h))):
        x = x * _M + h[i:i + n]
    return mixed(x + np.uint64(min(WORDS, len(h))))


def _throw(element: np.ndarray, owner: np.ndarray, weight: np.ndarray, reach: np.ndarray, best: np.ndarray) -> None:
    """Darts of rank below ``reach[owner]``; ``best[owner, coordinate]`` keeps the earliest.

    A dart is 32 bits of rank before 32 bits of its hash, so the smaller
    number is the earlier dart and equal numbers are the same dart. Weights are
    cut into strips [0, 1), [1, 2), [2, 4), ...: a strip of width v is hit v
    times as often, at weights spread evenly over it.
    """
    low, width, strip = 0.0, 1.0, 0
    while len(element):
        seed = mixed(element + _seed(2 * strip + 1))
        at, who, rank, step = np.arange(len(seed)), owner, np.zeros(len(seed)), 0
        while len(at):
            hashed = mixed(seed[at] + _seed(step + 1))
            rank = rank - np.log(((hashed >> _11).astype(np.float64) + 0.5) / 2.0 ** 53) / width
            live = rank < reach[who]
            at, who, rank, hashed = at[live], who[live], rank[live], hashed[live]
            dart = mixed(hashed)
            hit = np.ones(len(at), dtype=bool) if strip == 0 else \
                low + width * ((mixed(dart) >> _11).astype(np.float64) / 2.0 ** 53) < weight[at]
            code = (rank[hit].astype(np.float32).view(np.uint32).astype(np.uint64) << _32) | (dart[hit] >> _32)
            np.minimum.at(best, (who[hit], (dart[hit] % np.uint64(K)).astype(np.int64)), code)
            step += 1
        more = weight > low + width
        element, owner, weight = element[more], owner[more], weight[more]
        low, width, strip = low + width, (1.0 if strip == 0 else 2 * width), strip + 1


def signatures(sets: list[np.ndarray], weights: list[np.ndarray] | None = None) -> np.ndarray:
    """One row of K 16-bit coordinates per non-empty set of element hashes.

    Without ``weights`` every element weighs 1 (repeats change nothing).
    """
    none = np.uint64(2 ** 64 - 1)
    best = np.full((len(sets), K), none, dtype=np.uint64)
    sizes = np.array([len(s) for s in sets])
    element, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    weight = np.ones(len(element)) if weights is None else np.concatenate(weights).astype(float)
    mass = np.bincount(owner, weights=weight, minlength=len(sets))
    reach = (K * np.log(K) + 2 * K) / np.maximum(mass, 1e-9)
    todo = np.ones(len(sets), dtype=bool)
    while todo.any():
        mine = todo[owner]
        _throw(element[mine], owner[mine], weight[mine], reach, best)
        todo = (best == none).any(axis=1)
        reach = np.where(todo, 2 * reach, reach)
    return (mixed(best) >> np.uint64(48)).astype(np.uint16)


def signed(docs: DataFrame, key: str = "doc_id", text: str = "text", weights: str = "set") -> DataFrame:
    """``doc_id, k, sig``: text key and signature of every row with an id and a text.

    ``weights``: ``set`` (every distinct shingle weighs 1) or ``count`` (its
    number of occurrences). A text without words has no signature (null).
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHash()

        def out(ids: list, keys: list, sets: list[np.ndarray]) -> pa.RecordBatch:
            full = [i for i, s in enumerate(sets) if len(s)]
            sig: list[bytes | None] = [None] * len(sets)
            if full:
                if weights == "count":
                    pairs = [np.unique(sets[i], return_counts=True) for i in full]
                    rows = signatures([p[0] for p in pairs], [p[1] for p in pairs])
                else:
                    rows = signatures([sets[i] for i in full])
                for i, r in zip(full, rows, strict=True):
                    sig[i] = r.tobytes()
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary()),
                                               pa.array(sig, pa.binary())], names=["doc_id", "k", "sig"])

        ids, keys, sets, size = [], [], [], 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                t = t.as_py()
                ids.append(i)
                keys.append(hashlib.md5(t.encode()).digest())
                sets.append(shingles(t, known))
                size += len(sets[-1])
                if size >= BATCH_WORDS or len(ids) >= 2000:
                    yield out(ids, keys, sets)
                    ids, keys, sets, size = [], [], [], 0
        if ids:
            yield out(ids, keys, sets)

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("t"))
    return rows.where("doc_id IS NOT NULL AND t IS NOT NULL").mapInArrow(run, "doc_id long, k binary, sig binary")


def _set_of(text: str, known: WordHash) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(shingles(text, known), return_counts=True)


def checked(pairs: DataFrame, texts: DataFrame, similarity: float = SIMILARITY, weights: str = "set") -> DataFrame:
    """The pairs (``a, b``) whose texts (``id, t``) reach the similarity, computed on the whole texts.

    A member that meets many partners is split from them by the join; nothing
    but the two texts of a pair is held in memory.
    """
    both = pairs.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b").select("a", "ta", "b", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, last = WordHash(), {}

        def weighted(i: int, t: str) -> tuple[np.ndarray, np.ndarray]:
            if i not in last:
                if len(last) >= 64:
                    last.clear()
                last[i] = _set_of(t, known)
            return last[i]

        for batch in batches:
            out: list[tuple[int, int]] = []
            for a, ta, b, tb in zip(*batch.columns, strict=True):
                a, b = a.as_py(), b.as_py()
                both, total = _shared(weighted(a, ta.as_py()), weighted(b, tb.as_py()), weights)
                if both >= similarity * total:
                    out.append((a, b))
            cols = list(zip(*out, strict=True)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def _shared(x: tuple, y: tuple, weights: str) -> tuple[int, int]:
    """Weight of what two weighted sets share, and of both together."""
    (a, ca), (b, cb) = x, y
    if weights == "set":
        both = len(np.intersect1d(a, b, assume_unique=True))
        return both, len(a) + len(b) - both
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    both = int(np.minimum(ca[i], cb[j]).sum())
    return both, int(ca.sum()) + int(cb.sum()) - both


def compared(members: DataFrame, similarity: float = SIMILARITY, weights: str = "set") -> DataFrame:
    """Links ``a, b`` that join different components of a candidate group.

    ``members``: ``grp, main, id, comp, sig, t``, every member once. A group is
    dealt to parts bounded by rows and by characters, and parts meet in pairs;
    parts of the group's largest component do not meet each other. A task
    compares signatures, checks pairs that agree enough on the whole texts,
    best first, and skips those that its earlier links have joined: no more
    links leave a task than it takes to join its members.
    """
    least = similarity * K - SLACK * float(np.sqrt(K * similarity * (1 - similarity)))
    sizes = members.groupBy("grp", "main").agg(F.greatest(
        F.ceil(F.count(F.lit(1)) / PART_ROWS), F.ceil(F.sum(F.length("t")) / PART_CHARS)).alias("parts"))
    # the join leaves all rows of (grp, main) in one partition: deal the parts anew
    dealt = members.join(sizes, ["grp", "main"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))) \
        .repartition("grp", "main", "part")

    def pack(t: pa.Table) -> pa.Table:
        texts = [x.encode() for x in t.column("t").to_pylist()]
        return pa.table({"grp": t.column("grp")[:1], "main": t.column("main")[:1], "part": t.column("part")[:1],
                         "ids": [t.column("id").to_numpy().tobytes()], "comps": [t.column("comp").to_numpy().tobytes()],
                         "sigs": [b"".join(t.column("sig").to_pylist())], "ends": [np.cumsum([len(x) for x in texts],
                                                                                   dtype=np.int64).tobytes()],
                         "texts": [b"".join(texts)]})

    shape = "grp long, main int, part long, ids binary, comps binary, sigs binary, ends binary, texts binary"
    packs = landed(dealt.select("grp", "main", "part", "id", "comp", "sig", "t").groupBy("grp", "main", "part")
                   .applyInArrow(pack, shape), "dup-packs", "snappy")
    other = packs.toDF("grp", "main2", "part2", "ids2", "comps2", "sigs2", "ends2", "texts2")
    met = packs.join(other, "grp").where(
        (F.struct("main", "part") <= F.struct("main2", "part2")) & (F.col("main") + F.col("main2") < 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHash()
        for batch in batches:
            for cells in zip(*batch.columns, strict=True):
                same, *cells = (c.as_py() for c in cells)
                sides = cells[:5], cells[5:]
                if same:
                    sides = sides[:1]
                ids, root = (np.concatenate([np.frombuffer(s[k], np.int64) for s in sides]) for k in (0, 1))
                sigs = np.frombuffer(b"".join(s[2] for s in sides), np.uint16).reshape(-1, K)
                texts = [s[4][x:y] for s in sides for x, y in zip(
                    [0, *np.frombuffer(s[3], np.int64)[:-1]], np.frombuffer(s[3], np.int64), strict=True)]
                sets: dict[int, tuple] = {}

                def weighted(i: int, texts: list = texts, sets: dict = sets) -> tuple:
                    if i not in sets:
                        sets[i] = _set_of(texts[i].decode(), known)
                    return sets[i]

                n = len(np.frombuffer(sides[0][0], np.int64))
                left, right = [], []
                for i in range(n):
                    js = np.arange(i + 1 if same else n, len(ids))
                    js = js[root[js] != root[i]]
                    agree = (sigs[js] == sigs[i]).sum(axis=1)
                    close = js[agree >= least][np.argsort(-agree[agree >= least], kind="stable")]
                    for j in close.tolist():
                        if root[i] == root[j]:
                            continue
                        both, total = _shared(weighted(i), weighted(j), weights)
                        if both >= similarity * total:
                            left.append(int(ids[i]))
                            right.append(int(ids[j]))
                            low, high = sorted((int(root[i]), int(root[j])))
                            root[root == high] = low
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())],
                                                 names=["a", "b"])

    same = (F.col("main") == F.col("main2")) & (F.col("part") == F.col("part2"))
    return met.select(same.alias("same"), "ids", "comps", "sigs", "ends", "texts", "ids2", "comps2", "sigs2", "ends2",
                      "texts2").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY,
                    weights: str = "set") -> DataFrame:
    """``doc_id, class_id, component_id, kept`` for every row.

    ``class_id`` is the smallest id with the same text, ``component_id`` the
    smallest id reachable over links (equal texts, or texts whose shingles
    reach the similarity); a document is kept if its id is that.

    A null text links with nothing, a null id with nothing (its class and
    component are null, it is kept); texts without words link with equal texts
    only; repeated rows (id and text) stay and share their fate; an id with
    several texts links with the partners of each; an empty table gives no row;
    other columns are ignored.
    """
    sigs = landed(signed(docs, key, text, weights), "dup-signed")
    # a class has a number of its own: one doc_id may have several texts
    classes = landed(sigs.groupBy("k").agg(F.min(F.struct("doc_id", "sig")).alias("m"))
                     .select("k", F.col("m.doc_id").alias("first"), "m.sig")
                     .withColumn("id", F.monotonically_increasing_id()), "dup-classes")
    reps = classes.where("sig IS NOT NULL").select("id", "sig")
    cuts = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)),
                       lambda i: F.xxhash64(i, F.col("sig").substr(i * (2 * ROWS) + 1, F.lit(2 * ROWS))))
    bands = reps.select("id", F.explode(cuts).alias("bk"))
    buckets = bands.groupBy("bk").agg(F.min("id").alias("lead"), F.count(F.lit(1)).alias("n")) \
        .where("n > 1").select("bk", "lead")
    members = landed(bands.join(buckets, "bk"), "dup-members")
    texts = docs.select(F.col(key).cast("long").alias("first"), F.col(text).alias("t")) \
        .where("first IS NOT NULL AND t IS NOT NULL")
    touched = members.select("id").distinct().join(classes.select("id", "first", "k"), "id")
    texts = landed(texts.join(touched, "first").where(F.unhex(F.md5(F.encode("t", "UTF-8"))) == F.col("k"))
                   .dropDuplicates(["id"]).select("id", "t"), "dup-texts", "snappy")
    stars = members.where("id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct()
    links = landed(checked(stars, texts, similarity, weights), "dup-links")
    named = components(links)

    # candidate groups (texts joined by shared buckets) that still hold several components
    groups = components(stars).select("id", F.col("component").alias("grp"))
    seen = landed(groups.join(named, "id", "left").select("grp", "id", F.coalesce("component", "id").alias("comp")),
                  "dup-groups")
    largest = seen.groupBy("grp", "comp").agg(F.count(F.lit(1)).alias("n")) \
        .groupBy("grp").agg(F.max(F.struct("n", "comp"))["comp"].alias("top"), F.count(F.lit(1)).alias("comps")) \
        .where("comps > 1").select("grp", "top")
    rest = seen.join(largest, "grp").select("grp", (F.col("comp") == F.col("top")).cast("int").alias("main"), "id",
                                            "comp")
    rest = landed(rest.join(reps, "id").join(texts, "id"), "dup-rest", "snappy")
    if not rest.isEmpty():
        links = links.unionByName(landed(compared(rest, similarity, weights), "dup-links"))
        named = components(links)

    group = landed(classes.join(named, "id", "left").select("k", "first", F.coalesce("component", "id").alias("c")),
                   "dup-named")
    lowest = group.groupBy("c").agg(F.min("first").alias("component"), F.count(F.lit(1)).alias("copies"))
    group = hot_join(group, lowest, ["c"], "copies", ["k"])
    back = sigs.select("doc_id", "k").distinct().join(group, "k")
    fate = back.groupBy("doc_id").agg(F.min("first").alias("class_id"), F.min("component").alias("component_id"))
    ids = docs.select(F.col(key).cast("long").alias("doc_id"))
    out = ids.join(fate, "doc_id", "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"),
                      F.coalesce("component_id", "doc_id").alias("component_id"),
                      F.coalesce(F.col("doc_id") == F.coalesce("component_id", "doc_id"), F.lit(True)).alias("kept"))
