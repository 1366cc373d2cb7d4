"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors with cosine >= t have a squared distance of at most 2 (1 - t).
After a rotation the coordinates are split into blocks; two such vectors are
within the block's proportional share of that distance in at least one block.
Each block is range-joined under its share: vectors are cut into strips along
the block's first coordinate, and only strips that are within reach meet. A
pair belongs to the first block whose share it keeps, so the union needs no
``distinct``; the cosine of every pair of the union is then computed in double
precision from the stored components, whatever their type.

Tasks return, per vector, how many links it has in the task and the smallest
id it is connected to there - never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evtab.llm.components import components
from evtab.llm.util import landed

#: Vectors of a strip part (a task holds two parts), and rows compared at a time.
PART_ROWS = 8192
CHUNK_ROWS = 512
BLOCKS = 4
#: Room for rounding: filters let pairs pass that are so little too far.
SLACK = 1e-6


def rotation(width: int, seed: int = 5) -> np.ndarray:
    """A random orthogonal matrix, the same for every run."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, width)))
    return q * np.sign(np.diag(r))


def block_edges(width: int, blocks: int = BLOCKS) -> list[tuple[int, int]]:
    cuts = [round(width * i / blocks) for i in range(blocks + 1)]
    return [(a, b) for a, b in zip(cuts, cuts[1:]) if b > a]


def _unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 (by their largest component first: no overflow)."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _linked(a: np.ndarray, b: np.ndarray, same: bool, block: int, edges: list[tuple[int, int]],
            turn: np.ndarray, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of linked pairs that belong to ``block``, chunk by chunk."""
    limit, width = 2 * (1 - cosine), a.shape[1]
    ra, rb = a @ turn, b @ turn
    share = [limit * (q - p) / width for p, q in edges]

    def lifted(x: np.ndarray, k: int, left: bool) -> np.ndarray:
        """Block k of x with two more columns: their product is minus half the squared distance."""
        part = x[:, slice(*edges[k])]
        half = -0.5 * (part * part).sum(axis=1, keepdims=True)
        one = np.ones_like(half)
        return np.hstack([part, half, one] if left else [part, one, half])

    left, right = lifted(ra, block, True).astype(np.float32), lifted(rb, block, False).astype(np.float32).T.copy()
    for s in range(0, len(a), CHUNK_ROWS):
        e = min(len(a), s + CHUNK_ROWS)
        near = left[s:e] @ right >= np.float32(-0.5 * share[block] - 1e-5)
        if same:
            near &= np.arange(len(b)) > np.arange(s, e)[:, None]
        if not near.any():
            continue
        rows = np.flatnonzero(near.any(axis=1))
        cols = np.flatnonzero(near.any(axis=0))
        part_a, part_b = rows + s, cols
        hit = near[np.ix_(rows, cols)] & (a[part_a] @ b[part_b].T >= cosine)
        for k in range(block + 1):       # the pair is the first block's whose share it keeps
            within = lifted(ra[part_a], k, True) @ lifted(rb[part_b], k, False).T >= -0.5 * share[k] - SLACK
            hit &= within if k == block else ~within
        i, j = np.nonzero(hit)
        yield part_a[i], part_b[j]


class Forest:
    """Components of the rows of a task; pairs arrive in arrays."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        a, b = self.root[i], self.root[j]
        a, b = a[a != b], b[a != b]
        up = np.arange(len(self.root))
        while len(a):
            low = np.minimum(up[a], up[b])
            if (up[a] == low).all() and (up[b] == low).all():
                break
            np.minimum.at(up, a, low)
            np.minimum.at(up, b, low)
        self.root = up[self.root]

    def smallest(self, ids: np.ndarray) -> np.ndarray:
        """Smallest id of each row's component."""
        low = ids.copy()
        np.minimum.at(low, self.root, ids)
        return low[self.root]


def links(vectors: DataFrame, width: int, cosine: float, part_rows: int = PART_ROWS) -> DataFrame:
    """``id, n, low``: per task, links of each linked id (weighted by ``copies``) and its smallest connected id.

    ``vectors`` (``id, copies, v``) holds non-zero vectors; shorter ones are
    filled up with zeros to ``width``.
    """
    edges = block_edges(width)
    turn = rotation(width)
    strips = max(1, -(-vectors.count() // part_rows))
    kind = np.float32 if vectors.schema["v"].dataType.elementType.simpleString() == "float" else np.float64
    reach = [float(np.sqrt(2 * (1 - cosine) * (q - p) / width) + SLACK) for p, q in edges]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.zeros((batch.num_rows, width), dtype=kind)
            for i, v in enumerate(batch.column(2).to_pylist()):
                rows[i, :len(v)] = v
            at = _unit(rows.astype(np.float64)) @ turn[:, [p for p, _ in edges]]
            packed = pa.array([r.tobytes() for r in rows], pa.binary())
            for k in range(len(edges)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(rows), k), pa.int32()), pa.array(at[:, k], pa.float64()),
                     batch.column(0), batch.column(1), packed], names=["block", "at", "id", "copies", "v"])

    placed = landed(vectors.select("id", "copies", "v").mapInArrow(
        place, "block int, at double, id long, copies long, v binary"), "vec-placed")
    # strips of about part_rows vectors; where the cuts lie only balances the work
    share = [(i + 1) / strips for i in range(strips - 1)]
    cuts = {r["block"]: r["cuts"] for r in placed.groupBy("block").agg(
        F.percentile_approx("at", share, 10_000).alias("cuts")).collect()} if share else {}
    bounds = [np.unique(cuts.get(k) or []) for k in range(len(edges))]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, at = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            strip = np.zeros(len(at), dtype=np.int64)
            for k, b in enumerate(bounds):
                strip[block == k] = np.searchsorted(b, at[block == k], side="right")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(strip), *batch.columns[1:]],
                                             names=["block", "strip", "at", "id", "copies", "v"])

    dealt = placed.mapInArrow(deal, "block int, strip long, at double, id long, copies long, v binary")
    # a strip that holds more (many equal coordinates) is cut into parts by a hash of the id
    sizes = dealt.groupBy("block", "strip").agg(F.ceil(F.count(F.lit(1)) / part_rows).alias("parts"))
    # the join leaves all of a strip in one partition: deal the parts anew
    cut = dealt.join(sizes, ["block", "strip"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))) \
        .repartition("block", "strip", "part")

    def pack(t: pa.Table) -> pa.Table:
        at, ids = t.column("at").to_numpy(), t.column("id").to_numpy()
        order, v = np.argsort(ids), t.column("v").to_pylist()
        first = {c: [t.column(c)[0].as_py()] for c in ("block", "strip", "part")}
        return pa.table(first | {"low": [float(at.min())], "high": [float(at.max())], "ids": [ids[order].tobytes()],
                                 "copies": [t.column("copies").to_numpy()[order].tobytes()],
                                 "rows": [b"".join(v[i] for i in order)]},
                        schema=pa.schema([("block", pa.int32()), ("strip", pa.int64()), ("part", pa.int64()),
                                          ("low", pa.float64()), ("high", pa.float64()), ("ids", pa.binary()),
                                          ("copies", pa.binary()), ("rows", pa.binary())]))

    packs = landed(cut.select("block", "strip", "part", "at", "id", "copies", "v").groupBy("block", "strip", "part")
                   .applyInArrow(pack, "block int, strip long, part long, low double, high double, "
                                       "ids binary, copies binary, rows binary"), "vec-packs")
    # a pack meets itself and the later packs that begin within its reach
    heads = packs.select("block", "strip", "part", "low", "high")
    other = heads.toDF("block", "strip2", "part2", "low2", "high2")
    far = F.element_at(F.array(*[F.lit(x) for x in reach]), F.col("block") + 1)
    begins, ends = F.struct("low", "strip", "part"), F.struct("low2", "strip2", "part2")
    pairs = heads.join(other, "block").where((begins <= ends) & (F.col("low2") <= F.col("high") + far)) \
        .select("block", "strip", "part", "strip2", "part2")
    mine = packs.select("block", "strip", "part", "ids", "copies", "rows")
    met = pairs.join(mine, ["block", "strip", "part"]) \
        .join(mine.toDF("block", "strip2", "part2", "ids2", "copies2", "rows2"), ["block", "strip2", "part2"])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cells in zip(*batch.columns, strict=True):
                block, same, i1, c1, r1, i2, c2, r2 = (c.as_py() for c in cells)
                ids = np.frombuffer(i1 if same else i1 + i2, np.int64)
                weight = np.frombuffer(c1 if same else c1 + c2, np.int64)
                a, b = (_unit(np.frombuffer(x, kind).astype(np.float64).reshape(-1, width)) for x in (r1, r2))
                shift = 0 if same else len(a)
                forest, n = Forest(len(ids)), np.zeros(len(ids), dtype=np.int64)
                for i, j in _linked(a, b, same, block, edges, turn, cosine):
                    j = j + shift
                    n += np.bincount(i, weights=weight[j], minlength=len(ids)).astype(np.int64)
                    n += np.bincount(j, weights=weight[i], minlength=len(ids)).astype(np.int64)
                    forest.join(i, j)
                hit = n > 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[hit]), pa.array(n[hit]), pa.array(forest.smallest(ids)[hit])],
                    names=["id", "n", "low"])

    same = (F.col("strip") == F.col("strip2")) & (F.col("part") == F.col("part2"))
    return met.select("block", same.alias("same"), "ids", "copies", "rows", "ids2", "copies2", "rows2") \
        .mapInArrow(match, "id long, n long, low long")


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, vec_id: str = "vec_id",
                    vector: str = "embedding", part_rows: int = PART_ROWS) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every id.

    Vectors that are null, empty, all zero, or hold null or non-finite
    components link with nothing. An id that repeats counts once, with its
    smallest vector; rows without id give no row; shorter vectors are filled
    up with zeros. Equal vectors form a class first: only its smallest id is
    joined, its copies count as links and share its component. An empty table
    gives no row; other columns are ignored.
    """
    x = F.col(vector)
    good = x.isNotNull() & F.forall(x, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) != float("inf")), F.lit(False))) \
        & F.exists(x, lambda e: F.coalesce(e != 0, F.lit(False)))
    rows = landed(vectors.where(F.col(vec_id).isNotNull())
                  .select(F.col(vec_id).cast("long").alias("vec_id"), F.when(good, x).alias("v"))
                  .groupBy("vec_id").agg(F.min("v").alias("v")), "vec-rows")
    valid = rows.where("v IS NOT NULL")
    classes = landed(valid.groupBy("v").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies")),
                     "vec-classes")
    width = classes.agg(F.max(F.size("v"))).first()[0]
    if not width:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
                           F.lit(True).alias("kept"))
    found = landed(links(classes, width, cosine, part_rows), "vec-links")
    named = components(found.select(F.col("id").alias("a"), F.col("low").alias("b")))
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    known = classes.join(counts, "id", "left").join(named, "id", "left").select(
        "v", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "id").alias("component_id"))
    return rows.join(known, "v", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        (F.col("vec_id") == F.coalesce("component_id", "vec_id")).alias("kept"))
