"""Blocked Bloom filters over 64-bit hashes: built by Spark, bounded in size.

A key sets one bit in each of the eight 32-bit lanes of one block, so a probe
touches one block. A filter never grows past ``MAX_BYTES``: beyond the keys it
has room for, more probes pass, and the exact join behind it removes them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS_PER_KEY = 16
#: Largest filter, and all filters of one broadcast together.
MAX_BYTES = 32 << 20
LANES, BLOCK_BYTES = 8, 32
#: Blocks that one task group builds.
CHUNK_BLOCKS = 256

_32, _27 = np.uint64(32), np.uint32(27)


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finalizer: every bit of the result depends on all bits of x."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SALTS = (mixed(np.arange(1, LANES + 1, dtype=np.uint64)) >> _32).astype(np.uint32) | np.uint32(1)


def blocks_for(keys: int, max_bytes: int = MAX_BYTES) -> int:
    return max(1, min(max_bytes // BLOCK_BYTES, math.ceil(keys * BITS_PER_KEY / (8 * BLOCK_BYTES))))


def block_of(h: np.ndarray, blocks: int) -> np.ndarray:
    return ((h >> _32) * np.uint64(blocks)) >> _32


def _bit(h: np.ndarray, lane: int) -> np.ndarray:
    return (h.astype(np.uint32) * _SALTS[lane]) >> _27


def add(lanes: np.ndarray, block: np.ndarray, h: np.ndarray) -> None:
    """Set the bits of ``h`` in ``lanes`` (blocks x 8)."""
    for lane in range(LANES):
        np.bitwise_or.at(lanes, (block, lane), np.uint32(1) << _bit(h, lane))


def probe(lanes: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places in ``h`` (ascending) that the filter holds, false positives included."""
    block = block_of(h, len(lanes)).astype(np.int64)
    at = np.arange(len(h))
    for lane in range(LANES):
        left = h[at]
        at = at[(lanes[block[at], lane] >> _bit(left, lane)) & np.uint32(1) == 1]
        if not len(at):
            break
    return at


def build(hashes: DataFrame, blocks: dict[int, int]) -> dict[int, np.ndarray]:
    """One filter per shard. ``hashes``: ``shard int, h long``; ``blocks``: blocks per shard.

    Hashes are shuffled by block range and every group builds its chunk; the
    driver joins the chunks, whose total size ``blocks`` fixes beforehand.
    """
    shape = pa.schema([("shard", pa.int32()), ("chunk", pa.int64()), ("bits", pa.binary())])

    def chunks(batches):
        for batch in batches:
            shard = batch.column(0).to_numpy()
            h = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            chunk = np.zeros(len(h), dtype=np.int64)
            for s in np.unique(shard):
                mine = shard == s
                chunk[mine] = block_of(h[mine], blocks[int(s)]).astype(np.int64) // CHUNK_BLOCKS
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(chunk), batch.column(1)],
                                             names=["shard", "chunk", "h"])

    def fill(table: pa.Table) -> pa.Table:
        shard, chunk = table.column("shard")[0].as_py(), table.column("chunk")[0].as_py()
        h = table.column("h").to_numpy().view(np.uint64)
        lanes = np.zeros((min(CHUNK_BLOCKS, blocks[shard] - chunk * CHUNK_BLOCKS), LANES), dtype=np.uint32)
        add(lanes, block_of(h, blocks[shard]).astype(np.int64) - chunk * CHUNK_BLOCKS, h)
        return pa.Table.from_pylist([{"shard": shard, "chunk": chunk, "bits": lanes.tobytes()}], schema=shape)

    dealt = hashes.select(F.col("shard").cast("int"), F.col("h")).where("h IS NOT NULL") \
        .mapInArrow(chunks, "shard int, chunk long, h long")
    made = dealt.groupBy("shard", "chunk").applyInArrow(fill, "shard int, chunk long, bits binary").collect()
    out = {s: np.zeros((n, LANES), dtype=np.uint32) for s, n in blocks.items()}
    for row in made:
        part = np.frombuffer(row["bits"], np.uint32).reshape(-1, LANES)
        start = row["chunk"] * CHUNK_BLOCKS
        out[row["shard"]][start:start + len(part)] = part
    return out
