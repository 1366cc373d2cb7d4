"""Vector sums over a table of packed blocks: the one job of an iterative fit."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Numbers of one slice of a partial sum.
SLICE = 65536


def summed(blocks: DataFrame, part: Callable[..., np.ndarray]) -> np.ndarray:
    """Sum over all rows of ``part(*cells)``, a vector of one length and type for all.

    A task adds up its rows and hands on slices of its sum; slices meet in an
    aggregate, so the driver receives one vector however many tasks there are.
    """
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for cells in zip(*batch.columns, strict=True):
                got = part(*(c.as_py() for c in cells))
                total = got if total is None else total + got
        if total is not None:
            for k, at in enumerate(range(0, len(total), SLICE)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k], pa.int64()), pa.array([total.dtype.str]),
                     pa.array([total[at:at + SLICE].tobytes()], pa.binary())], names=["slice", "kind", "sums"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(s.as_py(), table.column("kind")[0].as_py()).astype("<f8") for s in table.column("sums"))
        return pa.table({"slice": table.column("slice")[:1], "sums": pa.array([total.tobytes()], pa.binary())})

    rows = blocks.mapInArrow(partial, "slice long, kind string, sums binary").groupBy("slice") \
        .applyInArrow(add, "slice long, sums binary").collect()
    return np.concatenate([np.frombuffer(r["sums"]) for r in sorted(rows, key=lambda r: r["slice"])] or [np.zeros(0)])
