"""Model outputs -> predictions; weighted loss; the classification head, applied and fitted.

Logits arrive as a table (``array<double>`` per row, or per token); all of it
is built-in array math except the head, whose matrix products run as an
Arrow-batched pandas UDF with the (bounded, model-sized) weights in the
closure. The fit packs the vectors into blocks once; every step is one job in
which tasks propagate their blocks back and add up one gradient, and the driver
moves the parameters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evtab.functions.arrays import argmax, logsumexp, max_softmax
from evtab.operators.sums import summed


def logit_predictions(df: DataFrame, logits: str = "logits") -> DataFrame:
    """pred = argmax (first on a tie), prob = max softmax probability."""
    return df.withColumn("pred", argmax(logits)).withColumn("prob", max_softmax(logits))


def cross_entropy(logits: str = "logits", label: str = "label") -> Column:
    z = F.col(logits).cast("array<double>")
    return logsumexp(z) - F.element_at(z, F.col(label) + 1)


def weighted_log_loss(df: DataFrame, logits: str = "logits", label: str = "label",
                      weight: str | None = None, by=()) -> DataFrame:
    """mean(weight x cross-entropy) over rows -- divided by the row count,
    not the weight sum (as the reference); plain mean without weights.
    With weights, ``loss_plain`` (the unweighted mean) comes in the same pass."""
    ce = cross_entropy(logits, label)
    if not weight:
        return df.groupBy(*by).agg(F.avg(ce).alias("loss"))
    return df.groupBy(*by).agg(F.avg(ce * F.col(weight)).alias("loss"), F.avg(ce).alias("loss_plain"))


def score_head(df: DataFrame, vector: str, w1: np.ndarray, b1: np.ndarray, w2: np.ndarray,
               b2: np.ndarray, out: str = "logits") -> DataFrame:
    """dense -> tanh -> dense on one vector per row (inference: no dropout).
    ``w1``: (hidden, dim), ``w2``: (classes, hidden), torch Linear layout."""
    w1 = np.asarray(w1, dtype="float64")
    b1 = np.asarray(b1, dtype="float64")
    w2 = np.asarray(w2, dtype="float64")
    b2 = np.asarray(b2, dtype="float64")

    @F.pandas_udf("array<double>")
    def head(v: pd.Series) -> pd.Series:
        if len(v) == 0:
            return pd.Series([], dtype=object)
        x = np.stack([np.asarray(a, dtype="float64") for a in v])
        h = np.tanh(x @ w1.T + b1)
        z = h @ w2.T + b2
        return pd.Series(list(z))

    return df.withColumn(out, head(F.col(vector)))


@dataclass
class Head:
    """dense -> tanh -> dense, in torch Linear layout; ``losses``: the training loss before every step."""
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    losses: list[float] = field(default_factory=list)

    @classmethod
    def new(cls, dim: int, hidden: int, classes: int, seed: int = 0) -> Head:
        rng = np.random.default_rng(seed)
        return cls(rng.normal(size=(hidden, dim)) / np.sqrt(dim), np.zeros(hidden),
                   rng.normal(size=(classes, hidden)) / np.sqrt(hidden), np.zeros(classes))

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in (self.w1, self.b1, self.w2, self.b2)])

    def with_flat(self, x: np.ndarray) -> Head:
        out, at = [], 0
        for p in (self.w1, self.b1, self.w2, self.b2):
            out.append(x[at:at + p.size].reshape(p.shape))
            at += p.size
        return Head(*out, losses=self.losses)

    def score(self, df: DataFrame, vector: str, out: str = "logits") -> DataFrame:
        return score_head(df, vector, self.w1, self.b1, self.w2, self.b2, out)


def head_gradient(head: Head, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Sums over rows: weighted cross-entropy, number of rows, then the loss's gradient in the order of ``flat``."""
    h = np.tanh(x @ head.w1.T + head.b1)
    z = h @ head.w2.T + head.b2
    z -= z.max(axis=1, keepdims=True)
    e = np.exp(z)
    total = e.sum(axis=1)
    rows = np.arange(len(y))
    loss = float(np.sum(weight * (np.log(total) - z[rows, y])))
    dz = e / total[:, None]
    dz[rows, y] -= 1.0
    dz *= weight[:, None]
    dh = (dz @ head.w2) * (1.0 - h * h)
    parts = [np.array([loss, float(len(y))]), (dh.T @ x).ravel(), dh.sum(axis=0), (dz.T @ h).ravel(), dz.sum(axis=0)]
    return np.concatenate(parts)


def packed_vectors(df: DataFrame, vector: str, label: str, weight: str | None) -> DataFrame:
    """(x, y, w): blocks of rows as raw arrays, in the partitions the rows are in. Rows without a vector, a label or a
    weight are left out; vectors of two lengths fail."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch.slice(at, 4096)
                x = part.column(0).flatten().to_numpy(zero_copy_only=False).astype("<f8")
                if len(x) % len(part) or any(len(v) * len(part) != len(x) for v in part.column(0)):
                    raise ValueError("vectors of different lengths")
                cells = [x, part.column(1).to_numpy().astype("<i8"), part.column(2).to_numpy().astype("<f8")]
                yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in cells],
                                                 names=["x", "y", "w"])

    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.select(F.col(vector).cast("array<double>").alias("v"), F.col(label).cast("long").alias("l"), w.alias("w"))
    return rows.where("v IS NOT NULL AND l IS NOT NULL AND w IS NOT NULL").mapInArrow(pack, "x binary, y binary, w binary")


def fit_head(df: DataFrame, vector: str, label: str = "label", weight: str | None = None, hidden: int = 16,
             classes: int = 2, steps: int = 100, rate: float = 0.02, seed: int = 0, tol: float = 1e-4) -> Head:
    """Fits the head to mean(weight x cross-entropy) over all rows, with Adam on whole-data gradients.

    Ends after ``steps`` steps, or when the gradient's norm is below ``tol``. A
    step is one job; what comes back is one number per parameter. Labels run
    from 0 to ``classes`` - 1; no usable row is an error.
    """
    from evtab.operators.features import _local_fallback
    from evtab.session import checkpoint_dir
    spark = df.sparkSession
    checkpoint_dir(spark, fallback=_local_fallback(spark))
    blocks = packed_vectors(df, vector, label, weight).checkpoint(eager=True).persist()
    try:
        first = blocks.first()
        if first is None:
            raise ValueError("no row with a vector, a label and a weight")
        dim = len(first["x"]) // len(first["y"])
        head = Head.new(dim, hidden, classes, seed)
        x, m, v = head.flat(), 0.0, 0.0
        for step in range(1, steps + 1):
            sent = spark.sparkContext.broadcast(head.with_flat(x))

            def part(vectors: bytes, labels: bytes, weights: bytes, sent=sent) -> np.ndarray:
                y = np.frombuffer(labels, "<i8")
                return head_gradient(sent.value, np.frombuffer(vectors, "<f8").reshape(len(y), -1), y,
                                     np.frombuffer(weights, "<f8"))
            got = summed(blocks, part)
            sent.unpersist()
            head.losses.append(float(got[0] / got[1]))
            g = got[2:] / got[1]
            if float(np.linalg.norm(g)) <= tol:
                break
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            x = x - rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        return head.with_flat(x)
    finally:
        blocks.unpersist()
