"""Linear SVM with squared hinge loss (l1 or l2 penalty), trained by proximal Newton steps.

Objective (liblinear's primal, bias as a penalised constant feature):
    R(w) + sum_i c_i * max(0, 1 - y_i (w . x_i + b))^2
with R = ||w||_1 (l1) or ||w||^2 / 2 (l2), y in {-1, 1} and
c_i = C * class_weight(y_i) * sample_weight_i.

Spark ML's ``LinearSVC`` minimises plain hinge loss with an l2 penalty only,
so it cannot reproduce this model. The training rows are packed once into
blocks of sparse rows, one binary record each, and checkpointed (lineage cut,
survives executor loss).

The loss is quadratic between the margins where a row starts or stops to
count, so a step solves the penalised quadratic of the current rows exactly. A
step takes two jobs: the second derivatives of the working set (features that
are in the model, or would enter it; at most ``working`` of them), then the
losses along the step and the gradient at its end. Tasks return partial sums
in slices that meet in an aggregate; the driver holds one number per feature
and one small matrix. Features beyond the working set wait for a later step;
with the l2 penalty, where every feature is in the model, a step beyond it
is solved by conjugate gradients, one job per product.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evtab.operators.features import class_weights
from evtab.operators.sums import summed
from evtab.session import checkpoint_dir

#: Rows and cells of a packed block, features of one working set.
BLOCK_ROWS, BLOCK_CELLS = 2048, 2_000_000
WORKING = 2048
#: Step lengths tried in one job.
STEPS = 0.5 ** np.arange(14)
#: Times a step is solved, at most, each with the rows it ran into.
TRIES = 6


@dataclass
class LinearModel:
    weights: np.ndarray   # one per feature column
    bias: float
    objective: float
    iterations: int
    converged: bool
    jobs: int = 0         # passes over the training rows

    def weights_df(self, spark) -> DataFrame:
        nz = np.nonzero(self.weights)[0]
        pdf = pd.DataFrame({"col": nz.astype("int64"), "w": self.weights[nz].astype("float64")})
        return spark.createDataFrame(pdf, "col long, w double")


def training_records(cells: DataFrame, rows: DataFrame, C: float = 1.0, balanced: bool = True,
                     sample_weight: str | None = None, label: str = "label") -> DataFrame:
    """(row, y, c, cols, vals): one sparse record per training row."""
    r = class_weights(rows, label, sample_weight, "_cw") if balanced else \
        rows.withColumn("_cw", F.col(sample_weight) if sample_weight else F.lit(1.0))
    r = r.select("row", (F.col(label) * 2 - 1).cast("double").alias("y"), (F.col("_cw") * C).alias("c"))
    sp = cells.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("col", "value"))).alias("_cv"))
    j = r.join(sp, "row", "left")
    empty = F.array().cast("array<struct<col:long,value:double>>")
    cv = F.coalesce(F.col("_cv"), empty)
    return j.select("row", "y", "c", cv["col"].alias("cols"), cv["value"].alias("vals"))


def packed_blocks(recs: DataFrame) -> DataFrame:
    """(y, c, ends, cols, vals): blocks of rows as raw arrays, in the partitions the rows are in."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = size = 0

        def out() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            cols, vals = (t.column(k).combine_chunks() for k in ("cols", "vals"))
            ends = np.cumsum(np.diff(cols.offsets.to_numpy()), dtype=np.int64)
            arrays = [t.column("y").to_numpy().astype("<f8"), t.column("c").to_numpy().astype("<f8"), ends,
                      cols.flatten().to_numpy(zero_copy_only=False).astype("<i8"),
                      vals.flatten().to_numpy(zero_copy_only=False).astype("<f8")]
            return pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in arrays],
                                              names=["y", "c", "ends", "cols", "vals"])

        for batch in batches:
            for at in range(0, len(batch), 256):
                held.append(batch.slice(at, 256))
                rows += len(held[-1])
                size += len(held[-1].column(2).flatten())
                if rows >= BLOCK_ROWS or size >= BLOCK_CELLS:
                    yield out()
                    held, rows, size = [], 0, 0
        if held:
            yield out()

    return recs.select("y", "c", "cols", "vals").mapInArrow(
        pack, "y binary, c binary, ends binary, cols binary, vals binary")


@dataclass
class Block:
    """Sparse training rows: labels, weights, and (row, col, value) cells in row order."""
    y: np.ndarray
    c: np.ndarray
    row: np.ndarray
    col: np.ndarray
    val: np.ndarray

    @classmethod
    def of(cls, y: bytes, c: bytes, ends: bytes, cols: bytes, vals: bytes) -> Block:
        n = np.diff(np.frombuffer(ends, "<i8"), prepend=0)
        return cls(np.frombuffer(y, "<f8"), np.frombuffer(c, "<f8"), np.repeat(np.arange(len(n)), n),
                   np.frombuffer(cols, "<i8"), np.frombuffer(vals, "<f8"))

    def times(self, x: np.ndarray) -> np.ndarray:
        """Rows times ``x``, whose last entry is the bias."""
        return np.bincount(self.row, weights=self.val * x[self.col], minlength=len(self.y)) + x[-1]

    def times_rows(self, r: np.ndarray, size: int) -> np.ndarray:
        """``r`` times the rows, the bias last."""
        return np.append(np.bincount(self.col, weights=self.val * r[self.row], minlength=size - 1), r.sum())

    def losses(self, z: np.ndarray, u: np.ndarray | None, steps: np.ndarray) -> np.ndarray:
        out = []
        for t in steps if u is not None else (0.0,):
            h = np.maximum(0.0, 1.0 - self.y * (z if u is None else z + t * u))
            out.append(float(np.sum(self.c * h * h)))
        return np.array(out)

    def gradient(self, z: np.ndarray, size: int) -> np.ndarray:
        h = np.maximum(0.0, 1.0 - self.y * z)
        return self.times_rows(-2.0 * self.c * h * self.y, size)

    def counts(self, *at: np.ndarray) -> np.ndarray:
        """Rows inside their margin at one of the points (rows times each) or more."""
        on = self.y * at[0] < 1
        for z in at[1:]:
            on |= self.y * z < 1
        return on

    def gram(self, on: np.ndarray, working: np.ndarray, size: int) -> np.ndarray:
        place = np.full(size, -1, dtype=np.int64)
        place[working] = np.arange(len(working))
        a = np.zeros((len(self.y), len(working)))
        at = place[self.col]
        hit = at >= 0
        a[self.row[hit], at[hit]] = self.val[hit]
        if place[-1] >= 0:
            a[:, place[-1]] = 1.0
        a = a[on]
        full = (a * (2.0 * self.c[on])[:, None]).T @ a
        return full[np.triu_indices(len(working))].astype("<f4")


class Problem:
    """The loss over packed blocks; every method is one job. ``size``: features and the bias."""

    def __init__(self, blocks: DataFrame, size: int) -> None:
        self.blocks, self.size, self.jobs = blocks, size, 0

    def _run(self, part, *vectors: np.ndarray | list[np.ndarray] | None) -> np.ndarray:
        self.jobs += 1
        sent = self.blocks.sparkSession.sparkContext.broadcast(vectors)
        try:
            return summed(self.blocks, lambda *cells: part(Block.of(*cells), *sent.value))
        finally:
            sent.unpersist()

    def along(self, x: np.ndarray, d: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Losses at ``x + t d`` for the ``STEPS`` t, and the gradient at the first of them (without ``d``: at x)."""
        size, steps = self.size, STEPS

        def part(b: Block, x: np.ndarray, d: np.ndarray | None) -> np.ndarray:
            z, u = b.times(x), None if d is None else b.times(d)
            return np.append(b.losses(z, u, steps), b.gradient(z if u is None else z + steps[0] * u, size))
        out = self._run(part, x, d)
        return out[:-size], out[-size:]

    def gram(self, x: np.ndarray, others: list[np.ndarray], working: np.ndarray) -> np.ndarray:
        """Second derivatives of the loss at ``x`` over the working set; rows that count at one of ``others`` count, too.

        They only direct a step, so half of them in single precision travel.
        """
        size = self.size

        def part(b: Block, x: np.ndarray, others: list[np.ndarray], working: np.ndarray) -> np.ndarray:
            on = b.counts(b.times(x), *(b.times(o) for o in others))
            return b.gram(on, working, size).ravel()
        upper = np.zeros((len(working), len(working)))
        upper[np.triu_indices(len(working))] = self._run(part, x, others, working)
        return upper + np.triu(upper, 1).T

    def curved(self, x: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Second derivatives of the loss at ``x`` times ``v``."""
        size = self.size

        def part(b: Block, x: np.ndarray, v: np.ndarray) -> np.ndarray:
            on = b.counts(b.times(x))
            return b.times_rows(np.where(on, 2.0 * b.c * b.times(v), 0.0), size)
        return self._run(part, x, v)


def _slope(x: np.ndarray, g: np.ndarray, penalty: str) -> np.ndarray:
    """Gradient; with l1 the subgradient of smallest norm (``g``: gradient of the loss)."""
    if penalty == "l2":
        return g + x
    return np.where(x != 0, g + np.sign(x), np.sign(g) * np.maximum(np.abs(g) - 1.0, 0.0))


def _fine(x: np.ndarray, penalty: str) -> float:
    return float(np.abs(x).sum()) if penalty == "l1" else 0.5 * float(x @ x)


def solve_l1(g: np.ndarray, h: np.ndarray, x: np.ndarray, tol: float, rounds: int = 60) -> np.ndarray:
    """Step d that minimises ``g.d + d.h.d / 2 + |x + d|_1``, by sweeps over the entries that are set or would be."""
    w, r, diag = x.copy(), g.copy(), np.diag(h).copy()
    for _ in range(rounds):
        for j in np.flatnonzero((w != 0) | (np.abs(r) > 1)).tolist():
            old, step = w[j], 1.0 / diag[j]
            u = old - r[j] * step
            new = u - step if u > step else u + step if u < -step else 0.0
            if new != old:
                w[j] = new
                r += (new - old) * h[j]
        if np.linalg.norm(_slope(w, r, "l1")) <= tol:
            break
    return w - x


def _conjugate(product, b: np.ndarray, tol: float, steps: int) -> np.ndarray:
    """Solves ``product(d) = b`` to ``tol``."""
    d, r = np.zeros_like(b), b.copy()
    p, rr = r.copy(), float(r @ r)
    for _ in range(steps):
        if rr <= tol * tol:
            break
        q = product(p)
        a = rr / float(p @ q)
        d += a * p
        r -= a * q
        rr, old = float(r @ r), rr
        p = r + (rr / old) * p
    return d


def minimise(problem, penalty: str, max_iter: int, tol: float, working: int = WORKING):
    """(x, objective, iterations, converged) of ``loss + penalty`` from zero.

    Stops when the (pseudo-)gradient has shrunk to ``tol`` times its first norm."""
    x = np.zeros(problem.size)
    losses, g = problem.along(x)
    value = float(losses[0])
    first = float(np.linalg.norm(_slope(x, g, penalty)))
    ran = None                               # the last step that ran into rows its quadratic had left out
    for it in range(max_iter + 1):
        pg = _slope(x, g, penalty)
        norm = float(np.linalg.norm(pg))
        if norm <= tol * first:
            return x, value, it, True
        if it == max_iter:
            break
        goal = min(0.1, norm / first) * norm
        by_products = penalty == "l2" and problem.size > working
        chosen = np.flatnonzero((x != 0) | (np.abs(g) > 0.9)) if penalty == "l1" else np.arange(problem.size)
        if len(chosen) > working:
            chosen = np.sort(chosen[np.argsort(-np.abs(pg[chosen]), kind="stable")[:working]])
        others = [] if ran is None else [x + ran]
        for _ in range(TRIES):
            d = np.zeros_like(x)
            if by_products:
                d = _conjugate(lambda v, x=x: problem.curved(x, v) + v, -pg, goal, 50)
            else:
                h = problem.gram(x, others, chosen)
                if penalty == "l2":
                    d[chosen] = np.linalg.solve(h + np.eye(len(chosen)), -pg[chosen])
                else:
                    h[np.diag_indices(len(chosen))] += 1e-10 * max(1.0, float(np.trace(h)) / len(chosen))
                    d[chosen] = solve_l1(g[chosen], h, x[chosen], goal)
            fall = float(g @ d) + _fine(x + d, penalty) - _fine(x, penalty)
            losses, g_full = problem.along(x, d)
            values = losses + np.array([_fine(x + t * d, penalty) for t in STEPS])
            good = np.flatnonzero(values <= value + 1e-4 * STEPS * fall) if fall < 0 else []
            # far short of a whole step: it ran into rows the quadratic had left out, so count them and solve again;
            # those of earlier trials still count, else the step swings between two sets of rows
            if by_products or (len(good) and good[0] <= 2):
                break
            ran = d
            others.append(x + d)
        if not len(good):
            return x, value, it, False       # no step lowers the objective, and ``tol`` is not met
        at = int(good[0])
        x = x + STEPS[at] * d
        value = float(values[at])
        g = g_full if at == 0 else problem.along(x)[1]
    return x, value, max_iter, False


def fit_linear_svc(cells: DataFrame, rows: DataFrame, n_features: int, C: float = 1.0, penalty: str = "l2",
                   balanced: bool = True, sample_weight: str | None = None, max_iter: int = 1000,
                   tol: float = 1e-4, label: str = "label", on_unconverged: str = "error",
                   working: int = WORKING) -> LinearModel:
    """Squared-hinge linear SVM. ``cells`` (row, col, value) with
    0 <= col < n_features; ``rows`` (row, label 0/1[, sample weight]).

    One distributed path whatever the size. A fit that has not met ``tol``
    within ``max_iter`` steps fails (``on_unconverged='error'``) or comes back
    with ``converged`` false (``'report'``)."""
    if penalty not in ("l1", "l2"):
        raise ValueError("penalty must be 'l1' or 'l2'")
    if on_unconverged not in ("error", "report"):
        raise ValueError("on_unconverged must be 'error' or 'report'")
    spark = rows.sparkSession
    checkpoint_dir(spark, fallback=_local_fallback(spark))
    recs = training_records(cells, rows, C, balanced, sample_weight, label)
    cores = spark.sparkContext.defaultParallelism
    if recs.rdd.getNumPartitions() < cores:          # a step is bound by arithmetic, however small the rows are
        recs = recs.repartition(cores)
    blocks = packed_blocks(recs).checkpoint(eager=True).persist()
    try:
        problem = Problem(blocks, n_features + 1)
        x, value, it, converged = minimise(problem, penalty, max_iter, tol, working)
    finally:
        blocks.unpersist()
    if not converged and on_unconverged == "error":
        raise RuntimeError(f"no convergence within {max_iter} steps; raise max_iter or tol")
    return LinearModel(x[:-1], float(x[-1]), value, it, converged, problem.jobs)


def _local_fallback(spark):
    from evtab.operators.features import _local_fallback as lf
    return lf(spark)
