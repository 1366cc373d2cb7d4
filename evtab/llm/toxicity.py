"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes of its words, of adjacent word pairs
and of word pairs with one word between. Training is online: every coordinate
has its own learning rate, and the L1 term keeps the weight of a coordinate at
zero until its gradients add up to more than noise. What is left is a short
list of weights, small enough to travel to every task.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Hash space of the features (a power of two).
DIMENSIONS = 1 << 20
#: Labelled rows that are learned from at most (the classifier's bounded sample) and passes over them.
SAMPLE_ROWS = 16_000
EPOCHS = 4
#: Learning rate scale, its smoothing, and the two penalties.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 8.0, 0.0
#: Words whose hash a worker remembers before it starts anew.
REMEMBERED = 400_000

_WORD = re.compile(r"\w+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(29)


class WordHash(dict):
    """32-bit hash of a word, remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        got = self[word] = xxhash.xxh32_intdigest(word)
        return got


def _pair(a: np.ndarray, b: np.ndarray, kind: int) -> np.ndarray:
    x = (a ^ np.uint64(kind)) * _MIX
    x ^= x >> _SHIFT
    x = (x + b) * _MIX
    return x ^ (x >> _SHIFT)


def word_hashes(text: str | None, known: WordHash) -> np.ndarray:
    """Hashes of the words of a text in order (none for null or wordless texts)."""
    return np.array([known[w] for w in _WORD.findall(text.lower())] if text else [], dtype=np.uint32)


def features(words: np.ndarray) -> np.ndarray:
    """Coordinates of words, adjacent pairs and skip pairs, repeats included."""
    h = words.astype(np.uint64)
    parts = [h * _MIX >> _SHIFT, _pair(h[:-1], h[1:], 1), _pair(h[:-2], h[2:], 2)]
    return (np.concatenate(parts) & np.uint64(DIMENSIONS - 1)).astype(np.int64) + 1


def sample(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
           rows: int = SAMPLE_ROWS) -> DataFrame:
    """``k, t, y``: about ``rows`` labelled texts at most, those with the smallest key hash.

    Labels other than 0 and 1, null labels, keys and texts teach nothing; a
    key that repeats teaches once per row.
    """
    marks = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")) \
        .where("k IS NOT NULL AND y IN (0, 1)")
    n = marks.count()
    if n > rows:
        place = F.pmod(F.xxhash64(F.col("k").cast("string")), F.lit(1 << 30))
        marks = marks.where(place < int(rows / n * (1 << 30)))
    texts = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where("k IS NOT NULL AND t IS NOT NULL")
    return texts.join(F.broadcast(marks), "k").select("k", "t", "y")  # marks: SAMPLE_ROWS rows of two numbers


class Ftrl:
    """State and update of the learner; coordinate 0 is the bias."""

    def __init__(self) -> None:
        self.z = np.zeros(DIMENSIONS + 1)
        self.n = np.zeros(DIMENSIONS + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == 0, 0.0, L1)
        w = -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) <= l1, 0.0, w)

    def learn(self, features: np.ndarray, label: int) -> None:
        at = np.concatenate(([0], features))
        w = self.weights(at)
        g = sigmoid(float(w.sum())) - label
        rate = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - rate * w
        self.n[at] += g * g


def sigmoid(x: float) -> float:
    return 1.0 / (1.0 + math.exp(-max(-35.0, min(35.0, x))))


def train(rows: DataFrame, epochs: int = EPOCHS) -> dict[int, float]:
    """Non-zero weights by coordinate (0: bias) from ``k, t, y`` rows.

    Texts are hashed in parallel; the learner itself is sequential and reads
    the bounded sample, one row at a time, in an order given by the key. At
    most ``DIMENSIONS`` weights come back.
    """
    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHash()
        for batch in batches:
            got = [word_hashes(t.as_py(), known).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(got, pa.binary())],
                                             names=["o", "y", "x"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Ftrl()
        for batch in batches:
            for y, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                model.learn(np.unique(features(np.frombuffer(x.as_py(), dtype=np.uint32))), y)
        at = np.flatnonzero(model.n)
        w = model.weights(at)
        yield pa.RecordBatch.from_arrays([pa.array(at[w != 0], pa.int64()), pa.array(w[w != 0], pa.float64())],
                                         names=["i", "w"])

    narrow = rows.select(F.xxhash64(F.lit(7), F.col("k").cast("string")).alias("o"), "t", "y")
    x = narrow.mapInArrow(words, "o long, y int, x binary")
    passes = x.withColumn("e", F.explode(F.sequence(F.lit(1), F.lit(epochs))))
    ordered = passes.repartition(1).sortWithinPartitions("e", F.xxhash64("e", "o"), "x", "y").select("y", "x")
    return {r["i"]: r["w"] for r in ordered.mapInArrow(fit, "i long, w double").collect()}


def score(docs: DataFrame, weights: dict[int, float], text: str = "text") -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on) to every row.

    A null, empty or wordless text gets the score of the bias alone; without
    any weight every score is 0 and nothing is predicted. Whole texts are read;
    rows stay in their partition. Input columns named like the new ones are
    replaced.
    """
    kept = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    out = T.StructType([docs.schema[c] for c in kept]) \
        .add("score", T.DoubleType()).add("predicted", T.IntegerType())
    names, at = out.fieldNames(), kept.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.zeros(DIMENSIONS + 1, dtype=np.float32)
        for i, x in shared.value.items():
            w[i] = x
        bias, known = shared.value.get(0, 0.0), WordHash()

        def one(t: str | None) -> float:
            if not shared.value:
                return 0.0
            x = features(word_hashes(t, known))
            hit = np.unique(x[w[x] != 0])
            return sigmoid(bias + float(w[hit].sum(dtype=np.float64)))

        for batch in batches:
            got = [one(t.as_py()) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.float64()),
                                              pa.array([int(s >= 0.5) for s in got], pa.int32())], names=names)

    return docs.select(*kept).mapInArrow(run, out)
