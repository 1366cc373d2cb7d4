"""Sentence tagger: a hidden Markov model counted by Spark, decoded sentence by sentence.

The counts are aggregates (first tags, tag pairs, tags of every token), smoothed
by one. Scores are logarithms in whole millionths, so sums are exact and equal
paths are ties; of equal paths, the one whose tags come first in the list wins,
compared from the sentence's end. A token that training did not have scores as
one seen never with any tag.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evtab.operators.corpus import SENTENCE_KEY
from evtab.operators.features import _local_fallback
from evtab.session import landed

#: Tags a model may have: the driver holds a number per pair of tags.
MAX_TAGS = 512
#: Scores of steps (sentences times pairs of tags) decoded at a time.
PATHS = 2_000_000


def millionths(p: Column) -> Column:
    return F.round(F.log(p) * 1_000_000).cast("long")


@dataclass
class TagModel:
    """``first`` and ``follow`` scores by tag number, ``unseen`` scores of an unknown token, and the ``emission``
    table (token, scores) of the known ones."""
    tags: list[str]
    first: np.ndarray
    follow: np.ndarray        # follow[previous, next]
    unseen: np.ndarray
    emission: DataFrame


def fit_tagger(tokens: DataFrame, key: Sequence[str] = SENTENCE_KEY, order: str = "tok_pos", token: str = "token",
               tag: str = "pos") -> TagModel:
    """Counts a model from tagged tokens; rows without token or tag teach nothing."""
    key = list(key)
    rows = tokens.select(*key, F.col(order).alias("_o"), F.col(token).alias("token"), F.col(tag).alias("tag")) \
        .where("token IS NOT NULL AND tag IS NOT NULL")
    # one row per (token, tag): all but the pairs of tags is counted from it
    seen = landed(rows.groupBy("token", "tag").agg(F.count(F.lit(1)).alias("n")), "tags", _local_fallback(rows.sparkSession))
    by_tag = {r["tag"]: r["n"] for r in seen.groupBy("tag").agg(F.sum("n").alias("n"))
              .orderBy("tag").limit(MAX_TAGS + 1).collect()}
    if not by_tag or len(by_tag) > MAX_TAGS:
        raise ValueError(f"training needs 1 to {MAX_TAGS} tags, got {len(by_tag)}")
    tags = sorted(by_tag)
    number = {t: i for i, t in enumerate(tags)}
    sents = rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("_o", "tag"))).alias("_s"))
    steps = F.transform("_s", lambda x, i: F.struct(F.get(F.col("_s"), i - 1)["tag"].alias("prev"), x["tag"].alias("tag")))
    pairs = sents.select(F.explode(steps).alias("z")).groupBy(F.col("z.prev").alias("prev"), F.col("z.tag").alias("tag")) \
        .agg(F.count(F.lit(1)).alias("n")).collect()
    first, follow = np.ones(len(tags)), np.ones((len(tags), len(tags)))
    for r in pairs:
        if r["prev"] is None:
            first[number[r["tag"]]] += r["n"]
        else:
            follow[number[r["prev"]], number[r["tag"]]] += r["n"]
    counts = seen.groupBy("token").agg(*[F.sum(F.when(F.col("tag") == t, F.col("n")).otherwise(0)).alias(f"_{i}")
                                         for i, t in enumerate(tags)])
    size = seen.select("token").distinct().count()
    room = [float(by_tag[t] + size + 1) for t in tags]
    emission = counts.select("token", F.array(*[millionths((F.col(f"_{i}") + 1) / F.lit(r))
                                                for i, r in enumerate(room)]).alias("scores"))

    def scores(p: np.ndarray) -> np.ndarray:
        return np.floor(np.log(p) * 1_000_000 + 0.5).astype(np.int64)
    return TagModel(tags, scores(first / first.sum()), scores(follow / follow.sum(axis=1, keepdims=True)),
                    scores(1.0 / np.array(room)), emission)


def best_path(first: np.ndarray, follow: np.ndarray, emission: np.ndarray) -> list[int]:
    """Tag numbers of highest score for the tokens' ``emission`` scores (tokens x tags)."""
    if not len(emission):
        return []
    score, back = first + emission[0], np.zeros(emission.shape, dtype=np.int32)
    for k in range(1, len(emission)):
        reach = score[:, None] + follow
        back[k] = np.argmax(reach, axis=0)           # the first of equal ones
        score = reach[back[k], np.arange(len(score))] + emission[k]
    path = [int(np.argmax(score))]
    for k in range(len(emission) - 1, 0, -1):
        path.append(int(back[k, path[-1]]))
    return path[::-1]


def best_paths(first: np.ndarray, follow: np.ndarray, emission: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """``best_path`` of many sentences at once: sentence i has the tokens from ``ends[i]`` to ``ends[i + 1]``.

    Sentences go by falling length, so those that still have a token at a step come first."""
    k, out = len(first), np.zeros(len(emission), dtype=np.int32)
    sizes = np.diff(ends)
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 0]
    room = max(1, PATHS // (k * k))                  # bounds the scores held at a time, whatever the number of tags
    for at in range(0, len(order), room):
        mine = order[at:at + room]
        start, n = ends[mine], sizes[mine]
        score, back = first + emission[start], []
        for step in range(1, int(n[0])):
            live = int(np.searchsorted(-n, -step, side="left"))      # sentences longer than ``step``
            reach = score[:live, :, None] + follow
            best = np.argmax(reach, axis=1)          # the first of equal ones
            score[:live] = np.take_along_axis(reach, best[:, None, :], axis=1)[:, 0] + emission[start[:live] + step]
            back.append(best.astype(np.int16))
        tag = np.argmax(score, axis=1)
        for step in range(int(n[0]) - 1, -1, -1):
            live = int(np.searchsorted(-n, -step, side="left"))
            out[start[:live] + step] = tag[:live]
            if step:
                tag[:live] = back[step - 1][np.arange(live), tag[:live]]
    return out


def tag_tokens(tokens: DataFrame, model: TagModel, key: Sequence[str] = SENTENCE_KEY, order: str = "tok_pos",
               token: str = "token", out: str = "pos") -> DataFrame:
    """(key..., order, ``out``): the best tag sequence of every sentence (a group of ``key``).

    Scores are joined once per token and gathered per sentence; a null token scores as an unseen one."""
    key = list(key)
    scored = tokens.select(*key, order, F.col(token).alias("token")).join(model.emission, "token", "left")
    unseen = F.array(*[F.lit(int(x)).cast("long") for x in model.unseen])
    sents = scored.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(
        F.col(order).alias("_o"), F.coalesce("scores", unseen).alias("s")))).alias("_s"))
    sents = sents.select(*key, F.col("_s._o").alias("_o"), F.flatten("_s.s").alias("_e"))
    first, follow, k = model.first, model.follow, len(model.tags)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = batch.column(len(key) + 1)
            ends = (cells.offsets.to_numpy() - cells.offsets[0].as_py()) // k
            scores = cells.flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            tags = pa.array(best_paths(first, follow, scores, ends.astype(np.int64)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), tags)], names=[*key, "_o", "_t"])

    keys = ", ".join(f"`{c}` {sents.schema[c].dataType.simpleString()}" for c in key)
    place = sents.schema["_o"].dataType.simpleString()
    found = sents.mapInArrow(run, f"{keys}, _o {place}, _t array<int>")
    names = F.array(*[F.lit(t) for t in model.tags])
    return found.select(*key, F.explode(F.arrays_zip("_o", "_t")).alias("z")) \
        .select(*key, F.col("z._o").alias(order), F.get(names, F.col("z._t")).alias(out))
