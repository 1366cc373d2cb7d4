"""Seeded, reproducible ordering, holdouts and samples.

The reference draws with Python/numpy generators; we order by
``md5('<seed>:<key>')`` instead (same sizes and rules, other members), which
DuckDB reproduces exactly.

``hash_rank`` gives an exact 1..n rank in that order without a global
single-partition window: rows are cut into 16^b md5-prefix buckets (uniform by
construction, so a hot group is spread over all buckets), ranked inside their
(group, bucket), and offset by the running count of earlier buckets, which is
computed on the small bucket-count table (at most groups x 16^b rows).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def key_text(key) -> Column:
    """A key as text: a column (name), or several joined by a slash (null: empty)."""
    if isinstance(key, (list, tuple)):
        return F.concat_ws("/", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key])
    return (F.col(key) if isinstance(key, str) else key).cast("string")


def seeded_hash(key, seed: int = 42) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key_text(key)))


def hash_rank(df: DataFrame, key, seed: int = 42, partition_cols: Sequence[str] = (),
              out: str = "rank", size_col: str | None = None, bucket_chars: int = 4) -> DataFrame:
    """Adds ``out`` = 1-based rank of each row in md5(seed:key) order (ties by
    key) within ``partition_cols``; ``size_col`` gets the group size."""
    pc = list(partition_cols)
    d = df.withColumn("_h", seeded_hash(key, seed)).withColumn("_k", key_text(key)) \
        .withColumn("_b", F.substring("_h", 1, bucket_chars))
    counts = d.groupBy(*pc, "_b").agg(F.count(F.lit(1)).alias("_bn"))
    run = Window.partitionBy(*pc).orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*pc)
    cum = counts.select(*pc, "_b", (F.sum("_bn").over(run) - F.col("_bn")).alias("_before"),
                        F.sum("_bn").over(whole).alias("_grpn"))
    inner = Window.partitionBy(*pc, "_b").orderBy("_h", "_k")
    ranked = d.withColumn("_w", F.row_number().over(inner)).join(cum, [*pc, "_b"])
    ranked = ranked.withColumn(out, (F.col("_before") + F.col("_w")).cast("long"))
    if size_col:
        ranked = ranked.withColumn(size_col, F.col("_grpn").cast("long"))
    return ranked.drop("_h", "_k", "_b", "_w", "_before", "_grpn")


def seeded_shuffle(df: DataFrame, key, seed: int = 42, out: str = "shuffle_pos") -> DataFrame:
    """Reproducible shuffled order: ``out`` numbers the rows; sort by it when an
    ordered output is needed (a range-partitioned, distributed sort)."""
    return hash_rank(df, key, seed, out=out)


def seeded_sample(df: DataFrame, n: int, key, seed: int = 42,
                  by: Sequence[str] = ("lang", "split"), on_short: str = "error") -> DataFrame:
    """Exactly ``n`` rows per group, without replacement. A group with fewer
    rows fails the job (``on_short='error'``, as the reference) or is kept
    whole (``'all'``)."""
    if on_short not in ("error", "all"):
        raise ValueError("on_short must be 'error' or 'all'")
    r = hash_rank(df, key, seed, by, out="_r", size_col="_gn")
    keep = F.col("_r") <= n
    if on_short == "error":
        keep = F.when(F.col("_gn") < n, F.raise_error(F.concat(
            F.lit(f"sample of {n} larger than group "), F.concat_ws("|", *[F.col(c).cast("string") for c in by]),
            F.lit(" of size "), F.col("_gn").cast("string")))).otherwise(keep)
    return r.filter(keep).drop("_r", "_gn")


def holdout(df: DataFrame, group_col: str, frac: float, seed: int = 42, by: Sequence[str] = (),
            rounding: str = "floor", out: str = "holdout") -> DataFrame:
    """Marks whole groups (documents, files) as held out: the first
    ``k = floor|round_half_even(frac * n_groups)`` groups in seeded order.
    Returns one row per distinct (by..., group) with boolean ``out``."""
    groups = df.select(*by, group_col).distinct()
    r = hash_rank(groups, group_col, seed, by, out="_r", size_col="_gn")
    k = F.col("_gn") * F.lit(frac)
    k = F.floor(k) if rounding == "floor" else F.bround(k, 0)
    return r.withColumn(out, F.col("_r") <= k).drop("_r", "_gn")


def group_holdout(df: DataFrame, frac: float = 0.15, seed: int = 42, group_col: str = "docid",
                  out: str = "is_dev") -> DataFrame:
    """floor(frac) of the documents become dev; whole documents move."""
    return holdout(df, group_col, frac, seed, rounding="floor", out=out)


def file_holdout(df: DataFrame, frac: float = 0.2, seed: int = 42, group_col: str = "docid",
                 by: Sequence[str] = ("lang",), out: str = "is_test") -> DataFrame:
    """round-half-even(frac) of the files of each language become test."""
    return holdout(df, group_col, frac, seed, by=by, rounding="half_even", out=out)


def apply_holdout(df: DataFrame, marks: DataFrame, group_col: str, flag: str,
                  name: str, by: Sequence[str] = ()) -> DataFrame:
    """Join the group marks back and overwrite ``split`` for held-out groups."""
    j = df.join(marks, [*by, group_col], "left")
    return j.withColumn("split", F.when(F.coalesce(F.col(flag), F.lit(False)), F.lit(name))
                        .otherwise(F.col("split"))).drop(flag)
