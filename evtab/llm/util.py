"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evtab.session import checkpoint_dir

LOCAL_CHECKPOINTS = "/tmp/checkpoints/evtab"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``).

    Only a local session without the setting gets a folder of its own.
    """
    local = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
    return checkpoint_dir(spark, fallback=LOCAL_CHECKPOINTS if local else None)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/evtab-{name}-{uuid.uuid4().hex}"


def landed(df: DataFrame, name: str, compression: str = "none") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage like ``checkpoint()`` does, survives lost executors, and
    keeps column pruning for the readers. Tables of ids and hashes do not
    compress, and codec buffers of many small writers add up outside the heap;
    tables with texts name a codec.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keep(df: DataFrame, **named: Column) -> DataFrame:
    """Project to exactly the named columns: extra input columns cannot clash."""
    return df.select(*[c.alias(k) for k, c in named.items()])


def text_key(text: Column) -> Column:
    """128-bit key of a text (null and the empty text differ)."""
    return F.unhex(F.md5(F.encode(text, "UTF-8")))


def prefix_sums(df: DataFrame, keys: list[str], bucket: str, order: list[Column | str],
                values: dict[str, Column]) -> DataFrame:
    """Exclusive running sums per ``keys`` in (bucket, order) order, one new column per value.

    A key may hold any share of the rows: rows are summed per (keys, bucket),
    the buckets of a key (a bounded number) get their offsets, and a window
    orders rows only inside one bucket.
    """
    part = [*keys, bucket]
    sums = df.groupBy(*part).agg(*[F.sum(v).alias(f"_sum_{k}") for k, v in values.items()])
    over = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(bucket) \
        .rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*part, *[F.coalesce(F.sum(f"_sum_{k}").over(over), F.lit(0)).alias(f"_base_{k}")
                                   for k in values])
    inside = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = df.select("*", *[F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(f"_in_{k}")
                              for k, v in values.items()])
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"o.{c}")) for c in part]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    return ranked.alias("r").join(offsets.alias("o"), cond).select(
        *[F.col(f"r.{c}") for c in df.columns],
        *[(F.col(f"r._in_{k}") + F.col(f"o._base_{k}")).alias(k) for k in values])


#: A key that holds more than one row in so many is joined by broadcast; no more keys than that can.
HOT_SHARE = 2048


def hot_join(rows: DataFrame, facts: DataFrame, keys: list[str], copies: str, spread: list[str]) -> DataFrame:
    """``rows`` left-joined to ``facts`` (one row per ``keys``), whatever share of the rows a key holds.

    ``copies`` counts a key's rows. The facts of keys with more than one row in
    ``HOT_SHARE`` are at most that many and are broadcast. Their rows get a
    salt from the ``spread`` columns, so the shuffle of the rest deals them to
    all tasks. ``rows`` is computed once.
    """
    total = facts.agg(F.sum(copies)).first()[0] or 0
    is_hot = F.col(copies) * HOT_SHARE > total
    given = [c for c in facts.columns if c not in keys]
    hot = facts.where(is_hot).select(*keys, *[F.col(c).alias(f"_hot_{c}") for c in given])
    cold = facts.where(~is_hot).withColumn("_salt", F.lit(0))
    salt = F.when(F.col(f"_hot_{copies}").isNotNull(), 1 + F.pmod(F.xxhash64(*spread), F.lit(1 << 20))).otherwise(0)
    both = rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", salt.cast("int")) \
        .join(cold, [*keys, "_salt"], "left")
    return both.select(*rows.columns, *[F.coalesce(f"_hot_{c}", c).alias(c) for c in given])
