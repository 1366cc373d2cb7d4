"""Sharding by balanced label propagation.

Documents with equal texts are linked. Every document starts in the shard its
hash names; in each round the documents of a group ask to move to the shard
that holds most of their neighbours, and a shard accepts requests, those with
most neighbours first, until its quota is full. Documents without neighbours
wait, and fill what the quotas leave at the end, so that shard sizes differ by
one row at most. All members of a group that sit in one shard are alike, so a
round works on (group, shard) cells: a group of any size is at most one row
per shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evtab.llm.util import landed, prefix_sums, text_key

#: Hash buckets that rows of one group, shard or pool are ranked in.
BUCKETS = 256
ROUNDS = 48


def rows_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, g, h``: what sharding needs of each document.

    A null text counts as the empty text (size 16, checksum 0).
    """
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(key).alias("doc_id"), (F.octet_length(body) + 16).cast("long").alias("size"),
                       F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"), text_key(body).alias("g"),
                       F.xxhash64(F.lit("shard"), F.col(key).cast("string")).alias("h"))


def _bucket(h: Column) -> Column:
    return F.pmod(h, F.lit(BUCKETS)).cast("int")


def propagate(cells: DataFrame, quota: Column, shards: int, rounds: int = ROUNDS) -> DataFrame:
    """Move the members of ``cells`` (``g, at, n``) for at most ``rounds`` rounds.

    ``quota`` gives the rows a shard may hold from its number ``at``. Stops as
    soon as nothing moves.
    """
    spark = cells.sparkSession
    every = spark.range(shards).select(F.col("id").cast("int").alias("at"))
    for _ in range(rounds):
        load = cells.groupBy("at").agg(F.sum("n").alias("load"))
        free = every.join(load, "at", "left").select(
            "at", F.greatest(quota - F.coalesce("load", F.lit(0)), F.lit(0)).alias("free"))
        seen = cells.join(F.broadcast(free), "at")            # one row per shard
        by_votes = Window.partitionBy("g").orderBy(F.desc("n"), F.xxhash64("g", "at"), "at")
        place = F.row_number().over(by_votes)
        goal = F.min(F.when(F.col("free") > 0, F.struct("place", "at", "n", "free"))).over(Window.partitionBy("g"))
        # smaller cells join the goal; larger ones, in full shards, do if the whole group fits there
        asks = seen.withColumn("place", place).withColumn("all", F.sum("n").over(Window.partitionBy("g"))) \
            .withColumn("goal", goal) \
            .where((F.col("place") > F.col("goal.place"))
                   | ((F.col("place") < F.col("goal.place")) & (F.col("all") <= F.col("goal.free")))) \
            .select("g", F.col("at").alias("from"), "n", F.col("goal.at").alias("to"), F.col("goal.n").alias("votes"),
                    F.col("goal.free").alias("free"), F.xxhash64("g").alias("h"))
        # most neighbours first: ranked by powers of two and a few hash bits, exactly inside
        asks = asks.withColumn("bucket", ((64 - F.floor(F.log2("votes"))) * 16 + F.pmod("h", F.lit(16))).cast("int"))
        ranked = prefix_sums(asks, ["to"], "bucket", [F.desc("votes"), "h", "g", "from"], {"ahead": F.col("n")})
        moves = landed(ranked.select("g", "from", "to", F.least(
            F.col("n"), F.col("free") - F.col("ahead")).alias("m")).where("m > 0"), "moves")
        if moves.isEmpty():
            break
        change = moves.select("g", F.col("from").alias("at"), (-F.col("m")).alias("n")) \
            .unionByName(moves.select("g", F.col("to").alias("at"), F.col("m").alias("n")))
        cells = landed(cells.unionByName(change).groupBy("g", "at").agg(F.sum("n").alias("n")).where("n > 0"),
                       "cells")
    return cells


def balanced_shards(docs: DataFrame, shards: int = 40, key: str = "doc_id", text: str = "text",
                    rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` of every row; shard sizes differ by one row at most.

    Rows with null keys or texts are placed like others (a null text is an
    empty text); repeated rows take a slot each; an empty table gives no row;
    other columns are ignored. The result depends on keys and texts only, not
    on the order or partitioning of the rows.
    """
    rows = landed(rows_of(docs, key, text), "shard-rows")
    total = rows.count()
    quota: Column = F.lit(total // shards) + F.when(F.col("at") < total % shards, 1).otherwise(0)
    start = F.pmod("h", F.lit(shards)).cast("int")
    cells = rows.groupBy("g", start.alias("at")).agg(F.count(F.lit(1)).alias("n"))
    group = Window.partitionBy("g")
    linked = landed(cells.withColumn("all", F.sum("n").over(group)).where("all > 1").drop("all"), "cells")
    cells = propagate(linked, quota, shards, rounds)

    # a shard that started over its quota keeps what fits, its largest cells first
    cells = cells.withColumn("h", F.xxhash64("g")).withColumn(
        "bucket", ((64 - F.floor(F.log2("n"))) * 16 + F.pmod("h", F.lit(16))).cast("int"))
    fit = prefix_sums(cells, ["at"], "bucket", [F.desc("n"), "h", "g"], {"ahead": F.col("n")}) \
        .select("g", "at", F.least(F.col("n"), quota - F.col("ahead")).alias("n")).where("n > 0")
    fit = landed(fit, "fit")
    ends = fit.withColumn("end", F.sum("n").over(group.orderBy("at"))) \
        .groupBy("g").agg(F.array_sort(F.collect_list(F.struct("end", "at"))).alias("ends"))  # at most one per shard

    # members are numbered inside hash buckets of their group, so a group of any size splits
    members = rows.withColumn("bucket", _bucket(F.col("h")))
    counts = members.groupBy("g", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).join(ends, "g") \
        .select("g", "bucket", "base", "ends")
    number = F.row_number().over(Window.partitionBy("g", "bucket").orderBy("h", "doc_id", "size")) - 1
    numbered = members.withColumn("i", number).join(offsets, ["g", "bucket"], "left")
    home = F.get(F.filter("ends", lambda e: e["end"] > F.col("i") + F.col("base")), 0)["at"]
    placed = landed(numbered.select("doc_id", "size", "text_crc32", "h", "bucket", home.alias("shard")), "placed")

    # the others fill the room that is left
    every = docs.sparkSession.range(shards).select(F.col("id").cast("int").alias("at"))
    held = placed.where("shard IS NOT NULL").groupBy(F.col("shard").alias("at")).agg(F.count(F.lit(1)).alias("n"))
    room = every.join(held, "at", "left").select("at", (quota - F.coalesce("n", F.lit(0))).alias("room"))
    room_ends = room.select(F.col("at"), F.sum("room").over(Window.orderBy("at")).alias("end")) \
        .agg(F.array_sort(F.collect_list(F.struct("at", "end"))).alias("ends"))   # one row, one entry per shard
    pool = prefix_sums(placed.where("shard IS NULL").drop("shard"), [], "bucket", ["h", "doc_id", "size"],
                       {"i": F.lit(1).cast("long")})
    spot = F.get(F.filter("ends", lambda e: e["end"] > F.col("i")), 0)["at"]
    filled = pool.join(F.broadcast(room_ends)).select("doc_id", "size", "text_crc32", "h", "bucket",
                                                       spot.alias("shard"))
    out = placed.where("shard IS NOT NULL").unionByName(filled)
    return prefix_sums(out, ["shard"], "bucket", ["h", "doc_id", "size", "text_crc32"],
                       {"slot": F.lit(1).cast("long")}).select("doc_id", "size", "text_crc32", "shard", "slot")
