"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

The words of a source, its documents laid end to end in hash order, are cut
into blocks of whole documents. A source's target gives the exact number of
words, and so of blocks, the mix draws from it: whole passes over the source,
and the first blocks of a permutation for the rest. A binary tree deals these
block quotas to the output shards: a node gives its left child a
multivariate-hypergeometric draw of its quotas, which is what shuffling all
blocks and cutting the deck would give. Every shard then takes its own run of
each source's permuted blocks and shuffles it locally.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evtab.llm.util import landed, prefix_sums

#: Words per block, output shards, and how often a source may repeat.
BLOCK_WORDS = 2048
SHARDS = 16
MOST = 3
BUCKETS = 256
#: What separates words (fixed): ASCII white space only.
WORD = r"[^\x20\x09-\x0D]+"


def _hash(*parts) -> Column:
    return F.xxhash64(*parts)


def _uniform(*parts) -> Column:
    """A number in (0, 1) given by the parts."""
    return (F.pmod(F.xxhash64(*parts), F.lit(1 << 40)) + 0.5) / float(1 << 40)


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST) -> DataFrame:
    """``source, source_size, weight, target`` from ``source, source_size`` (one row per source).

    Sources by code point, null last, weigh ``weights`` in turn and share the
    sum of all sizes; a target stops at ``most`` times its source's size and
    the excess goes to the others by weight. The level where that ends is
    found in one pass over the sources ordered by size per weight.
    """
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    w = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                                                (turn + 1).cast("int")))
    w = w.withColumn("stop", (F.col("source_size") * most).cast("double"))
    by_level = Window.partitionBy(F.lit(0)).orderBy(F.col("stop") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(0))
    below = by_level.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_level.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("stop").over(below), F.lit(0.0))) \
        / F.sum("weight").over(rest)
    w = w.withColumn("_level", F.when(level <= F.col("stop") / F.col("weight"), level)) \
        .withColumn("_level", F.min(F.struct(F.col("_level").isNull().alias("no"), (F.col("stop") / F.col("weight"))
                                             .alias("at"), F.col("_level").alias("level"))).over(everything)["level"])
    return w.select("source", "source_size", "weight", F.coalesce(F.least(
        F.col("stop"), F.col("_level") * F.col("weight")), F.col("stop")).alias("target"))


def hypergeometric(total: Column, good: Column, draws: Column, u: Column) -> Column:
    """Number of good items in ``draws`` of ``total``: the inverse distribution at ``u``.

    Weights follow the ratio of neighbouring probabilities over all counts
    within ten standard deviations of the mean.
    """
    total, good, draws = total.cast("long"), good.cast("long"), draws.cast("long")
    bad = total - good
    n = F.greatest(total, F.lit(1)).cast("double")
    mean = draws.cast("double") * good / n
    sd = F.sqrt(F.greatest(mean * (bad / n) * ((total - draws) / F.greatest(n - 1, F.lit(1.0))), F.lit(0.0)))
    low = F.greatest(F.lit(0).cast("long"), draws - bad, F.floor(mean - 10 * sd - 2))
    high = F.least(good, draws, F.ceil(mean + 10 * sd + 2))
    weight = lambda w, k: w * ((good - k) / (k + 1)) * ((draws - k) / (bad - draws + k + 1))
    counts = F.sequence(low, F.greatest(low, high))
    one = F.lit(1.0)
    whole = F.aggregate(counts, F.struct(one.alias("w"), F.lit(0.0).alias("sum")), lambda a, k: F.struct(
        weight(a["w"], k).alias("w"), (a["sum"] + a["w"]).alias("sum")), lambda a: a["sum"])
    start = F.struct(one.alias("w"), F.lit(0.0).alias("sum"), low.alias("k"), (u * whole).alias("goal"))
    return F.aggregate(counts, start, lambda a, k: F.struct(
        weight(a["w"], k).alias("w"), (a["sum"] + a["w"]).alias("sum"),
        F.when(a["sum"] < a["goal"], k).otherwise(a["k"]).alias("k"), a["goal"].alias("goal")), lambda a: a["k"])


def split_tree(quotas: DataFrame, shards: int = SHARDS, seed: int = 0) -> DataFrame:
    """``source, shard, blocks, first``: the quotas (``source, blocks``) dealt to the shards.

    Shard sizes differ by one block at most; ``first`` numbers a source's
    blocks from shard to shard. A level of the tree is one relational step: a
    node's quotas are drawn source by source, each given what the earlier ones
    left, so the number of draws is one per node and source.
    """
    nodes = quotas.where("blocks > 0").groupBy().agg(
        F.array_sort(F.collect_list(F.struct(F.col("source").isNull().alias("last"), F.col("source").alias("source"),
                                             F.col("blocks").cast("long").alias("q")))).alias("qs")) \
        .select(F.lit(0).alias("first"), F.lit(shards).alias("width"), "qs")   # one entry per source
    nodes = nodes.where(F.size("qs") > 0)
    width = shards
    while width > 1:
        half = F.floor(F.col("width") / 2).cast("int")
        total = F.aggregate("qs", F.lit(0).cast("long"), lambda a, x: a + x["q"])
        # shard k of n gets floor(total / n), one more if k < total mod n
        take = half * F.floor(total / F.col("width")) + F.least(half.cast("long"), F.pmod(total, F.col("width")))
        start = F.struct(total.alias("total"), take.cast("long").alias("take"),
                         F.array().cast("array<bigint>").alias("left"))

        def draw(a: Column, x: Column) -> Column:
            u = _uniform(F.lit(seed), F.col("first"), F.col("width"), F.size(a["left"]))
            k = hypergeometric(a["total"], x["q"], a["take"], u)
            return F.struct((a["total"] - x["q"]).alias("total"), (a["take"] - k).cast("long").alias("take"),
                            F.concat(a["left"], F.array(k.cast("long"))).alias("left"))

        drawn = landed(nodes.withColumn("left", F.when(F.col("width") > 1, F.aggregate(
            "qs", start, draw, lambda a: a["left"]))), "mix-tree")
        part = lambda sign: F.zip_with("qs", "left", lambda x, k: F.struct(
            x["last"].alias("last"), x["source"].alias("source"),
            (k if sign else x["q"] - k).alias("q")))
        wide = drawn.where("width > 1")
        nodes = drawn.where("width = 1").select("first", "width", "qs") \
            .unionByName(wide.select("first", half.alias("width"), part(True).alias("qs"))) \
            .unionByName(wide.select((F.col("first") + half).alias("first"), (F.col("width") - half).alias("width"),
                                     part(False).alias("qs")))
        width = -(-width // 2)
    leaves = nodes.select(F.col("first").alias("shard"), F.explode("qs").alias("x")) \
        .select(F.col("x.source").alias("source"), "shard", F.col("x.q").alias("blocks"))
    earlier = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return leaves.withColumn("first", F.coalesce(F.sum("blocks").over(earlier), F.lit(0)))


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text",
        weights: tuple[int, ...] = (1, 2, 3), most: int = MOST, shards: int = SHARDS,
        block_words: int = BLOCK_WORDS, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """The mix of all rows: ``(documents, blocks)``.

    ``documents`` has one row per input row: ``doc_id, source, size,
    source_size, target, passes, part, taken, block, h`` - the mix takes the
    text ``passes`` times whole and its first ``part`` words once more,
    ``taken`` words in all; ``block`` is the block it lies in (null: no words). A source's taken words are its target rounded to a word.

    ``blocks`` has one row per drawn block: ``source, block, pass, shard,
    position, words`` - its place in the shuffled shard and the words it
    brings.

    A null text has no words; rows without words are taken zero times; a null
    source is a source of its own, last in order; rows that repeat (key and
    text) each count; without any word every target is zero; an empty table
    gives empty results. Other columns are ignored.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.col(source).cast("string").alias("source"),
                       F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long").alias("size"),
                       _hash(F.lit(seed), F.col(key).cast("string"), F.crc32(F.coalesce(F.col(text), F.lit(""))))
                       .alias("h"))
    rows = landed(rows.withColumn("bucket", F.pmod("h", F.lit(BUCKETS)).cast("int")), "mix-rows")
    sized = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    sized = landed(sized.withColumn("words", F.round("target").cast("long"))
                   .withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("words") / F.greatest(
                       F.col("source_size"), F.lit(1)))).otherwise(0))
                   .withColumn("rest", F.col("words") - F.col("passes") * F.col("source_size")), "mix-sources")

    # blocks of whole documents along each source
    laid = prefix_sums(rows.where("size > 0"), ["source"], "bucket", ["h", "doc_id", "size"], {"at": F.col("size")}) \
        .withColumn("block", F.floor(F.col("at") / block_words))
    laid = landed(laid, "mix-laid")
    blocks = laid.groupBy("source", "block").agg(F.sum("size").alias("words"), F.min("at").alias("begin")) \
        .withColumn("ph", _hash(F.lit(seed), F.col("source"), F.col("block"))) \
        .withColumn("bucket", F.pmod("ph", F.lit(BUCKETS)).cast("int"))
    # the last pass: blocks in permuted order until the rest of the target is reached
    ranked = prefix_sums(blocks, ["source"], "bucket", ["ph", "block"],
                         {"before": F.col("words"), "rank": F.lit(1).cast("long")})
    known = sized.select(F.col("source").alias("s"), "passes", "rest")
    ranked = landed(ranked.join(known, F.col("source").eqNullSafe(F.col("s"))).drop("s", "bucket", "ph"),
                    "mix-blocks")
    taken = ranked.where("before < rest").select(F.col("source").alias("s"), F.col("block").alias("b"), "begin",
                                                 "before", F.col("rest").alias("r"))
    partly = laid.join(taken, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")), "left") \
        .select("doc_id", "source", "size", "h", "block", F.when(F.col("r").isNotNull(), F.greatest(
            F.lit(0).cast("long"), F.least(F.col("size"), F.col("r") - F.col("before") - F.col("at") + F.col("begin")))
        ).alias("part"))
    every = partly.withColumn("part", F.coalesce("part", F.lit(0))).unionByName(
        rows.where("size = 0").select("doc_id", "source", "size", "h", F.lit(None).cast("long").alias("block"),
                                     F.lit(0).cast("long").alias("part")))
    facts = sized.select(F.col("source").alias("s"), "source_size", "target", "passes")
    documents = every.join(facts, F.col("source").eqNullSafe(F.col("s"))).select(
        "doc_id", "source", "size", "source_size", "target", F.col("passes").cast("long").alias("passes"), "part",
        (F.col("passes") * F.col("size") + F.col("part")).cast("long").alias("taken"), "block", "h")

    # every draw of a block, numbered per source: pass after pass, each in an order of its own
    whole = ranked.where("passes > 0").select("source", "block", "words", F.explode(F.sequence(
        F.lit(0).cast("long"), F.col("passes").cast("long") - 1)).alias("pass"))
    again = ranked.where("before < rest").select("source", "block", F.least(
        F.col("words"), F.col("rest") - F.col("before")).alias("words"), F.col("passes").cast("long").alias("pass"))
    draws = whole.unionByName(again).withColumn("dh", _hash(F.lit(seed), "source", "block", "pass")) \
        .withColumn("bucket", (F.col("pass") * BUCKETS + F.pmod("dh", F.lit(BUCKETS))).cast("int"))
    numbered = prefix_sums(draws, ["source"], "bucket", ["dh", "block"], {"i": F.lit(1).cast("long")})
    quotas = draws.groupBy("source").agg(F.count(F.lit(1)).alias("blocks"))
    leaves = split_tree(quotas, shards, seed).where("blocks > 0").groupBy(F.col("source").alias("s")).agg(
        F.array_sort(F.collect_list(F.struct((F.col("first") + F.col("blocks")).alias("end"), "shard"))).alias("ends"))
    shard = F.get(F.filter("ends", lambda e: e["end"] > F.col("i")), 0)["shard"]
    dealt = numbered.join(leaves, F.col("source").eqNullSafe(F.col("s"))) \
        .select("source", "block", "pass", "words", shard.alias("shard"),
                _hash(F.lit(seed), F.lit("local"), "source", "block", "pass").alias("lh")) \
        .withColumn("bucket", F.pmod("lh", F.lit(BUCKETS)).cast("int"))
    drawn = prefix_sums(dealt, ["shard"], "bucket", ["lh", "source", "block", "pass"],
                        {"position": F.lit(1).cast("long")}) \
        .select("source", "block", "pass", "shard", "position", "words")
    return documents, drawn


def with_shards(documents: DataFrame, blocks: DataFrame) -> DataFrame:
    """Add ``shards``: the output shard of each draw of a document's block, in the order of the passes."""
    where = blocks.groupBy(F.col("source").alias("s"), F.col("block").alias("b")).agg(
        F.array_sort(F.collect_list(F.struct("pass", "shard"))).alias("draws"))   # at most one per pass
    joined = documents.join(where, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")), "left")
    draws = F.when(F.col("taken") > 0, F.transform(F.filter(
        "draws", lambda d: (d["pass"] < F.col("passes")) | (F.col("part") > 0)), lambda d: d["shard"]))
    return joined.withColumn("shards", F.coalesce(draws, F.array().cast("array<int>"))).drop("s", "b", "draws")


def first_words(text: Column, n: Column) -> Column:
    """The first ``n`` words of a text, one space between them."""
    space = r"[\x20\x09-\x0D]+"
    return F.array_join(F.slice(F.split(F.regexp_replace(text, "^" + space, ""), space), F.lit(1), n.cast("int")), " ")


def mixed(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text",
          n_chars: str | None = "n_chars", **options) -> DataFrame:
    """The mix as documents with the columns of ``docs``: what a training run reads, in its order.

    A document comes once per whole pass its source is given, and once more
    with its first words where the target ends inside it; documents the mix
    takes no word of are left out. Partitions hold the output shards, rows are
    sorted by shard and by the shuffled position of their block. Rows that
    repeat (key and text) are all taken like the one of them that is taken
    most.
    """
    seed = options.get("seed", 0)
    documents, blocks = mix(docs, key, source, text, **options)
    mine = landed(documents.where("taken > 0").groupBy("doc_id", "h").agg(
        F.max("passes").alias("passes"), F.max(F.struct("part", "size")).alias("cut"), F.min("source").alias("src"),
        F.min("block").alias("block")), "mix-takes")
    copies = F.concat(F.when(F.col("passes") > 0, F.sequence(F.lit(0).cast("long"), F.col("passes") - 1))
                      .otherwise(F.array().cast("array<bigint>")),
                      F.when(F.col("cut.part") > 0, F.array("passes")).otherwise(F.array().cast("array<bigint>")))
    rows = mine.withColumn("pass", F.explode(copies)).withColumn(
        "words", F.when((F.col("pass") == F.col("passes")) & (F.col("cut.part") < F.col("cut.size")),
                        F.col("cut.part")))
    spots = blocks.select(F.col("source").alias("s"), F.col("block").alias("b"), F.col("pass").alias("p"), "shard",
                          "position")
    rows = rows.join(spots, F.col("src").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b"))
                     & (F.col("pass") == F.col("p"))) \
        .select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), F.col("words").alias("_words"),
                F.col("shard").alias("_shard"), F.col("position").alias("_position"))
    mark = _hash(F.lit(seed), F.col(key).cast("string"), F.crc32(F.coalesce(F.col(text), F.lit(""))))
    out = docs.withColumn("_mark", mark).join(rows, (F.col("_mark") == F.col("_h"))
                                              & F.col(key).eqNullSafe(F.col("_id")))
    cut = F.when(F.col("_words").isNotNull(), first_words(F.col(text), F.col("_words"))).otherwise(F.col(text))
    out = out.withColumn(text, cut)
    if n_chars is not None and n_chars in docs.columns:
        out = out.withColumn(n_chars, F.when(F.col("_words").isNotNull(), F.length(text).cast(
            docs.schema[n_chars].dataType)).otherwise(F.col(n_chars)))
    return out.repartitionByRange("_shard", "_position", "_h").sortWithinPartitions("_shard", "_position", "_h") \
        .select(*docs.columns)
