"""Connected components of a link table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evtab.llm.util import landed


def _flat(parent: DataFrame) -> DataFrame:
    """Follow ``id -> up`` pointers to their ends (each round doubles the reach)."""
    while True:
        above = parent.select(F.col("id").alias("up"), F.col("up").alias("top"))
        jumped = landed(parent.join(above, "up", "left")
                        .select("id", F.coalesce("top", "up").alias("up"),
                                (F.col("top").isNotNull() & (F.col("top") != F.col("up"))).alias("moved")), "jump")
        parent = jumped.select("id", "up")
        if jumped.where("moved").isEmpty():
            return parent


def components(links: DataFrame) -> DataFrame:
    """``id, component`` (smallest id reachable) of every id in ``links`` (``a, b``, any order).

    Each round points every id at its smallest neighbour, follows the pointers
    to their ends, renames the links and keeps those that still join two
    names; at least half of the names of a component go in a round. Every
    round is written to the shared folder. Hubs cost one partial minimum per
    task; a hub's renames are an ordinary join that splits when skewed. Null
    ends and loops are no links.
    """
    links = landed(links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
                   .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    named = None
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = _flat(landed(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m"))
                              .select("id", F.least("id", "m").alias("up")), "parent"))
        if named is None:
            named = parent.select("id", F.col("up").alias("component"))
        else:
            step = parent.select(F.col("id").alias("component"), F.col("up").alias("to"))
            named = landed(named.join(step, "component", "left")
                           .select("id", F.coalesce("to", "component").alias("component")), "named")
        left = parent.select(F.col("id").alias("a"), F.col("up").alias("x"))
        right = parent.select(F.col("id").alias("b"), F.col("up").alias("y"))
        links = landed(links.join(left, "a").join(right, "b").where("x <> y")
                       .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
    if named is None:
        return links.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return named
