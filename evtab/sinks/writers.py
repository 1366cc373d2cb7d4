"""Sinks: quarantine of broken rows, prediction tables, review tables, id lists.

Tables are written once, partitioned by the columns readers filter on
(``model``, ``lang``, ``split``), so a later read of one model/language/split
prunes to its folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evtab.operators.clean import split_quarantine

# ---- fixed values ------------------------------------------------------------
PREDICTION_COLUMNS = ["lang", "split", "docid", "eventid", "input", "pred", "prob", "label"]
# ------------------------------------------------------------------------------


def write_quarantine(df: DataFrame, bad_path: str, fmt: str = "parquet") -> DataFrame:
    """Writes the broken rows aside and returns the good ones."""
    good, bad = split_quarantine(df)
    bad.write.mode("overwrite").format(fmt).save(bad_path)
    return good


def prediction_table(df: DataFrame, with_prob: bool = True) -> DataFrame:
    """Fixed column order; ``input`` = before | verb | after when absent;
    ``label`` '' when unlabelled."""
    out = df
    if "input" not in out.columns:
        out = out.withColumn("input", F.concat_ws(" | ", "before", "verb", "after"))
    out = out.withColumn("label", F.coalesce(F.col("label").cast("string"), F.lit("")))
    cols = [c for c in PREDICTION_COLUMNS if with_prob or c != "prob"]
    extra = ["model"] if "model" in out.columns else []
    return out.select(*extra, *cols)


def write_predictions(df: DataFrame, path: str, with_prob: bool = True, fmt: str = "parquet") -> None:
    t = prediction_table(df, with_prob)
    parts = [c for c in ("model", "lang", "split") if c in t.columns]
    # only the partitions in ``df`` are replaced; rows are clustered, and a large partition is cut into several tasks
    w = t.hint("rebalance", *parts).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def write_id_list(ids: DataFrame, path: str, col: str = "docid") -> None:
    """Sorted ids, one per line (a range-partitioned sort; part files in order)."""
    ids.select(F.col(col).cast("string").alias("value")).distinct().orderBy("value") \
        .write.mode("overwrite").text(path)
