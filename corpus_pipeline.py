"""From raw documents to token ids, one corpus operator per stage.

Each stage is ``(spark, docs, sf_dir) -> DataFrame``; it is written as Parquet
and read again as the next stage's ``docs``. All stages but the last return
the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evtab.llm import bpe, language, mixing, neardup, toxicity
from evtab.llm.queries import VOCABULARY
from evtab.llm.util import landed, table


def covered(docs: DataFrame) -> DataFrame:
    """``text`` and the other columns under names that no operator gives a result."""
    return docs.select(*[F.col(c).alias("text" if c == "text" else f"_{i}") for i, c in enumerate(docs.columns)])


def uncovered(rows: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of ``docs`` under their names again, some of them ``changed``."""
    return rows.select(*[changed.get(c, F.col("text" if c == "text" else f"_{i}")).alias(c)
                         for i, c in enumerate(docs.columns)])


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic; learned from ``labels`` outside the held-out fold.

    A null or empty text has no words and scores as the bias alone; repeated
    rows and rows without id are scored like others; without labels nothing is
    toxic; an empty table stays empty; a long text is scored whole. Columns of
    ``docs`` named like a result column keep their own values.
    """
    labels = table(spark, sf_dir, "labels").where(~language.held_out(F.col("doc_id"), 5, 0))
    weights = toxicity.train(toxicity.sample(docs, labels))
    return uncovered(toxicity.score(covered(docs), weights).where("predicted = 0"), docs)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is decided; it fills a missing ``lang``.

    A text that is null, empty or without a letter has no language and goes;
    equal sizes under two languages are undecided and go; rows without id and
    repeated rows are judged like others; without a labelled row no language is
    known and all go; an empty table stays empty. Columns of ``docs`` named
    like a result column keep their own values.
    """
    dictionaries = language.learn(docs.where(~language.held_out(F.col("doc_id"), 4, 2)))
    known = language.predict(covered(docs), dictionaries).where("NOT rejected")
    return uncovered(known, docs, lang=F.coalesce(f"_{docs.columns.index('lang')}", "lang_pred"))


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near-duplicates: the one of smallest id.

    Rows are compared whatever their id, so repeated rows and rows without id
    are members like others (a row without id stays only where no member has
    one). A null text or one without words has no partner but equal texts with
    none; null texts all stay; an empty table stays empty; other columns are
    carried along.
    """
    own = docs.withColumn("_row", F.monotonically_increasing_id())
    found = neardup.near_duplicates(own.select("_row", "text"), key="_row").select(
        F.col("doc_id").alias("_row"), F.col("component_id").alias("_group"))
    ids = landed(own.select("_row", "doc_id").join(found, "_row"), "pipeline-groups")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row"))
    stays = ids.groupBy("_group").agg(first.alias("_first")).select(F.col("_first._row").alias("_row"))
    gone = ids.join(stays, "_row", "left_anti").select("_row")
    return own.join(gone, "_row", "left_anti").select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources, shuffled: documents repeat or stay out as the target weights ask.

    A null source is a source of its own; null and empty texts have no words
    and stay out; repeated rows are documents of their own; an empty table
    gives an empty mix; other columns are carried along.
    """
    return mixing.mixed(docs)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, token ids and digests of every document of the mix.

    A null or empty text has no token; a null id keeps its row; repeated rows
    repeat; long texts are encoded whole; an empty table gives no row.
    """
    return bpe.encode_decode(docs, public_tokenizers.path(VOCABULARY), keep=["doc_id"])


STAGES = [
    ("toxicity", toxicity_stage),
    ("language", language_stage),
    ("neardup", neardup_stage),
    ("mixing", mixing_stage),
    ("tokens", tokens_stage),
]

#: Learned models and hashed draws are not SQL; the tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = landed(docs, f"pipeline-{name}", "snappy")
    return docs
