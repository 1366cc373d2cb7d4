"""Queries: source tags, unions, membership, splits, holdouts, samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from evtab.operators import clean, split
from evtab.plans import fixtures as fx
from evtab.plans.cleaning import DUCK_BROKEN, DUCK_CLEAN, DUCK_DEDUP, cleaned
from evtab.plans.registry import register

SEED = 42
SAMPLE_N = 200

TEST_DOCS = "(SELECT docid FROM samples WHERE split = 'test')"
DEV_DOCS = "(SELECT docid FROM samples WHERE split = 'dev')"
CLEAN = [DUCK_DEDUP, DUCK_BROKEN, DUCK_CLEAN]


def test_docs(spark, sf_dir):
    return fx.samples(spark, sf_dir).filter(F.col("split") == "test").select("docid")


def dev_docs(spark, sf_dir):
    return fx.samples(spark, sf_dir).filter(F.col("split") == "dev").select("docid")


@register("source_tag", fx.with_views(f"""
SELECT row_pos, eventid, CASE WHEN docid IN {TEST_DOCS} THEN 'platinum' ELSE 'aq' END AS source
FROM annotations""", "annotations"))
def q_source_tag(spark, sf_dir):
    a = fx.annotations(spark, sf_dir)
    return clean.tag_source(a, platinum=test_docs(spark, sf_dir)).select("row_pos", "eventid", "source")


@register("union_sources", fx.with_views(f"""
SELECT 0 AS file_priority, row_pos, eventid, 'tb' AS source FROM annotations WHERE lang = 'de'
UNION ALL SELECT 1, row_pos, eventid, 'dense' FROM annotations WHERE lang IN ('fr', 'es')
UNION ALL SELECT 2, row_pos, eventid, CASE WHEN docid IN {TEST_DOCS} THEN 'platinum' ELSE 'aq' END
FROM annotations WHERE lang = 'en'""", "annotations"))
def q_union_sources(spark, sf_dir):
    a = fx.annotations(spark, sf_dir)
    tb = clean.tag_source(a.filter(F.col("lang") == "de"), "tb")
    dense = clean.tag_source(a.filter(F.col("lang").isin("fr", "es")), "dense")
    aq = clean.tag_source(a.filter(F.col("lang") == "en"), platinum=test_docs(spark, sf_dir))
    u = clean.union_sources([("tb", tb), ("dense", dense), ("aq", aq)])
    return u.select("file_priority", "row_pos", "eventid", "source")


@register("semi_docs", fx.with_views(
    f"SELECT row_pos, eventid, docid FROM annotations WHERE docid IN {TEST_DOCS}", "annotations"))
def q_semi_docs(spark, sf_dir):
    return clean.semi_docs(fx.annotations(spark, sf_dir), test_docs(spark, sf_dir)).select(
        "row_pos", "eventid", "docid")


@register("anti_docs", fx.with_views(
    f"SELECT row_pos, eventid, docid FROM annotations WHERE docid NOT IN {TEST_DOCS}", "annotations"))
def q_anti_docs(spark, sf_dir):
    return clean.anti_docs(fx.annotations(spark, sf_dir), test_docs(spark, sf_dir)).select(
        "row_pos", "eventid", "docid")


@register("assign_split", fx.with_views("SELECT row_pos, eventid, split FROM clean", "annotations", extra=CLEAN))
def q_assign_split(spark, sf_dir):
    c = cleaned(spark, sf_dir).drop("split")
    out = clean.assign_split(c, test_docs(spark, sf_dir), dev_docs(spark, sf_dir))
    return out.select("row_pos", "eventid", "split")


_TRAIN_DOCS = "(SELECT DISTINCT docid FROM col_rows WHERE split = 'train')"


@register("group_holdout", fx.with_views(f"""
SELECT docid, rn <= floor(0.15::DOUBLE * n) AS is_dev FROM (
  SELECT docid, row_number() OVER (ORDER BY md5(concat('{SEED}:', docid)), docid) AS rn,
         count(*) OVER () AS n FROM {_TRAIN_DOCS} t) x""", "col_rows"))
def q_group_holdout(spark, sf_dir):
    docs = fx.col_rows(spark, sf_dir).filter(F.col("split") == "train").select("docid")
    return split.group_holdout(docs, 0.15, SEED).select("docid", "is_dev")


@register("file_holdout", fx.with_views(f"""
SELECT lang, docid, rn <= round_even(0.2::DOUBLE * n, 0) AS is_test FROM (
  SELECT lang, docid, row_number() OVER (PARTITION BY lang ORDER BY md5(concat('{SEED}:', docid)), docid) AS rn,
         count(*) OVER (PARTITION BY lang) AS n FROM (SELECT DISTINCT lang, docid FROM col_rows) t) x""",
    "col_rows"))
def q_file_holdout(spark, sf_dir):
    files = fx.col_rows(spark, sf_dir).select("lang", "docid")
    return split.file_holdout(files, 0.2, SEED).select("lang", "docid", "is_test")


@register("seeded_shuffle", fx.with_views(f"""
SELECT docid, eventid, row_number() OVER (ORDER BY md5(concat('{SEED}:', docid, '/', eventid)),
                                          concat(docid, '/', eventid)) AS shuffle_pos
FROM clean WHERE split = 'train'""", "annotations", extra=CLEAN))
def q_seeded_shuffle(spark, sf_dir):
    tr = cleaned(spark, sf_dir).filter(F.col("split") == "train").select("docid", "eventid")
    return split.seeded_shuffle(tr, ["docid", "eventid"], SEED).select("docid", "eventid", "shuffle_pos")


@register("seeded_sample", fx.with_views(f"""
SELECT lang, split, docid, eventid FROM (
  SELECT lang, split, docid, eventid,
         row_number() OVER (PARTITION BY lang, split ORDER BY md5(concat('{SEED}:', docid, '/', eventid)),
                            concat(docid, '/', eventid)) AS rn
  FROM samples) x WHERE rn <= {SAMPLE_N}""", "samples"))
def q_seeded_sample(spark, sf_dir):
    s = fx.samples(spark, sf_dir).select("lang", "split", "docid", "eventid")
    return split.seeded_sample(s, SAMPLE_N, ["docid", "eventid"], SEED, by=("lang", "split"), on_short="all")


@register("class_sizes", fx.with_views("""
SELECT CAST(coalesce(raw_label = 'yes_its_anchorable', false) AS INTEGER) AS label, count(*) AS n
FROM clean WHERE split = 'train' GROUP BY 1""", "annotations", extra=CLEAN))
def q_class_sizes(spark, sf_dir):
    tr = clean.binary_label(cleaned(spark, sf_dir), answer="raw_label").filter(F.col("split") == "train")
    return tr.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@register("distinct_verbs", fx.with_views(
    "SELECT DISTINCT lower(verb) AS verb FROM clean WHERE split = 'train'", "annotations", extra=CLEAN))
def q_distinct_verbs(spark, sf_dir):
    tr = cleaned(spark, sf_dir).filter(F.col("split") == "train")
    return tr.select(F.lower("verb").alias("verb")).distinct().orderBy("verb")
