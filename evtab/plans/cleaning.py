"""Queries over the annotation tables: duplicates, broken rows, labels, counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from evtab.operators import clean
from evtab.plans import fixtures as fx
from evtab.plans.registry import register

DUCK_PRIORITY = "CASE WHEN _golden THEN 0 WHEN _unit_state = 'golden' THEN 1 ELSE 2 END"
DUCK_DEDUP = f"""dedup AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY docid, verb, eventid ORDER BY {DUCK_PRIORITY}, row_pos) AS rn
    FROM annotations) t
  WHERE rn = 1 OR docid IS NULL OR verb IS NULL OR eventid IS NULL)"""
DUCK_BROKEN = r"""flagged AS (
  SELECT *, NOT contains(
      replace(regexp_replace(coalesce(bodytext, ''), '<[^\n]+?>', '', 'g'), ' ', ''),
      replace(concat(coalesce(before, ''), coalesce(verb, ''), coalesce(after, '')), ' ', '')) AS broken
  FROM dedup)"""
DUCK_CLEAN = "clean AS (SELECT * FROM flagged WHERE NOT broken)"


def cleaned(spark, sf_dir):
    raw = fx.annotations(spark, sf_dir)
    return clean.drop_broken(clean.flag_broken(clean.dedup_golden(raw)))


@register("dedup_golden", fx.with_views(
    "SELECT row_pos, eventid, docid, _golden, _unit_state FROM dedup", "annotations", extra=[DUCK_DEDUP]))
def q_dedup_golden(spark, sf_dir):
    return clean.dedup_golden(fx.annotations(spark, sf_dir)).select(
        "row_pos", "eventid", "docid", "_golden", "_unit_state")


@register("duplicate_events", fx.with_views(
    "SELECT docid, verb, eventid, count(*) AS n_rows FROM annotations GROUP BY docid, verb, eventid "
    "HAVING count(*) > 1", "annotations"))
def q_duplicate_events(spark, sf_dir):
    return clean.duplicate_events(fx.annotations(spark, sf_dir))


@register("flag_broken", fx.with_views(
    "SELECT row_pos, eventid, broken FROM flagged", "annotations",
    extra=[DUCK_BROKEN.replace("FROM dedup", "FROM annotations")]))
def q_flag_broken(spark, sf_dir):
    return clean.flag_broken(fx.annotations(spark, sf_dir)).select("row_pos", "eventid", "broken")


@register("clean_annotations", fx.with_views(
    "SELECT row_pos, eventid, docid, lang, split FROM clean", "annotations",
    extra=[DUCK_DEDUP, DUCK_BROKEN, DUCK_CLEAN]))
def q_clean_annotations(spark, sf_dir):
    return cleaned(spark, sf_dir).select("row_pos", "eventid", "docid", "lang", "split")


@register("binary_label", fx.with_views(
    "SELECT row_pos, eventid, CAST(coalesce(raw_label = 'yes_its_anchorable', false) AS INTEGER) AS label, "
    "label_confidence FROM clean", "annotations", extra=[DUCK_DEDUP, DUCK_BROKEN, DUCK_CLEAN]))
def q_binary_label(spark, sf_dir):
    return clean.binary_label(cleaned(spark, sf_dir), answer="raw_label").select(
        "row_pos", "eventid", "label", "label_confidence")


@register("value_counts", fx.with_views(
    "SELECT coalesce(raw_label, '') AS raw_label, count(*) AS n FROM clean GROUP BY 1", "annotations",
    extra=[DUCK_DEDUP, DUCK_BROKEN, DUCK_CLEAN]))
def q_value_counts(spark, sf_dir):
    return clean.value_counts(clean.fill_blank(cleaned(spark, sf_dir), ["raw_label"]), "raw_label")


@register("stage_counts", fx.with_views(
    """SELECT 'raw' AS stage, '' AS key, count(*) AS n_rows FROM annotations
       UNION ALL SELECT 'no_dupl', '', count(*) FROM dedup
       UNION ALL SELECT 'no_broken', '', count(*) FROM clean
       UNION ALL SELECT 'split', split, count(*) FROM clean GROUP BY split""",
    "annotations", extra=[DUCK_DEDUP, DUCK_BROKEN, DUCK_CLEAN]))
def q_stage_counts(spark, sf_dir):
    raw = fx.annotations(spark, sf_dir)
    dd = clean.dedup_golden(raw)
    cl = clean.drop_broken(clean.flag_broken(dd))
    return clean.stage_counts(raw, dd, cl)


def flagship(spark, sf_dir):
    """Clean the annotation table, then count events per split and label."""
    lab = clean.binary_label(cleaned(spark, sf_dir), answer="raw_label")
    return lab.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n_events"))


@register("split_label_counts", fx.with_views(
    "SELECT split, CAST(coalesce(raw_label = 'yes_its_anchorable', false) AS INTEGER) AS label, "
    "count(*) AS n_events FROM clean GROUP BY 1, 2", "annotations",
    extra=[DUCK_DEDUP, DUCK_BROKEN, DUCK_CLEAN]))
def q_split_label_counts(spark, sf_dir):
    return flagship(spark, sf_dir)
