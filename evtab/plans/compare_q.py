"""Queries: attaching and aligning predictions, model matrix, review sheets."""

from __future__ import annotations

from pyspark.sql import functions as F

from evtab.operators import compare
from evtab.plans import fixtures as fx
from evtab.plans.corpus_q import DUCK_POS, pos_rule
from evtab.plans.metrics_q import MODELS, matrix
from evtab.plans.registry import register

REVIEW_N = 200
SEED = 42
MAIN = "(SELECT * FROM samples WHERE raw_label IS NOT NULL AND split <> 'train')"


def main_events(spark, sf_dir):
    s = fx.samples(spark, sf_dir)
    return s.filter(F.col("raw_label").isNotNull() & (F.col("split") != "train"))


KEY = ["model", "docid", "eventid"]
EVERY_MODEL = f"{MAIN} m CROSS JOIN (SELECT unnest({MODELS!r}) AS model) k"


def per_model(df):
    """Every event once for each model: the side that predictions of all models are attached to."""
    return df.withColumn("model", F.explode(F.array(*[F.lit(m) for m in MODELS])))


@register("attach_predictions", fx.with_views(f"""
SELECT k.model, m.lang, m.split, m.docid, m.eventid, m.verb, p.pred, p.prob
FROM {EVERY_MODEL} LEFT JOIN predictions p
  ON m.docid = p.docid AND m.eventid = p.eventid AND k.model = p.model""", "predictions"))
def q_attach_predictions(spark, sf_dir):
    m = per_model(main_events(spark, sf_dir).select("lang", "split", "docid", "eventid", "verb"))
    return compare.attach_predictions(m, fx.predictions(spark, sf_dir), KEY).select(
        "model", "lang", "split", "docid", "eventid", "verb", "pred", "prob")


@register("alignment_check", fx.with_views(f"""
SELECT CAST(count_if(nb IS NULL) AS BIGINT) AS left_only, CAST(count_if(na IS NULL) AS BIGINT) AS right_only,
       CAST(count_if(na > 1) AS BIGINT) AS left_dup_keys, CAST(count_if(nb > 1) AS BIGINT) AS right_dup_keys,
       count_if(nb IS NULL) + count_if(na IS NULL) + count_if(na > 1) + count_if(nb > 1) = 0 AS aligned
FROM (SELECT docid, eventid, count(*) AS na FROM {MAIN} x GROUP BY ALL) a
FULL OUTER JOIN (SELECT docid, eventid, count(*) AS nb FROM predictions GROUP BY ALL) b USING (docid, eventid)
""", "predictions"))
def q_alignment_check(spark, sf_dir):
    return compare.alignment_check(main_events(spark, sf_dir), fx.predictions(spark, sf_dir))


_MATRIX_COLS = ", ".join(
    f"max(CASE WHEN model = '{m}' THEN pred END) AS {m}, max(CASE WHEN model = '{m}' THEN prob END) AS {m}_conf, "
    f"max(CASE WHEN model = '{m}' THEN CAST(coalesce(pred = label, false) AS INTEGER) END) AS {m}_is_correct"
    for m in MODELS)


@register("model_matrix", fx.with_views(f"""
SELECT m.lang, m.split, m.docid, m.eventid,
       CASE WHEN m.raw_label = 'yes_its_anchorable' THEN 1 ELSE 0 END AS label, w.* EXCLUDE (lang, split, docid, eventid)
FROM {MAIN} m LEFT JOIN (SELECT lang, split, docid, eventid, {_MATRIX_COLS} FROM predictions GROUP BY ALL) w
  USING (lang, split, docid, eventid)""", "predictions"))
def q_model_matrix(spark, sf_dir):
    m = main_events(spark, sf_dir).select(
        "lang", "split", "docid", "eventid",
        F.when(F.col("raw_label") == "yes_its_anchorable", 1).otherwise(0).alias("label"))
    return compare.attach_matrix(m, matrix(spark, sf_dir), ["lang", "split", "docid", "eventid"])


@register("review_sheet", fx.with_views(f"""
SELECT model, lang, split, docid, eventid, verb, pred, prob, annotation FROM (
  SELECT k.model, m.lang, m.split, m.docid, m.eventid, m.verb, p.pred, p.prob, '' AS annotation,
         row_number() OVER (PARTITION BY k.model, m.lang, m.split
                            ORDER BY md5(concat('{SEED}:', m.docid, '/', m.eventid)),
                            concat(m.docid, '/', m.eventid)) AS rn
  FROM {EVERY_MODEL} LEFT JOIN predictions p
    ON m.docid = p.docid AND m.eventid = p.eventid AND k.model = p.model) x
WHERE rn <= {REVIEW_N}""", "predictions"))
def q_review_sheet(spark, sf_dir):
    m = per_model(main_events(spark, sf_dir).select("lang", "split", "docid", "eventid", "verb"))
    _, sample, _ = compare.review_sheets(m, fx.predictions(spark, sf_dir), REVIEW_N, SEED,
                                         by=("model", "lang", "split"), on_short="all", keys=KEY)
    return sample.select("model", "lang", "split", "docid", "eventid", "verb", "pred", "prob", "annotation")


DUCK_REVIEW = [f"""j AS (
  SELECT k.model, m.lang, m.split, p.pred, CASE WHEN m.raw_label = 'yes_its_anchorable' THEN 1 ELSE 0 END AS annotation,
         {DUCK_POS.replace('{t}', 'm.verb')} AS pos
  FROM {EVERY_MODEL} LEFT JOIN predictions p
    ON m.docid = p.docid AND m.eventid = p.eventid AND k.model = p.model)""",
               """every AS (SELECT model, lang, split, 'all' AS subset, pred, annotation FROM j
      UNION ALL SELECT model, lang, split, 'VERB', pred, annotation FROM j WHERE pos = 'VERB')""",
               "s AS (SELECT * FROM every WHERE pred IS NOT NULL)",
               "conf AS (SELECT model, lang, split, subset, annotation AS label, pred, count(*) AS n FROM s GROUP BY ALL)",
               """pc AS (
  SELECT k.model, k.lang, k.split, k.subset, k.c,
    sum(CASE WHEN f.label = k.c AND f.pred = k.c THEN f.n ELSE 0 END) AS tp,
    sum(CASE WHEN f.label <> k.c AND f.pred = k.c THEN f.n ELSE 0 END) AS fp,
    sum(CASE WHEN f.label = k.c AND f.pred <> k.c THEN f.n ELSE 0 END) AS fn
  FROM (SELECT model, lang, split, subset, label AS c FROM conf
        UNION SELECT model, lang, split, subset, pred FROM conf) k
  JOIN conf f USING (model, lang, split, subset) GROUP BY ALL)""",
               """agg AS (
  SELECT model, lang, split, subset,
         avg(CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END) AS f1,
         sum(tp) / sum(tp + fn) AS po, sum((tp + fn) * (tp + fp)) / (CAST(sum(tp + fn) AS DOUBLE) * sum(tp + fn)) AS pe
  FROM pc GROUP BY ALL)"""]


@register("review_eval", fx.with_views("""
SELECT e.model, e.lang, e.split, e.subset, count(e.pred) AS n, count(*) - count(e.pred) AS n_missing,
       CAST(count_if(coalesce(e.pred = e.annotation, false)) AS BIGINT) AS n_correct, round(any_value(a.f1), 6) AS macro_f1,
       round(any_value(CASE WHEN a.pe = 1 THEN NULL ELSE (a.po - a.pe) / (1 - a.pe) END), 6) AS kappa
FROM every e LEFT JOIN agg a USING (model, lang, split, subset) GROUP BY ALL""", "predictions", extra=DUCK_REVIEW))
def q_review_eval(spark, sf_dir):
    m = main_events(spark, sf_dir).select("lang", "split", "docid", "eventid", "verb", "raw_label")
    m = m.withColumn("pos", pos_rule(F.col("verb")))
    with_preds = compare.attach_predictions(per_model(m), fx.predictions(spark, sf_dir), KEY)
    ann = m.select("docid", "eventid", F.when(F.col("raw_label") == "yes_its_anchorable", 1).otherwise(0)
                   .alias("annotation"))
    ev = compare.review_eval(with_preds, ann, by=("model", "lang", "split"), nulls="drop")
    return ev.select("model", "lang", "split", "subset", "n", "n_missing", F.col("n_correct").cast("long").alias("n_correct"),
                     F.round("macro_f1", 6).alias("macro_f1"), F.round("kappa", 6).alias("kappa"))


def prediction_rows(spark, sf_dir):
    m = main_events(spark, sf_dir)
    p = fx.predictions(spark, sf_dir).select("model", "docid", "eventid", "pred")
    j = m.join(p, ["docid", "eventid"], "inner")
    return j.select("model", "lang", "split", "docid", "eventid",
                    F.concat_ws(" | ", "before", "verb", "after").alias("input"), "pred",
                    F.when(F.col("raw_label") == "yes_its_anchorable", 1).otherwise(0).alias("label"))


@register("prediction_rows", fx.with_views(f"""
SELECT p.model, m.lang, m.split, m.docid, m.eventid, concat_ws(' | ', m.before, m.verb, m.after) AS input, p.pred,
       CASE WHEN m.raw_label = 'yes_its_anchorable' THEN 1 ELSE 0 END AS label
FROM {MAIN} m JOIN predictions p ON m.docid = p.docid AND m.eventid = p.eventid""",
    "predictions"))
def q_prediction_rows(spark, sf_dir):
    return prediction_rows(spark, sf_dir)


@register("preview", fx.with_views(f"""
SELECT model, lang, split, rank, preview FROM (
  SELECT p.model, m.lang, m.split,
         row_number() OVER (PARTITION BY p.model, m.lang, m.split ORDER BY m.docid, m.eventid) AS rank,
         concat(concat_ws(' | ', m.before, m.verb, m.after), ': true ', CAST(p.label AS VARCHAR), ', pred ',
                CAST(p.pred AS VARCHAR)) AS preview
  FROM {MAIN} m JOIN predictions p ON m.docid = p.docid AND m.eventid = p.eventid) x
WHERE rank <= 5""", "predictions"))
def q_preview(spark, sf_dir):
    m = main_events(spark, sf_dir)
    p = fx.predictions(spark, sf_dir).select("model", "docid", "eventid", "pred", "label")
    j = m.join(p, ["docid", "eventid"]).withColumn("input", F.concat_ws(" | ", "before", "verb", "after"))
    p = compare.preview(j, 5, by=["model", "lang", "split"], order=["docid", "eventid"])
    return p.withColumn("rank", F.col("rank").cast("long"))
