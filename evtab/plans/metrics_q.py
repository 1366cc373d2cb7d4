"""Queries: confusion, macro-F1, class report, Cohen's and Fleiss' kappa."""

from __future__ import annotations

from pyspark.sql import functions as F

from evtab.operators import compare, metrics
from evtab.plans import fixtures as fx
from evtab.plans.registry import register

BY = ["model", "lang", "split"]
MODELS = ["m0", "m1", "m2", "m3", "m4"]

DUCK_CONF = "conf AS (SELECT model, lang, split, label, pred, count(*) AS n FROM predictions GROUP BY ALL)"
DUCK_PC = """pc AS (
  SELECT k.model, k.lang, k.split, k.c,
    CAST(sum(CASE WHEN f.label = k.c AND f.pred = k.c THEN f.n ELSE 0 END) AS BIGINT) AS tp,
    CAST(sum(CASE WHEN f.label <> k.c AND f.pred = k.c THEN f.n ELSE 0 END) AS BIGINT) AS fp,
    CAST(sum(CASE WHEN f.label = k.c AND f.pred <> k.c THEN f.n ELSE 0 END) AS BIGINT) AS fn
  FROM (SELECT model, lang, split, label AS c FROM conf UNION SELECT model, lang, split, pred FROM conf) k
  JOIN conf f ON f.model = k.model AND f.lang = k.lang AND f.split = k.split
  GROUP BY ALL)"""


def preds(spark, sf_dir):
    return fx.predictions(spark, sf_dir)


@register("confusion", fx.with_views(
    "SELECT model, lang, split, label, pred, n FROM conf", "predictions", extra=[DUCK_CONF]))
def q_confusion(spark, sf_dir):
    return metrics.confusion(preds(spark, sf_dir), by=BY)


@register("macro_f1", fx.with_views("""
SELECT model, lang, split, round(avg(CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0
                                     ELSE 2.0 * tp / (2 * tp + fp + fn) END), 6) AS macro_f1
FROM pc GROUP BY ALL""", "predictions", extra=[DUCK_CONF, DUCK_PC]))
def q_macro_f1(spark, sf_dir):
    f = metrics.macro_f1(preds(spark, sf_dir), by=BY)
    return f.select(*BY, F.round("macro_f1", 6).alias("macro_f1"))


DUCK_CLS = """cls AS (
  SELECT model, lang, split, CAST(c AS VARCHAR) AS class,
    CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS p,
    CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS r,
    CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END AS f,
    CAST(tp + fn AS DOUBLE) AS s, tp FROM pc)"""
DUCK_TOT = """tot AS (
  SELECT model, lang, split, avg(p) AS mp, avg(r) AS mr, avg(f) AS mf, sum(s) AS n,
    sum(p * s) / sum(s) AS wp, sum(r * s) / sum(s) AS wr, sum(f * s) / sum(s) AS wf, sum(tp) / sum(s) AS acc
  FROM cls GROUP BY ALL)"""
DUCK_LNG = """lng AS (
  SELECT model, lang, split, class, 'precision' AS metric, p AS value FROM cls
  UNION ALL SELECT model, lang, split, class, 'recall', r FROM cls
  UNION ALL SELECT model, lang, split, class, 'f1-score', f FROM cls
  UNION ALL SELECT model, lang, split, class, 'support', s FROM cls
  UNION ALL SELECT model, lang, split, 'macro avg', 'precision', mp FROM tot
  UNION ALL SELECT model, lang, split, 'macro avg', 'recall', mr FROM tot
  UNION ALL SELECT model, lang, split, 'macro avg', 'f1-score', mf FROM tot
  UNION ALL SELECT model, lang, split, 'macro avg', 'support', n FROM tot
  UNION ALL SELECT model, lang, split, 'weighted avg', 'precision', wp FROM tot
  UNION ALL SELECT model, lang, split, 'weighted avg', 'recall', wr FROM tot
  UNION ALL SELECT model, lang, split, 'weighted avg', 'f1-score', wf FROM tot
  UNION ALL SELECT model, lang, split, 'weighted avg', 'support', n FROM tot
  UNION ALL SELECT model, lang, split, 'accuracy', 'accuracy', acc FROM tot)"""


@register("class_report", fx.with_views(
    "SELECT model, lang, split, class, metric, round(value, 6) AS value FROM lng",
    "predictions", extra=[DUCK_CONF, DUCK_PC, DUCK_CLS, DUCK_TOT, DUCK_LNG]))
def q_class_report(spark, sf_dir):
    r = metrics.class_report(preds(spark, sf_dir), by=BY)
    return r.select(*BY, "class", "metric", F.round("value", 6).alias("value"))


@register("cohen_kappa", fx.with_views("""
SELECT model, lang, split, round(CASE WHEN pe = 1 THEN NULL ELSE (po - pe) / (1 - pe) END, 6) AS kappa FROM (
  SELECT model, lang, split, sum(tp) / sum(tp + fn) AS po,
         sum((tp + fn) * (tp + fp)) / (CAST(sum(tp + fn) AS DOUBLE) * sum(tp + fn)) AS pe
  FROM pc GROUP BY ALL) x""", "predictions", extra=[DUCK_CONF, DUCK_PC]))
def q_cohen_kappa(spark, sf_dir):
    k = metrics.cohen_kappa(preds(spark, sf_dir), by=BY)
    return k.select(*BY, F.round("kappa", 6).alias("kappa"))


def matrix(spark, sf_dir):
    p = preds(spark, sf_dir).withColumn("row_pos", F.lit(0))
    return compare.model_matrix(p, MODELS, keys=["lang", "split", "docid", "eventid"])


@register("fleiss_kappa", fx.with_views("""
SELECT lang, split, round(CASE WHEN pe = 1 THEN NULL ELSE (pbar - pe) / (1 - pe) END, 6) AS fleiss_kappa FROM (
  SELECT lang, split, avg(((5 - n1) * (5 - n1) + n1 * n1 - 5) / 20.0) AS pbar,
         power(1 - sum(n1) / (count(*) * 5.0), 2) + power(sum(n1) / (count(*) * 5.0), 2) AS pe
  FROM (SELECT lang, split, docid, eventid, sum(coalesce(pred, 0)) AS n1 FROM predictions GROUP BY ALL) e
  GROUP BY ALL) x""", "predictions"))
def q_fleiss_kappa(spark, sf_dir):
    k = metrics.fleiss_kappa(matrix(spark, sf_dir), MODELS, by=["lang", "split"])
    return k.select("lang", "split", F.round("fleiss_kappa", 6).alias("fleiss_kappa"))
