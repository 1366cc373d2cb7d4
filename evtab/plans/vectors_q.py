"""Queries: vector lookup, cosine, verb vote, exact k-NN and k-NN labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from evtab.functions import arrays as A
from evtab.operators import vectors as V
from evtab.plans import fixtures as fx
from evtab.plans.registry import register

K = 17  # neighbours of the documented run

DUCK_COS = ("list_dot_product({a}::DOUBLE[], {b}::DOUBLE[]) / "
            "(sqrt(list_dot_product({a}::DOUBLE[], {a}::DOUBLE[])) * sqrt(list_dot_product({b}::DOUBLE[], {b}::DOUBLE[])))")


def duck_cos(a, b):
    return DUCK_COS.replace("{a}", a).replace("{b}", b)


DUCK_KNN = f"""nn AS (
  SELECT query, neighbor, sim, rank FROM (
    SELECT q.verb AS query, r.verb AS neighbor, {duck_cos('q.vector', 'r.vector')} AS sim,
           row_number() OVER (PARTITION BY q.verb ORDER BY {duck_cos('q.vector', 'r.vector')} DESC, r.verb) AS rank
    FROM (SELECT DISTINCT verb, vector FROM vectors WHERE split = 'test') q
    CROSS JOIN (SELECT DISTINCT verb, vector FROM vectors WHERE split = 'train') r) x
  WHERE rank <= {K})"""


@register("vector_lookup", fx.with_views("""
SELECT w.verb, v.vector IS NOT NULL AS found, CAST(len(v.vector) AS INTEGER) AS dim,
       round(sqrt(list_dot_product(v.vector::DOUBLE[], v.vector::DOUBLE[])), 6) AS norm
FROM (SELECT DISTINCT verb FROM vectors WHERE split = 'test') w LEFT JOIN vectors v ON w.verb = v.verb""",
    "vectors"))
def q_vector_lookup(spark, sf_dir):
    v = fx.vectors(spark, sf_dir)
    words = v.filter(F.col("split") == "test").select("verb")
    out = V.lookup_vectors(words, v, "verb", "vector", missing="report")
    return out.select("verb", "found", F.size("vector").alias("dim"), F.round(A.norm("vector"), 6).alias("norm"))


@register("cosine", fx.with_views(f"""
SELECT a.vec_id, round({duck_cos('a.vector', 'b.vector')}, 6) AS cosine
FROM vectors a JOIN vectors b ON b.vec_id = a.vec_id + 1""", "vectors"))
def q_cosine(spark, sf_dir):
    v = fx.vectors(spark, sf_dir)
    a = v.select("vec_id", F.col("vector").alias("va"))
    b = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vector").alias("vb"))
    return a.join(b, "vec_id").select("vec_id", F.round(A.cosine("va", "vb"), 6).alias("cosine"))


def train_samples(spark, sf_dir):
    s = fx.samples(spark, sf_dir).filter(F.col("split") == "train")
    return s.withColumn("label", F.coalesce((F.col("raw_label") == "yes_its_anchorable").cast("int"), F.lit(0)))


@register("verb_vote", fx.with_views("""
SELECT verb, n0, n1, CASE WHEN n0 > n1 THEN 0 WHEN n1 > n0 THEN 1 WHEN c0 > c1 THEN 0 ELSE 1 END AS label FROM (
  SELECT lower(verb) AS verb, CAST(count_if(label = 0) AS BIGINT) AS n0, CAST(count_if(label = 1) AS BIGINT) AS n1,
         coalesce(avg(CASE WHEN label = 0 THEN label_confidence END), 0) AS c0,
         coalesce(avg(CASE WHEN label = 1 THEN label_confidence END), 0) AS c1
  FROM (SELECT *, CASE WHEN raw_label = 'yes_its_anchorable' THEN 1 ELSE 0 END AS label
        FROM samples WHERE split = 'train') s GROUP BY 1) x""", "samples"))
def q_verb_vote(spark, sf_dir):
    return V.verb_vote(train_samples(spark, sf_dir)).select("verb", "n0", "n1", "label")


@register("knn_join", fx.with_views(
    "SELECT query, neighbor, round(sim, 6) AS similarity, rank FROM nn", "vectors", extra=[DUCK_KNN]))
def q_knn_join(spark, sf_dir):
    v = fx.vectors(spark, sf_dir)
    nn = V.knn_join(v.filter(F.col("split") == "test"), v.filter(F.col("split") == "train"), K)
    return nn.select("query", "neighbor", F.round("similarity", 6).alias("similarity"),
                     F.col("rank").cast("long").alias("rank"))


@register("knn_predict", fx.with_views("""
SELECT t.verb, CAST(p.pred AS INTEGER) AS pred, t.label FROM vectors t JOIN (
  SELECT nn.query, round_even(avg(r.label), 0) AS pred FROM nn JOIN vectors r ON r.verb = nn.neighbor GROUP BY 1) p
  ON p.query = t.verb WHERE t.split = 'test'""", "vectors", extra=[DUCK_KNN]))
def q_knn_predict(spark, sf_dir):
    v = fx.vectors(spark, sf_dir).withColumn("label_confidence", F.lit(1.0))
    test = v.filter(F.col("split") == "test").select("verb", "label")
    train = v.filter(F.col("split") == "train").select("verb", "label", "label_confidence")
    out = V.knn_predict(test, train, v.select("verb", "vector"), K)
    return out.select("verb", "pred", "label")
