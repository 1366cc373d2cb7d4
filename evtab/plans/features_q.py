"""Queries: tf, idf, vocabulary, tf-idf, positional features, linear scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from evtab.operators import features as FE
from evtab.plans import fixtures as fx
from evtab.plans.corpus_q import DUCK_POS, pos_rule
from evtab.plans.registry import register
from evtab.plans.text_q import duck_tokens

# One feature configuration for all queries: the documented window (2, 2)
# and vocabulary size, with bag-of-words blocks and bigrams switched on so
# every code path runs.
LEFT, RIGHT, BOW, MAX_FEATURES, NGRAM = 2, 2, True, 3000, (1, 2)
BIAS = 0.05


def feature_rows(spark, sf_dir):
    s = fx.samples(spark, sf_dir).withColumn(
        "label", F.coalesce((F.col("raw_label") == "yes_its_anchorable").cast("int"), F.lit(0)))
    return FE.prepare_rows(s, pos_rule)


def transformer():
    return FE.PositionalFeatures(LEFT, RIGHT, BOW, MAX_FEATURES, NGRAM)


def fitted(spark, sf_dir):
    """(rows, transformer, fitted model, final cells of all rows)."""
    pf = transformer()
    fit, cells, rows = pf.fit_transform(feature_rows(spark, sf_dir), F.col("split") == "train")
    return rows, pf, fit, cells


def train_fit(spark, sf_dir):
    """(rows, fitted model): no cells are built for it."""
    pf = transformer()
    rows = pf.landed(feature_rows(spark, sf_dir))
    return rows, pf.fit(rows.filter(F.col("split") == "train"))


def vocabulary(spark, sf_dir):
    """The term vocabulary alone."""
    pf = transformer()
    train = pf.landed(feature_rows(spark, sf_dir).filter(F.col("split") == "train").select("words"))
    return pf.vocabulary(train, train.count())


def linear_weights(kept):
    return kept.select(F.col("fidx").alias("col"), (((F.col("fidx") % 7) - 3) / 10.0).alias("w"))


SPAN = LEFT + RIGHT + 1
DUCK_FEATURES = [f"""fs AS (
  SELECT eventid, split, CASE WHEN raw_label = 'yes_its_anchorable' THEN 1 ELSE 0 END AS label, label_confidence,
         {duck_tokens("lower(concat_ws(' ', before, verb, after))")} AS w,
         {duck_tokens("concat_ws(' ', before, verb, after)")} AS o, len({duck_tokens('before')}) AS verb_idx
  FROM samples)""",
                 """wt AS (SELECT eventid, split, verb_idx, unnest(w) AS word, unnest(o) AS orig,
                  generate_subscripts(w, 1) - 1 AS j FROM fs)""",
                 """terms AS (SELECT eventid, split, word AS term FROM wt
  UNION ALL SELECT a.eventid, a.split, a.word || ' ' || b.word FROM wt a JOIN wt b ON a.eventid = b.eventid AND b.j = a.j + 1)""",
                 "tf AS (SELECT eventid, split, term, count(*) AS tf FROM terms GROUP BY ALL)",
                 "ntr AS (SELECT count(*) AS n FROM fs WHERE split = 'train')",
                 "dfq AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM tf WHERE split = 'train' GROUP BY term)",
                 f"""vocab AS (SELECT term, df, cf, row_number() OVER (ORDER BY term) - 1 AS idx
  FROM (SELECT * FROM dfq ORDER BY cf DESC, term LIMIT {MAX_FEATURES}) x)""",
                 "idf AS (SELECT vocab.*, ln((1.0 + n) / (1.0 + df)) + 1 AS idf FROM vocab, ntr)",
                 "tw AS (SELECT t.eventid, t.split, t.term, i.idx, t.tf * i.idf AS w FROM tf t JOIN idf i USING (term))",
                 "tv AS (SELECT eventid, split, term, idx, w / sqrt(sum(w * w) OVER (PARTITION BY eventid)) AS value FROM tw)",
                 f"pt AS (SELECT eventid, split, j, lower({DUCK_POS.replace('{t}', 'orig')}) AS tag FROM wt)",
                 "ptf AS (SELECT eventid, split, tag AS term, count(*) AS tf FROM pt GROUP BY ALL)",
                 "pdf AS (SELECT term, count(*) AS df FROM ptf WHERE split = 'train' GROUP BY term)",
                 """pidf AS (SELECT term, df, row_number() OVER (ORDER BY term) - 1 AS idx,
  ln((1.0 + n) / (1.0 + df)) + 1 AS idf FROM pdf, ntr)""",
                 "pw AS (SELECT t.eventid, t.term, i.idx, t.tf * i.idf AS w FROM ptf t JOIN pidf i USING (term))",
                 "pv AS (SELECT eventid, term, idx, w / sqrt(sum(w * w) OVER (PARTITION BY eventid)) AS value FROM pw)",
                 "sz AS (SELECT (SELECT count(*) FROM vocab) AS V, (SELECT count(*) FROM pidf) AS P)",
                 """tok AS (
  SELECT w.eventid, w.split, w.j - w.verb_idx AS d, tv.idx AS widx, tv.value AS wval, pv.idx AS pidx, pv.value AS pval
  FROM wt w JOIN pt p ON p.eventid = w.eventid AND p.j = w.j
  JOIN tv ON tv.eventid = w.eventid AND tv.term = w.word
  LEFT JOIN pv ON pv.eventid = w.eventid AND pv.term = p.tag)""",
                 f"""cells AS (
  SELECT eventid, split, widx AS col, wval AS v FROM tok WHERE d < 0
  UNION ALL SELECT eventid, split, V + widx, wval FROM tok, sz WHERE d > 0
  UNION ALL SELECT eventid, split, 2 * V + (d + {LEFT}) * V + widx, wval FROM tok, sz WHERE d BETWEEN -{LEFT} AND {RIGHT}
  UNION ALL SELECT eventid, split, (2 + {SPAN}) * V + (d + {LEFT}) * P + pidx, pval FROM tok, sz
    WHERE d BETWEEN -{LEFT} AND {RIGHT} AND pidx IS NOT NULL)""",
                 "summed AS (SELECT eventid, split, col, sum(v) AS value FROM cells GROUP BY ALL)",
                 """kept AS (SELECT col, row_number() OVER (ORDER BY col) - 1 AS fidx
  FROM (SELECT DISTINCT col FROM summed WHERE split = 'train') x)""",
                 "feat AS (SELECT s.eventid, s.split, k.fidx AS col, s.value FROM summed s JOIN kept k USING (col))"]


def oracle(sql: str) -> str:
    return fx.with_views(sql, "samples", extra=DUCK_FEATURES)


@register("term_frequency", oracle("SELECT eventid, term, tf FROM tf"))
def q_term_frequency(spark, sf_dir):
    tf = FE.term_frequency(feature_rows(spark, sf_dir), n_max=NGRAM[1])
    return tf.select(F.col("row.eventid"), "term", "tf")


@register("build_vocab", oracle("SELECT term, idx, df, CAST(cf AS BIGINT) AS cf FROM vocab"))
def q_build_vocab(spark, sf_dir):
    return vocabulary(spark, sf_dir).select("term", "idx", "df", F.col("cf").cast("long").alias("cf"))


@register("idf", oracle("SELECT term, round(idf, 6) AS idf FROM idf"))
def q_idf(spark, sf_dir):
    return vocabulary(spark, sf_dir).select("term", F.round("idf", 6).alias("idf"))


@register("tfidf", oracle("SELECT eventid, term, round(value, 6) AS value FROM tv"))
def q_tfidf(spark, sf_dir):
    pf = transformer()
    rows = pf.landed(feature_rows(spark, sf_dir))
    train = rows.filter(F.col("split") == "train")
    t = pf.text_tfidf(rows, pf.vocabulary(train, train.count()))
    return t.select(F.col("row.eventid"), "term", F.round("value", 6).alias("value"))


@register("positional_features", oracle("SELECT eventid, col, round(value, 6) AS value FROM feat"))
def q_positional_features(spark, sf_dir):
    cells = fitted(spark, sf_dir)[3]
    return cells.select(F.col("row.eventid"), "col", F.round("value", 6).alias("value"))


@register("kept_columns", oracle("SELECT col, fidx FROM kept"))
def q_kept_columns(spark, sf_dir):
    fit = train_fit(spark, sf_dir)[1]
    return fit.kept.select("col", "fidx")


@register("feature_shape", oracle(
    "SELECT split, count(*) AS n_rows, (SELECT count(*) FROM kept) AS n_cols FROM fs GROUP BY split"))
def q_feature_shape(spark, sf_dir):
    rows, fit = train_fit(spark, sf_dir)
    return FE.feature_shape(rows, fit)


@register("class_weights", oracle("""
SELECT eventid, label, round(n * 1.0 / (k * c) * label_confidence, 6) AS weight
FROM fs JOIN (SELECT label, count(*) AS c FROM fs WHERE split = 'train' GROUP BY label) USING (label),
     (SELECT count(*) AS n, count(DISTINCT label) AS k FROM fs WHERE split = 'train') t
WHERE split = 'train'"""))
def q_class_weights(spark, sf_dir):
    tr = feature_rows(spark, sf_dir).filter(F.col("split") == "train")
    w = FE.class_weights(tr, "label", "label_confidence")
    return w.select(F.col("row.eventid"), "label", F.round("weight", 6).alias("weight"))


@register("predict_linear", oracle(f"""
SELECT f.eventid, f.split, round(coalesce(s.score, 0) + {BIAS}, 6) AS score,
       CAST(coalesce(s.score, 0) + {BIAS} > 0 AS INTEGER) AS pred
FROM fs f LEFT JOIN (SELECT eventid, sum(value * ((col % 7) - 3) / 10.0) AS score FROM feat GROUP BY 1) s USING (eventid)"""))
def q_predict_linear(spark, sf_dir):
    rows, _, fit, cells = fitted(spark, sf_dir)
    p = FE.predict_linear(rows.select("row", "split"), cells, linear_weights(fit.kept), BIAS)
    return p.select(F.col("row.eventid"), "split", F.round("score", 6).alias("score"), "pred")


SVM_C, SVM_PENALTY, SVM_ITER, SVM_TOL = 1.0, "l1", 1000, 1e-4   # tol: the default of sklearn's LinearSVC


@register("fit_linear_svc")
def q_fit_linear_svc(spark, sf_dir):
    """Squared-hinge l1 SVM with balanced, confidence-weighted classes (the
    documented run), fitted once on train and scored on dev and test."""
    from evtab.operators.svm import fit_linear_svc
    rows, _, fit, cells = fitted(spark, sf_dir)
    cells = cells.checkpoint(eager=True)             # read for the fit and for the scores
    train = rows.filter(F.col("split") == "train").select("row", "label", "label_confidence")
    n_cols = fit.kept.count()
    model = fit_linear_svc(cells.join(train.select("row"), "row", "left_semi"), train, n_cols, SVM_C,
                           SVM_PENALTY, True, "label_confidence", SVM_ITER, SVM_TOL)
    held = rows.filter(F.col("split") != "train").select("row", "split", "label")
    p = FE.predict_linear(held, cells, model.weights_df(spark), model.bias)
    return p.select(F.col("row.eventid"), "split", "label", "pred")
