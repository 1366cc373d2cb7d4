"""Lining up predictions of many models: key joins, alignment checks, the
model matrix (pivot), review sheets and their evaluation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evtab.operators import metrics
from evtab.operators.split import seeded_sample

EVENT_KEY = ["docid", "eventid"]


def attach_predictions(df: DataFrame, preds: DataFrame, keys: Sequence[str] = EVENT_KEY,
                       cols: Sequence[str] = ("pred", "prob"), on_duplicate: str = "error") -> DataFrame:
    """Each row gets its prediction by event key (the reference copies by
    position after asserting the keys line up; a key join needs no order).

    No row is ever multiplied: two predictions for one key fail the job
    (``on_duplicate='error'``), or the smallest is taken (``'first'``)."""
    if on_duplicate not in ("error", "first"):
        raise ValueError("on_duplicate must be 'error' or 'first'")
    keys = list(keys)
    p = preds.select(*keys, *[c for c in cols if c in preds.columns])
    have = [c for c in p.columns if c not in keys]
    if have:
        p = p.groupBy(*keys).agg(F.min(F.struct(*have)).alias("_p"), F.count(F.lit(1)).alias("_n"))
        one = F.col("_n") == 1
        if on_duplicate == "error":
            one = F.when(~one, F.raise_error(F.concat(F.lit("two predictions for key "), F.concat_ws(
                "|", *[F.col(k).cast("string") for k in keys])))).otherwise(F.lit(True))
        p = (p.filter(one) if on_duplicate == "error" else p).select(*keys, *[F.col(f"_p.{c}").alias(c) for c in have])
    for c in cols:
        if c not in p.columns:
            p = p.withColumn(c, F.lit(None).cast("double"))
    return df.drop(*[c for c in cols if c in df.columns]).join(p, keys, "left")


def alignment_check(a: DataFrame, b: DataFrame, keys: Sequence[str] = EVENT_KEY) -> DataFrame:
    """One row: keys only in a, only in b, duplicated keys on each side, and
    ``aligned`` = all four are 0."""
    keys = list(keys)
    ca = a.groupBy(*keys).agg(F.count(F.lit(1)).alias("_na"))
    cb = b.groupBy(*keys).agg(F.count(F.lit(1)).alias("_nb"))
    j = ca.join(cb, keys, "full")
    out = j.agg(F.count_if(F.col("_nb").isNull()).alias("left_only"),
                F.count_if(F.col("_na").isNull()).alias("right_only"),
                F.count_if(F.col("_na") > 1).alias("left_dup_keys"),
                F.count_if(F.col("_nb") > 1).alias("right_dup_keys"))
    return out.withColumn("aligned", (F.col("left_only") + F.col("right_only") + F.col("left_dup_keys")
                                      + F.col("right_dup_keys")) == 0)


def model_matrix(preds: DataFrame, models: Sequence[str], keys: Sequence[str] = EVENT_KEY,
                 order: str = "row_pos") -> DataFrame:
    """Long predictions (model, keys, pred, prob, label, order) -> one row per
    key with ``<m>``, ``<m>_conf``, ``<m>_is_correct`` for every model.
    A later row of the same model and key wins. Explicit pivot values keep it
    one aggregate (no distinct-values job); partial aggregation is skew-safe."""
    keys = list(keys)
    p = preds
    if "prob" not in p.columns:
        p = p.withColumn("prob", F.lit(None).cast("double"))
    p = p.withColumn("_ok", metrics.is_correct())
    wide = p.groupBy(*keys).pivot("model", list(models)).agg(
        F.max_by("pred", order).alias("pred"), F.max_by("prob", order).alias("conf"),
        F.max_by("_ok", order).alias("is_correct"))
    cols = [F.col(k) for k in keys]
    for m in models:
        cols += [F.col(f"`{m}_pred`").alias(m), F.col(f"`{m}_conf`").alias(f"{m}_conf"),
                 F.col(f"`{m}_is_correct`").alias(f"{m}_is_correct")]
    return wide.select(*cols)


def attach_matrix(main: DataFrame, matrix: DataFrame, keys: Sequence[str] = EVENT_KEY) -> DataFrame:
    """Main rows keep their order key; models without the event get nulls."""
    return main.join(matrix, list(keys), "left")


def positional_join(a: DataFrame, b: DataFrame, order_a: Sequence[str] = ("row_pos",),
                    order_b: Sequence[str] = ("row_pos",)) -> DataFrame:
    """Rows of ``a`` beside the rows of ``b`` at the same place in their order (two files without keys, written in one
    order); ``row_pos`` counts from 0. Tables of different lengths fail the job. A column of both keeps ``a``'s cells."""
    from evtab.operators.features import sorted_index
    left, right = sorted_index(a, list(order_a), "_at"), sorted_index(b, list(order_b), "_at")
    left = left.withColumn("_l", F.lit(1))
    right = right.select("_at", F.lit(1).alias("_r"), *[c for c in b.columns if c not in a.columns])
    whole = F.when(F.col("_l").isNull() | F.col("_r").isNull(), F.raise_error(F.lit("tables of different lengths"))) \
        .otherwise(F.col("_at"))
    return left.join(right, "_at", "full").select(
        *[c for c in left.columns if c not in ("_at", "_l", "row_pos")],
        *[c for c in right.columns if c not in ("_at", "_r", "row_pos")], whole.alias("row_pos"))


def review_sheets(df: DataFrame, preds: DataFrame, n: int, seed: int = 42, key=("docid", "eventid"),
                  by: Sequence[str] = ("lang", "split"), on_short: str = "error",
                  keys: Sequence[str] = EVENT_KEY):
    """(all rows with predictions, sample with predictions, blind sample). ``keys`` line rows and predictions up."""
    with_preds = attach_predictions(df, preds, keys).withColumn("annotation", F.lit(""))
    with_preds = with_preds.drop(*[c for c in ("label", "label_confidence") if c in with_preds.columns])
    sample = seeded_sample(with_preds, n, key, seed, by, on_short)
    blind = sample.drop("pred", "prob")
    return with_preds, sample, blind


def review_eval(sample: DataFrame, annotated: DataFrame, keys: Sequence[str] = EVENT_KEY,
                by: Sequence[str] = ("lang", "split"), pos_subset: str = "VERB", nulls: str = "error") -> DataFrame:
    """Human labels beside predictions (by key), then macro-F1 and Cohen's
    kappa per group, over all rows and over ``pos == pos_subset``. An annotated
    row without a prediction fails the job, or with ``nulls='drop'`` is counted
    in ``n_missing`` and left out of the rest."""
    if nulls not in ("error", "drop"):
        raise ValueError("nulls must be 'error' or 'drop'")
    keys, by = list(keys), list(by)
    j = sample.drop("annotation").join(annotated.select(*keys, "annotation"), keys, "inner") \
        .withColumn("is_pred_correct", metrics.is_correct("pred", "annotation"))
    both = j.withColumn("subset", F.explode(F.when(F.col("pos") == pos_subset,
                                                   F.array(F.lit("all"), F.lit(pos_subset)))
                                            .otherwise(F.array(F.lit("all")))))
    g = [*by, "subset"]
    there = both.filter(F.col("pred").isNotNull()) if nulls == "drop" else both
    f1 = metrics.macro_f1(there, "annotation", "pred", g)
    kap = metrics.cohen_kappa(there, "annotation", "pred", g)
    cnt = both.groupBy(*g).agg(F.count("pred" if nulls == "drop" else F.lit(1)).alias("n"),
                               F.count_if(F.col("pred").isNull()).alias("n_missing"),
                               F.sum("is_pred_correct").alias("n_correct"))
    return cnt.join(f1, g, "left").join(kap, g, "left")


def preview(df: DataFrame, n: int = 5, by: Sequence[str] = (), order: Sequence[str] = ("row_pos",),
            text: str = "input", label: str = "label", pred: str = "pred") -> DataFrame:
    """First ``n`` rows per group as '<input>: true <label>, pred <pred>'
    (a per-group top-n: the plan uses a window group limit)."""
    from pyspark.sql import Window
    w = Window.partitionBy(*by).orderBy(*order)
    r = df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
    return r.select(*by, "rank", F.concat(F.col(text), F.lit(": true "), F.col(label).cast("string"),
                                          F.lit(", pred "), F.col(pred).cast("string")).alias("preview"))
