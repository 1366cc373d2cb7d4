"""Cleaning of crowd-annotation tables: duplicates, broken rows, splits, labels.

Input rows carry an explicit ``row_pos`` (file priority, then position in the
file): Spark rows have no order, and ties in the reference depend on it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evtab.functions.text import remove_spaces, strip_tags

# ---- fixed values ------------------------------------------------------------
EVENT_KEY = ["docid", "verb", "eventid"]
ANSWER_COL = "can_the_verb_span_stylecolorblueverb_span_be_anchored_in_time"
CONFIDENCE_COL = ANSWER_COL + ":confidence"
POSITIVE_ANSWER = "yes_its_anchorable"
# ------------------------------------------------------------------------------


def first_by_order(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str],
                   last: bool = False) -> DataFrame:
    """One row per key: the first (or last) by ``order``.

    Written as an aggregate of ``min(struct(order..., row))`` (a sort aggregate:
    the packed rows are not fixed-width) instead of a window: the partial (map-side) aggregate collapses a hot key before the
    shuffle, so a key holding a third of the table never lands whole in one
    task. Rows keep all their columns.
    """
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    order_cols = [F.col(o) if isinstance(o, str) else o for o in order]
    packed = F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order_cols)],
                      F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_row"))
    agg = (F.max if last else F.min)(packed).alias("_best")
    out = df.groupBy(*keys).agg(agg)
    return out.select(*keys, *[F.col("_best._row").getField(c).alias(c) for c in rest]).select(df.columns)


def golden_priority(golden: str = "_golden", state: str = "_unit_state") -> Column:
    """0: flagged golden; 1: golden state; 2: neither."""
    return (F.when(F.col(golden) == F.lit(True), 0)
            .when(F.col(state) == "golden", 1)
            .otherwise(2))


def dedup_golden(df: DataFrame, key: Sequence[str] = EVENT_KEY, order: str = "row_pos",
                 on_missing: str = "error") -> DataFrame:
    """Keep one row per duplicated event key: the first ``_golden`` row, else the
    first row in state 'golden'. Singletons stay. A key with a null keeps all
    its rows (pandas drops null group keys, so they are never deduplicated).

    ``on_missing='error'`` fails the job when a duplicate group has no golden
    row (the reference raises); ``'first'`` keeps its first row instead.
    """
    if on_missing not in ("error", "first"):
        raise ValueError(f"on_missing must be 'error' or 'first', not {on_missing!r}")
    key = list(key)
    has_null = F.lit(False)
    for k in key:
        has_null = has_null | F.col(k).isNull()
    nulls = df.filter(has_null)
    # choose by fixed-width values in a hash aggregate; whole rows are fetched by them afterwards
    place = [F.col(c) for c in ("file_priority",) if c in df.columns and order == "row_pos"] + [F.col(order)]
    chosen = F.struct(golden_priority().alias("p"), *[o.alias(f"o{i}") for i, o in enumerate(place)])
    ranked = df.filter(~has_null).withColumn("_at", chosen)
    best = ranked.groupBy(*key).agg(
        *[F.min(F.col("_at.p")).alias("_p"), F.min("_at").alias("_best"), F.count(F.lit(1)).alias("_n")])
    if on_missing == "error":
        check = F.when((F.col("_n") > 1) & (F.col("_p") == 2),
                       F.raise_error(F.concat(F.lit("duplicate event without a golden row: "),
                                              F.concat_ws("|", *[F.col(k) for k in key]))))
        best = best.filter(check.isNull())
    kept = ranked.join(best.select(*key, "_best"), key).filter(F.col("_at") == F.col("_best")).select(df.columns)
    return kept.unionByName(nulls)


def duplicate_events(df: DataFrame, key: Sequence[str] = EVENT_KEY) -> DataFrame:
    """Keys seen more than once, with their row count (aggregate, skew-safe)."""
    return (df.groupBy(*key).agg(F.count(F.lit(1)).alias("n_rows"))
            .filter(F.col("n_rows") > 1))


def fill_blank(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """null -> '' on string columns (numerics stay null)."""
    strings = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    cols = [c for c in (cols or strings) if c in strings]
    return df.na.fill("", subset=cols) if cols else df


def broken_flag(before="before", verb="verb", after="after", bodytext="bodytext") -> Column:
    """True when before+verb+after (spaces removed) is not inside bodytext with
    tags and spaces removed."""
    def s(c):
        return F.coalesce(F.col(c), F.lit(""))
    parts = remove_spaces(F.concat(s(before), s(verb), s(after)))
    body = remove_spaces(strip_tags(s(bodytext)))
    return ~F.contains(body, parts)


def flag_broken(df: DataFrame) -> DataFrame:
    return fill_blank(df, ["before", "verb", "after", "bodytext"]).withColumn("broken", broken_flag())


def split_quarantine(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, bad) from the ``broken`` flag."""
    return df.filter(~F.col("broken")), df.filter(F.col("broken"))


def drop_broken(df: DataFrame) -> DataFrame:
    return split_quarantine(df)[0]


def with_membership(df: DataFrame, ids: DataFrame, flag: str, key: str = "docid",
                    id_col: str | None = None) -> DataFrame:
    """Adds boolean ``flag``: ``key`` is in ``ids``. A left join on the
    distinct id list; AQE broadcasts it when it is measured small."""
    id_col = id_col or ids.columns[0]
    marks = ids.select(F.col(id_col).alias("_id")).distinct().withColumn(flag, F.lit(True))
    out = df.join(marks, df[key] == marks["_id"], "left").drop("_id")
    return out.withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))


def semi_docs(df: DataFrame, ids: DataFrame, key: str = "docid") -> DataFrame:
    id_col = ids.columns[0]
    return df.join(ids.select(F.col(id_col).alias(key)).distinct(), key, "left_semi")


def anti_docs(df: DataFrame, ids: DataFrame, key: str = "docid") -> DataFrame:
    id_col = ids.columns[0]
    return df.join(ids.select(F.col(id_col).alias(key)).dropna().distinct(), key, "left_anti")


def tag_source(df: DataFrame, source: str | None = None, platinum: DataFrame | None = None,
               key: str = "docid") -> DataFrame:
    """Constant tag, or 'platinum' / 'aq' by membership in ``platinum``."""
    if platinum is None:
        return df.withColumn("source", F.lit(source))
    m = with_membership(df, platinum, "_plat", key)
    return m.withColumn("source", F.when(F.col("_plat"), "platinum").otherwise("aq")).drop("_plat")


def assign_split(df: DataFrame, platinum: DataFrame, dev: DataFrame | None = None,
                 key: str = "docid") -> DataFrame:
    """test when in platinum, else train; the dev list overrides both."""
    out = with_membership(df, platinum, "_test", key)
    split = F.when(F.col("_test"), "test").otherwise("train")
    if dev is not None:
        out = with_membership(out, dev, "_dev", key)
        split = F.when(F.col("_dev"), "dev").otherwise(split)
    out = out.withColumn("split", split)
    return out.drop("_test", "_dev") if dev is not None else out.drop("_test")


def binary_label(df: DataFrame, answer: str = ANSWER_COL, positive: str = POSITIVE_ANSWER,
                 out: str = "label") -> DataFrame:
    """int(answer == positive); null answers give 0."""
    return df.withColumn(out, F.col(f"`{answer}`").eqNullSafe(F.lit(positive)).cast("int"))


def rename_confidence(df: DataFrame, src: str = CONFIDENCE_COL) -> DataFrame:
    return df.withColumnRenamed(src, "label_confidence") if src in df.columns else df


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).cast("long").alias("n")).orderBy(F.desc("n"), col)


def union_sources(frames: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Stack per-source tables in priority order; ``file_priority`` + the
    source's own ``row_pos`` keep the input order without a global numbering."""
    out = None
    for prio, (name, df) in enumerate(frames):
        d = df.withColumn("file_priority", F.lit(prio))
        if "source" not in d.columns:
            d = d.withColumn("source", F.lit(name))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out


def stage_counts(raw: DataFrame, deduped: DataFrame, clean: DataFrame,
                 by: str = "split") -> DataFrame:
    """Rows after each cleaning step, then rows per ``by`` value after cleaning."""
    def total(df, stage):
        return df.agg(F.count(F.lit(1)).cast("long").alias("n_rows")).select(
            F.lit(stage).alias("stage"), F.lit("").alias("key"), "n_rows")
    per = clean.groupBy(F.col(by).alias("key")).agg(F.count(F.lit(1)).cast("long").alias("n_rows")) \
        .select(F.lit(by).alias("stage"), "key", "n_rows")
    return total(raw, "raw").unionByName(total(deduped, "no_dupl")) \
        .unionByName(total(clean, "no_broken")).unionByName(per)


def clean_annotations(raw: DataFrame, platinum: DataFrame | None = None, dev: DataFrame | None = None,
                      on_missing: str = "error", answer: str = ANSWER_COL) -> DataFrame:
    """dedup -> fill -> flag -> drop broken; then split (when the lists are
    given), the binary label and ``label_confidence`` (when the answer
    columns exist)."""
    out = drop_broken(flag_broken(dedup_golden(raw, on_missing=on_missing)))
    if platinum is not None:
        out = assign_split(out, platinum, dev)
    if answer in out.columns:
        out = binary_label(out, answer)
    conf = answer + ":confidence"
    if conf in out.columns:
        out = rename_confidence(out, conf)
    return out
