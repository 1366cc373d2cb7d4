"""File sources: annotation CSVs, id lists, prediction and review tables,
word-vector tables.

CSV rows carry an explicit order: ``file_priority`` (position of the file in
the call) and ``row_pos`` (by file name and place in the file, see
``records``). Cells are read as text and only named columns are cast, so an id
such as ``007`` stays what it is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evtab.sources.records import read_table

# ---- fixed values ------------------------------------------------------------
# Strings pandas' CSV reader turns into missing values by default.
PANDAS_NULL_VALUES = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
                      "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
# ------------------------------------------------------------------------------


def null_as_pandas(df: DataFrame, null_values: Sequence[str] = PANDAS_NULL_VALUES) -> DataFrame:
    """String cells equal to one of ``null_values`` become null (pandas'
    default CSV behaviour, so a verb 'NA' is missing, later '')."""
    vals = list(null_values)
    out = df
    for f in df.schema.fields:
        if f.dataType.simpleString() == "string":
            out = out.withColumn(f.name, F.when(F.col(f"`{f.name}`").isin(vals), F.lit(None).cast("string"))
                                 .otherwise(F.col(f"`{f.name}`")))
    return out


def typed(df: DataFrame) -> DataFrame:
    """Annotation columns cast from text after missing values became null:
    ``_golden`` boolean, ``*:confidence`` double; a cell that is neither fails."""
    for c in df.columns:
        kind = "boolean" if c == "_golden" else "double" if c.endswith(":confidence") else None
        if kind:
            df = df.withColumn(c, F.col(f"`{c}`").cast(kind))
    return df


def read_annotations(spark: SparkSession, paths: Sequence[str] | str, sources: Sequence[str | None] | None = None,
                     schema=None, null_values: Sequence[str] | None = PANDAS_NULL_VALUES) -> DataFrame:
    """Headered CSV files (quoted multi-line text, doubled quotes), stacked in
    the given order with ``source``, ``file_priority`` and ``row_pos``.
    Columns missing from a file are null; unknown columns are kept."""
    if isinstance(paths, str):
        paths = [paths]
    sources = list(sources) if sources is not None else [None] * len(paths)
    out = None
    for prio, (p, src) in enumerate(zip(paths, sources)):
        df = read_table(spark, p)
        if null_values:
            df = null_as_pandas(df, null_values)
        df = typed(df) if schema is None else df.select(*[
            F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) if f.name in df.columns
            else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields], "row_pos")
        df = df.withColumn("file_priority", F.lit(prio))
        if src is not None:
            df = df.withColumn("source", F.lit(src))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def read_id_list(spark: SparkSession, path: str, fmt: str = "tsv", col: str = "docid") -> DataFrame:
    """Distinct ids: first column of a headerless TSV (``'tsv'``) or every
    whitespace-separated word of a text file (``'words'``)."""
    if fmt == "tsv":
        df = spark.read.option("sep", "\t").option("header", False).csv(path)
        return df.select(F.col("_c0").alias(col)).dropna().distinct()
    if fmt == "words":
        from evtab.functions.text import ws_tokens
        t = spark.read.text(path)
        return t.select(F.explode(ws_tokens("value")).alias(col)).distinct()
    raise ValueError("fmt must be 'tsv' or 'words'")


def _numbers(df: DataFrame) -> DataFrame:
    """``pred``, ``label`` and ``annotation`` as whole numbers, ``prob`` as a double; all else stays text."""
    df = null_as_pandas(df)
    for c in df.columns:
        if c in ("pred", "label", "annotation"):
            df = df.withColumn(c, F.col(c).cast("double").cast("int"))
        elif c == "prob":
            df = df.withColumn(c, F.col(c).cast("double"))
    return df


def read_predictions(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """One CSV per model name -> long table with ``model``; files without a
    ``prob`` column get nulls. A leading unnamed index column is dropped."""
    out = None
    for prio, (model, path) in enumerate(paths.items()):
        df = _numbers(read_table(spark, path)).withColumn("file_priority", F.lit(prio)).withColumn("model", F.lit(model))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if "prob" not in out.columns:
        out = out.withColumn("prob", F.lit(None).cast("double"))
    return out


def read_review(spark: SparkSession, path: str, sep: str = ";") -> DataFrame:
    """Human review sheet (semicolon CSV by default) with ``row_pos``."""
    return _numbers(read_table(spark, path, sep))


def read_vectors(spark: SparkSession, path: str, word: str = "word", vector: str = "vector") -> DataFrame:
    """(word, vector array<float>) parquet table."""
    return spark.read.parquet(path).select(F.col(word).alias("word"), F.col(vector).alias("vector"))
