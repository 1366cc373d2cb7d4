"""Derived views over the driver's test tables (FIXTURES.md part B).

Each view exists twice: Spark SQL (run by ``queries()``) and DuckDB SQL (used
as a CTE by ``oracle_sql()``). The two were checked to give the same rows.
All views are derived by Spark from the given tables, so their size grows
with them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """Round-robin a scan that arrives in fewer partitions than there are
    cores (a single-row-group file is read by one task whatever its size).
    The text work downstream is CPU-bound; on a cluster reading many files
    the scan already has more partitions than cores and this is a no-op."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    return df


# ---------------------------------------------------------------- Spark SQL
SPARK_SAMPLES = r"""
WITH w AS (SELECT doc_id, lang, source,
    filter(split(text, '(?U)[\\s\\x1c-\\x1f]+'), x -> x <> '') AS ws FROM {documents}),
p AS (SELECT *, CAST(doc_id % size(ws) AS INT) AS idx FROM w WHERE size(ws) > 0)
SELECT concat('e', p.doc_id) AS eventid, p.source AS docid, p.lang AS lang,
  concat_ws(' ', slice(ws, 1, idx)) AS before, ws[idx] AS verb,
  concat_ws(' ', slice(ws, idx + 2, size(ws))) AS after,
  CASE WHEN l.quality = 1 THEN 'yes_its_anchorable' WHEN l.quality = 0 THEN 'no_its_not_anchorable' END AS raw_label,
  0.5D + (p.doc_id % 50) / 100.0D AS label_confidence,
  CASE CAST(substring(p.source, 4) AS INT) % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'dev' ELSE 'train' END AS split
FROM p LEFT JOIN {labels} l ON p.doc_id = l.doc_id
"""

ANNOTATIONS_BODY = r"""
SELECT s.n AS n, s.n * 2 + c.copy AS row_pos, s.docid, s.eventid, s.lang, s.before, s.verb, s.after,
  concat('<p>', s.before, ' <b>', CASE WHEN s.n % 11 = 0 THEN '@@zz@@' ELSE s.verb END, '</b> ', s.after, '</p>') AS bodytext,
  (c.copy = 1 AND s.n % 14 <> 0) OR (c.copy = 0 AND s.n % 21 = 0) AS _golden,
  CASE WHEN c.copy = 1 THEN 'golden' ELSE 'finalized' END AS _unit_state,
  s.raw_label, s.label_confidence, CAST(3 + s.n % 5 AS INT) AS _trusted_judgments, s.split
FROM (SELECT *, CAST(substring(eventid, 2) AS BIGINT) AS n FROM {samples}) s
CROSS JOIN (SELECT 0 AS copy UNION ALL SELECT 1 AS copy) c
WHERE c.copy = 0 OR s.n % 7 = 0
"""

PREDICTIONS_BODY = r"""
SELECT m.model, s.lang, s.split, s.docid, s.eventid,
  CASE WHEN substring(md5(concat(m.model, ':', s.eventid)), 1, 1) IN ('0', '1', '2', '3')
       THEN 1 - s.label ELSE s.label END AS pred,
  CASE WHEN m.model IN ('m0', 'm1', 'm2')
       THEN CAST(50 + 3 * instr('0123456789abcdef', substring(md5(concat(m.model, ':', s.eventid)), 2, 1)) AS DOUBLE) / 100 END AS prob,
  s.label
FROM (SELECT *, CASE WHEN raw_label = 'yes_its_anchorable' THEN 1 ELSE 0 END AS label
      FROM {samples} WHERE raw_label IS NOT NULL AND split <> 'train') s
CROSS JOIN (SELECT 'm0' AS model UNION ALL SELECT 'm1' UNION ALL SELECT 'm2' UNION ALL SELECT 'm3' UNION ALL SELECT 'm4') m
"""

SPARK_COL_ROWS = r"""
WITH s AS (SELECT doc_id, lang, source, pe.pos AS sent_pos, pe.col AS line
           FROM {documents} LATERAL VIEW posexplode(split(text, '\n')) pe AS pos, col),
t AS (SELECT s.doc_id, s.lang, s.source, s.sent_pos, te.pos AS tok_pos, te.col AS token
      FROM s LATERAL VIEW posexplode(filter(split(s.line, '(?U)[\\s\\x1c-\\x1f]+'), x -> x <> '')) te AS pos, col)
SELECT concat('d', doc_id) AS docid, lang, CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split,
  CAST(sent_pos AS INT) AS sent_pos, CAST(tok_pos AS INT) AS tok_pos, token,
  CASE WHEN tok_pos % 7 = 3 THEN concat('e', sent_pos, '_', tok_pos)
       WHEN tok_pos % 7 = 4 AND sent_pos % 2 = 0 THEN concat('e', sent_pos, '_', tok_pos - 1) ELSE '' END AS eventid,
  CASE WHEN substring(md5(token), 1, 1) IN ('0', '1', '2', '3') THEN 'VERB'
       WHEN substring(md5(token), 1, 1) = '4' THEN 'AUX' ELSE 'NOUN' END AS pos
FROM t
"""

VECTORS_BODY = r"""
SELECT concat('v', vec_id) AS verb, vec_id, embedding AS vector, CAST(label % 2 AS INT) AS label,
  CASE WHEN vec_id % 4 = 0 THEN 'test' ELSE 'train' END AS split
FROM {embeddings}
"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SPARK_SAMPLES, documents=table(spark, sf_dir, "documents"),
                     labels=table(spark, sf_dir, "labels"))


# Spark side: the copy / model tables become a generator (explode of a literal
# array) instead of a join, so no plan carries a nested-loop join.
SPARK_ANNOTATIONS = (ANNOTATIONS_BODY
                     .replace("CROSS JOIN (SELECT 0 AS copy UNION ALL SELECT 1 AS copy) c",
                              "LATERAL VIEW explode(array(0, 1)) c AS copy"))
SPARK_PREDICTIONS = (PREDICTIONS_BODY
                     .replace("CROSS JOIN (SELECT 'm0' AS model UNION ALL SELECT 'm1' UNION ALL SELECT 'm2' "
                              "UNION ALL SELECT 'm3' UNION ALL SELECT 'm4') m",
                              "LATERAL VIEW explode(array('m0', 'm1', 'm2', 'm3', 'm4')) m AS model"))
assert SPARK_ANNOTATIONS != ANNOTATIONS_BODY and SPARK_PREDICTIONS != PREDICTIONS_BODY


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SPARK_ANNOTATIONS, samples=samples(spark, sf_dir))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SPARK_PREDICTIONS, samples=samples(spark, sf_dir))


def col_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SPARK_COL_ROWS, documents=table(spark, sf_dir, "documents"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(VECTORS_BODY, embeddings=table(spark, sf_dir, "embeddings"))


# ---------------------------------------------------------------- DuckDB SQL
DUCK_WS = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

DUCK_SAMPLES = r"""
w AS (SELECT doc_id, lang, source,
    list_filter(string_split_regex(text, '""" + DUCK_WS + r"""+'), lambda x: x <> '') AS ws FROM documents),
p AS (SELECT *, CAST(doc_id % len(ws) AS INT) AS idx FROM w WHERE len(ws) > 0),
samples AS (
SELECT concat('e', p.doc_id) AS eventid, p.source AS docid, p.lang AS lang,
  array_to_string(ws[1:idx], ' ') AS before, ws[idx + 1] AS verb,
  array_to_string(ws[idx + 2:], ' ') AS after,
  CASE WHEN l.quality = 1 THEN 'yes_its_anchorable' WHEN l.quality = 0 THEN 'no_its_not_anchorable' END AS raw_label,
  0.5::DOUBLE + (p.doc_id % 50) / 100.0::DOUBLE AS label_confidence,
  CASE CAST(substring(p.source, 4) AS INT) % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'dev' ELSE 'train' END AS split
FROM p LEFT JOIN labels l ON p.doc_id = l.doc_id)"""

DUCK_ANNOTATIONS = "annotations AS (" + ANNOTATIONS_BODY.replace("{samples}", "samples") + ")"
DUCK_PREDICTIONS = "predictions AS (" + PREDICTIONS_BODY.replace("{samples}", "samples") + ")"

DUCK_COL_ROWS = r"""
cs AS (SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS line,
                  generate_subscripts(string_split(text, chr(10)), 1) - 1 AS sent_pos FROM documents),
cl AS (SELECT *, list_filter(string_split_regex(line, '""" + DUCK_WS + r"""+'), lambda x: x <> '') AS ws FROM cs),
ct AS (SELECT doc_id, lang, sent_pos, unnest(ws) AS token, generate_subscripts(ws, 1) - 1 AS tok_pos FROM cl),
col_rows AS (
SELECT concat('d', doc_id) AS docid, lang, CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split,
  CAST(sent_pos AS INT) AS sent_pos, CAST(tok_pos AS INT) AS tok_pos, token,
  CASE WHEN tok_pos % 7 = 3 THEN concat('e', sent_pos, '_', tok_pos)
       WHEN tok_pos % 7 = 4 AND sent_pos % 2 = 0 THEN concat('e', sent_pos, '_', tok_pos - 1) ELSE '' END AS eventid,
  CASE WHEN substring(md5(token), 1, 1) IN ('0', '1', '2', '3') THEN 'VERB'
       WHEN substring(md5(token), 1, 1) = '4' THEN 'AUX' ELSE 'NOUN' END AS pos
FROM ct)"""

DUCK_VECTORS = "vectors AS (" + VECTORS_BODY.replace("{embeddings}", "embeddings") + ")"

DUCK_VIEWS = {
    "samples": DUCK_SAMPLES,
    "annotations": DUCK_ANNOTATIONS,
    "predictions": DUCK_PREDICTIONS,
    "col_rows": DUCK_COL_ROWS,
    "vectors": DUCK_VECTORS,
}
# views a view needs first
_DEPENDS = {"annotations": ["samples"], "predictions": ["samples"]}


def with_views(sql: str, *views: str, extra: list[str] | None = None) -> str:
    """Prefix ``sql`` with the DuckDB CTEs of ``views`` (dependencies first)."""
    order: list[str] = []
    for v in views:
        for d in _DEPENDS.get(v, []) + [v]:
            if d not in order:
                order.append(d)
    ctes = [DUCK_VIEWS[v].strip() for v in order] + [e.strip() for e in (extra or [])]
    return "WITH " + ",\n".join(ctes) + "\n" + sql.strip()


def col_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column-format file texts rebuilt from ``documents`` (one file per
    document, one sentence per non-empty line, the token rows of ``col_rows``
    with 'O' in the event cell of non-events; 'es' uses the sentence-first layout; every third file has a DCT line)."""
    from pyspark.sql import functions as F

    from evtab.functions.text import ws_tokens

    d = table(spark, sf_dir, "documents")

    def token_line(i, t, j):
        eid = (F.when(j % 7 == 3, F.concat(F.lit("e"), i.cast("string"), F.lit("_"), j.cast("string")))
               .when((j % 7 == 4) & (i % 2 == 0),
                     F.concat(F.lit("e"), i.cast("string"), F.lit("_"), (j - 1).cast("string")))
               .otherwise(F.lit("O")))
        full = F.concat_ws("\t", t, (j + 1).cast("string"), i.cast("string"), eid)
        shrinked = F.concat_ws("\t", i.cast("string"), (j + 1).cast("string"), t, eid)
        return F.when(F.col("lang") == "es", shrinked).otherwise(full)

    blocks = F.transform(F.split("text", "\n"),
                         lambda line, i: F.array_join(F.transform(ws_tokens(line), lambda t, j: token_line(i, t, j)), "\n"))
    body = F.array_join(F.filter(blocks, lambda b: b != ""), "\n\n")
    text = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("DCT\t2020-01-01\n"), body)).otherwise(body)
    return d.select(F.concat(F.lit("d"), F.col("doc_id")).alias("docid"), "lang",
                    F.when(F.col("doc_id") % 5 == 0, "test").otherwise("train").alias("split"),
                    text.alias("text"))


def piece_tokenizer(piece: int = 3, max_len: int | None = None):
    """Stub tokenizer: every word is cut into ``piece``-character pieces; one
    special piece on either side; ``max_len`` truncates (None: never)."""
    def tok(words: list[str]) -> list[int | None]:
        ids: list[int | None] = []
        for i, w in enumerate(words):
            ids.extend([i] * max(1, -(-len(w) // piece)))
        return [None, *(ids if max_len is None else ids[:max_len - 2]), None]

    def arrays(words: pa.ListArray) -> pa.ListArray:
        n = pc.list_value_length(words).fill_null(0).to_numpy()
        rows = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
        length = pc.utf8_length(words.flatten()).fill_null(0).to_numpy()
        pieces = np.maximum(1, -(-length // piece))
        ids, rows = np.repeat(place, pieces), np.repeat(rows, pieces)
        size = np.bincount(rows, minlength=len(n))
        if max_len is not None:
            kept = np.arange(len(ids)) - np.repeat(np.cumsum(size) - size, size) < max_len - 2
            ids, rows = ids[kept], rows[kept]
            size = np.bincount(rows, minlength=len(n))
        out = np.full(len(ids) + 2 * len(n), -1, dtype=np.int32)
        out[np.arange(len(ids)) + 2 * rows + 1] = ids
        ends = pa.array(np.append(0, np.cumsum(size + 2)), pa.int32())
        return pa.ListArray.from_arrays(ends, pa.array(out, mask=out < 0))
    tok.arrays = arrays
    return tok
