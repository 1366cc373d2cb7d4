"""Column-format corpora: ``<root>/<corpus>/<split>/<docid>.col`` files.

A file is an optional ``DCT...`` first line, then sentences separated by a
blank line, one token per line, tab-separated cells. Parsing is built-in
string/array functions; only byte decoding with dropped bad bytes needs
Python (``bytes.decode(errors='ignore')`` has no JVM equivalent).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from evtab.functions.text import py_strip, strip_header

# ---- fixed values ------------------------------------------------------------
# Cell layout per language: 'full' = token, token id, sentence id, event id;
# 'shrinked' = sentence id, token id, token, event id.
LAYOUTS = {"it": "full", "fr": "full", "es": "shrinked"}
# 0-based cell index of (token, token id, sentence id, event id) per layout.
LAYOUT_CELLS = {"full": (0, 1, 2, 3), "shrinked": (2, 1, 0, 3)}
# ------------------------------------------------------------------------------


@F.pandas_udf(StringType())
def decode_lenient(content: pd.Series) -> pd.Series:
    """UTF-8 decode that drops undecodable bytes (Python ``errors='ignore'``)."""
    return content.map(lambda b: None if b is None else bytes(b).decode("utf-8", "ignore"))


def universal_newlines(c: Column) -> Column:
    """Text-mode reading: CRLF and lone CR become LF."""
    return F.regexp_replace(c, "\r\n?", "\n")


def read_col_corpus(spark: SparkSession, root: str, corpus_langs: dict[str, str] | None = None) -> DataFrame:
    """One row per ``*.col`` file: corpus, lang, split, docid, text.

    ``docid`` is the file name without its last extension; other extensions
    are skipped; only ``<root>/<corpus>/<split>/`` is read (not recursive).
    """
    raw = (spark.read.format("binaryFile").option("pathGlobFilter", "*.col")
           .load(f"{root.rstrip('/')}/*/*"))
    pat = r"([^/]+)/([^/]+)/([^/]+)\.[^./]*$"
    out = raw.select(
        F.regexp_extract("path", pat, 1).alias("corpus"),
        F.regexp_extract("path", pat, 2).alias("split"),
        F.regexp_extract("path", pat, 3).alias("docid"),
        universal_newlines(decode_lenient("content")).alias("text"))
    if corpus_langs:
        m = F.create_map(*[F.lit(x) for kv in corpus_langs.items() for x in kv])
        out = out.withColumn("lang", F.element_at(m, F.col("corpus")))
    return out


def layout_of(lang: Column, layouts: dict[str, str] = LAYOUTS, default: str = "full") -> Column:
    m = F.create_map(*[F.lit(x) for kv in layouts.items() for x in kv])
    return F.coalesce(F.element_at(m, lang), F.lit(default))


def _cell(cells: Column, layout: Column, which: int) -> Column:
    full, shr = LAYOUT_CELLS["full"][which], LAYOUT_CELLS["shrinked"][which]
    return F.when(layout == "shrinked", F.get(cells, shr)).otherwise(F.get(cells, full))


def cells_of(line: Column, layout: Column) -> dict[str, Column]:
    """The cells of a token line by name."""
    cells = F.split(line, "\t")
    raw = _cell(cells, layout, 0)
    return {"token": py_strip(raw), "raw_token": raw, "tokenid": _cell(cells, layout, 1),
            "sentid": _cell(cells, layout, 2), "eventid": _cell(cells, layout, 3)}


def parse_col(df: DataFrame, text: str = "text", lang: str = "lang",
              layouts: dict[str, str] = LAYOUTS, keep: tuple[str, ...] = ("docid", "lang", "split")) -> DataFrame:
    """File text -> one row per token line:
    (keep..., sent_pos, tok_pos, token, raw_token, tokenid, sentid, eventid)."""
    keep = [c for c in keep if c in df.columns]
    body = strip_header(F.col(text))
    s = df.select(*keep, F.posexplode(F.split(body, "\n\n")).alias("sent_pos", "sent"),
                  layout_of(F.col(lang), layouts).alias("_layout"))
    t = s.select(*keep, "_layout", F.col("sent_pos").cast("int").alias("sent_pos"),
                 F.posexplode(F.split("sent", "\n")).alias("tok_pos", "line")).filter(F.col("line") != "")
    cells = cells_of(F.col("line"), F.col("_layout"))
    return t.select(*keep, "sent_pos", F.col("tok_pos").cast("int").alias("tok_pos"),
                    *[c.alias(n) for n, c in cells.items()])
