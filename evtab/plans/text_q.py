"""Queries over the text scalars (whole texts, every row)."""

from __future__ import annotations

from pyspark.sql import functions as F

from evtab.functions import text as T
from evtab.plans import fixtures as fx
from evtab.plans.registry import register

WS = fx.DUCK_WS
DUCK_TOKENS = f"list_filter(string_split_regex({{x}}, '{WS}+'), lambda t: t <> '')"
DUCK_QUOTES = ("replace(replace(replace(replace({x}, '``', '\"'), '''''', '\"'), "
               "'-LRB-', '('), '-RRB-', ')')")
DUCK_STRIP = f"regexp_replace({{x}}, '^{WS}+|{WS}+$', '', 'g')"


def duck_tokens(x: str) -> str:
    return DUCK_TOKENS.replace("{x}", x)


def duck_quotes(x: str) -> str:
    return DUCK_QUOTES.replace("{x}", x)


def duck_strip(x: str) -> str:
    return DUCK_STRIP.replace("{x}", x)


@register("ws_tokens", f"""
SELECT doc_id, CAST(len(tk) AS INTEGER) AS n_tokens, md5(array_to_string(tk, ' ')) AS tokens_md5
FROM (SELECT doc_id, {duck_tokens('text')} AS tk FROM documents)""")
def q_ws_tokens(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents").select("doc_id", T.ws_tokens("text").alias("tk"))
    return d.select("doc_id", F.size("tk").alias("n_tokens"), T.tokens_md5("tk").alias("tokens_md5"))


@register("normalize_quotes", f"""
SELECT doc_id, md5({duck_quotes('text')}) AS text_md5, CAST(length({duck_quotes('text')}) AS INTEGER) AS n_chars
FROM documents""")
def q_normalize_quotes(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents").select("doc_id", T.normalize_quotes("text").alias("t"))
    return d.select("doc_id", F.md5("t").alias("text_md5"), F.length("t").alias("n_chars"))


@register("strip_tags", r"""
SELECT page_id, md5(s) AS text_md5, CAST(length(s) AS INTEGER) AS n_chars
FROM (SELECT page_id, regexp_replace(html, '<[^\n]+?>', '', 'g') AS s FROM pages)""")
def q_strip_tags(spark, sf_dir):
    d = fx.table(spark, sf_dir, "pages").select("page_id", T.strip_tags("html").alias("s"))
    return d.select("page_id", F.md5("s").alias("text_md5"), F.length("s").alias("n_chars"))


@register("strip_header", f"""
SELECT doc_id, md5(s) AS text_md5, CAST(length(s) AS INTEGER) AS n_chars
FROM (SELECT doc_id, {duck_strip("regexp_replace(" + duck_strip('text') + ", '^" + WS + "*DCT[^\\n]*?\\n', '')")} AS s
      FROM documents)""")
def q_strip_header(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents").select("doc_id", T.strip_header("text").alias("s"))
    return d.select("doc_id", F.md5("s").alias("text_md5"), F.length("s").alias("n_chars"))


_MARK = ("concat_ws(' ', " + duck_quotes("before") + ", '[', verb, ']', " + duck_quotes("after") + ")")


@register("mark_target", fx.with_views(f"""
SELECT eventid, CAST(len(tk) AS INTEGER) AS n_tokens, md5(array_to_string(tk, ' ')) AS tokens_md5
FROM (SELECT eventid, {duck_tokens(_MARK)} AS tk FROM samples)""", "samples"))
def q_mark_target(spark, sf_dir):
    s = fx.samples(spark, sf_dir).select("eventid", T.mark_target("before", "verb", "after").alias("tk"))
    return s.select("eventid", F.size("tk").alias("n_tokens"), T.tokens_md5("tk").alias("tokens_md5"))


@register("target_index", fx.with_views(f"""
SELECT eventid, CAST(len({duck_tokens('before')}) AS INTEGER) AS target_idx,
       CAST(len({duck_tokens('before')}) + 1 AS INTEGER) AS target_idx_br
FROM samples""", "samples"))
def q_target_index(spark, sf_dir):
    return fx.samples(spark, sf_dir).select(
        "eventid", T.target_index("before").alias("target_idx"),
        T.target_index("before", brackets=True).alias("target_idx_br"))
