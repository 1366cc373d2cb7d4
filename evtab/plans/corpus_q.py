"""Queries over column-format corpora: parsing, annotation, event contexts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evtab.operators import corpus
from evtab.plans import fixtures as fx
from evtab.plans.registry import register
from evtab.sources.corpus import parse_col

# Made-up lexicon rules for the fixtures (the reference uses a trained tagger).
DUCK_POS = ("CASE WHEN substring(md5({t}), 1, 1) IN ('0', '1', '2', '3') THEN 'VERB' "
            "WHEN substring(md5({t}), 1, 1) = '4' THEN 'AUX' ELSE 'NOUN' END")


def pos_rule(t: Column) -> Column:
    h = F.substring(F.md5(t), 1, 1)
    return F.when(h.isin("0", "1", "2", "3"), "VERB").when(h == "4", "AUX").otherwise("NOUN")


def morph_rule(h: Column) -> Column:
    """Made-up morphology map from the token's md5 hex ``h`` (computed once)."""
    def ch(i):
        return F.substring(h, i, 1)
    entries = F.array(
        F.struct(F.lit("Tense").alias("k"), F.when(ch(2) <= "5", "Pres").when(ch(2) <= "9", "Past,Imp").alias("v")),
        F.struct(F.lit("Mood").alias("k"), F.when(ch(3) <= "7", "Ind").alias("v")),
        F.struct(F.lit("Number").alias("k"), F.when(ch(4).isin("0", "2", "4", "6", "8"), "Sing")
                 .when(ch(4).isin("1", "3", "5", "7", "9"), "Plur").alias("v")),
        F.struct(F.lit("Person").alias("k"), F.when(ch(5).isin("1", "2", "3"), ch(5)).alias("v")),
        F.struct(F.lit("VerbForm").alias("k"), F.when(ch(6) >= "a", "Fin").otherwise("Part").alias("v")))
    return F.map_from_entries(F.filter(entries, lambda e: e["v"].isNotNull()))


def pos_from_hash(h: Column) -> Column:
    c = F.substring(h, 1, 1)
    return F.when(c.isin("0", "1", "2", "3"), "VERB").when(c == "4", "AUX").otherwise("NOUN")


DUCK_MORPH = """
  CASE WHEN substring(md5(token), 2, 1) <= '5' THEN 'Pres' WHEN substring(md5(token), 2, 1) <= '9' THEN 'Past' ELSE '' END AS Tense,
  CASE WHEN substring(md5(token), 3, 1) <= '7' THEN 'Ind' ELSE '' END AS Mood,
  CASE WHEN substring(md5(token), 4, 1) IN ('0', '2', '4', '6', '8') THEN 'Sing'
       WHEN substring(md5(token), 4, 1) IN ('1', '3', '5', '7', '9') THEN 'Plur' ELSE '' END AS Number,
  CASE WHEN substring(md5(token), 5, 1) IN ('1', '2', '3') THEN substring(md5(token), 5, 1) ELSE '' END AS Person,
  CASE WHEN substring(md5(token), 6, 1) >= 'a' THEN 'Fin' ELSE 'Part' END AS VerbForm"""


def lexicon(spark, sf_dir):
    """(lang, token) -> pos, morph, built from the training tokens."""
    toks = fx.col_rows(spark, sf_dir).filter(F.col("split") == "train").select("lang", "token").distinct()
    h = toks.withColumn("_h", F.md5("token"))
    return h.select("lang", "token", pos_from_hash(F.col("_h")).alias("pos"), morph_rule(F.col("_h")).alias("morph"))


@register("parse_col", fx.with_views("""
SELECT docid, lang, CAST(sent_pos AS VARCHAR) AS sentid, CAST(tok_pos + 1 AS VARCHAR) AS tokenid,
       token, CASE WHEN eventid = '' THEN 'O' ELSE eventid END AS eventid, tok_pos FROM col_rows""", "col_rows"))
def q_parse_col(spark, sf_dir):
    rows = parse_col(fx.col_files(spark, sf_dir))
    return rows.select("docid", "lang", "sentid", "tokenid", "token", "eventid", "tok_pos")


@register("annotate_tokens", fx.with_views("""
SELECT c.docid, c.sent_pos, c.tok_pos, coalesce(l.pos, 'X') AS pos
FROM col_rows c LEFT JOIN (SELECT DISTINCT lang, token, pos FROM col_rows WHERE split = 'train') l
  ON c.lang = l.lang AND c.token = l.token""", "col_rows"))
def q_annotate_tokens(spark, sf_dir):
    toks = fx.col_rows(spark, sf_dir).drop("pos")
    out = corpus.annotate_lexicon(toks, lexicon(spark, sf_dir).drop("morph"))
    return out.select("docid", "sent_pos", "tok_pos", "pos")


@register("morph_tags", fx.with_views(f"""
SELECT c.docid, c.sent_pos, c.tok_pos, {DUCK_MORPH}
FROM col_rows c WHERE c.eventid LIKE 'e%'""", "col_rows"))
def q_morph_tags(spark, sf_dir):
    toks = fx.col_rows(spark, sf_dir).filter(F.col("eventid").startswith("e")).drop("pos")
    lex = fx.col_rows(spark, sf_dir).filter(F.col("eventid").startswith("e")).select("lang", "token").distinct()
    lex = lex.withColumn("_h", F.md5("token"))
    lex = lex.select("lang", "token", pos_from_hash(F.col("_h")).alias("pos"), morph_rule(F.col("_h")).alias("morph"))
    out = corpus.morph_tags(corpus.annotate_lexicon(toks, lex))
    return out.select("docid", "sent_pos", "tok_pos", *corpus.MORPH_TAGS)


DUCK_CONTEXTS = """contexts AS (
SELECT c.lang, c.split, c.docid, c.sent_pos, c.tok_pos, c.eventid, c.token AS verb, c.pos,
  array_to_string(s.toks[1:c.tok_pos], ' ') AS before, array_to_string(s.toks[c.tok_pos + 2:], ' ') AS after
FROM col_rows c JOIN (SELECT lang, split, docid, sent_pos, list(token ORDER BY tok_pos) AS toks
                      FROM col_rows GROUP BY ALL) s USING (lang, split, docid, sent_pos)
WHERE c.eventid LIKE 'e%' AND c.pos IN ('VERB', 'AUX'))"""


def contexts(spark, sf_dir):
    return corpus.event_contexts(fx.col_rows(spark, sf_dir))


@register("event_contexts", fx.with_views(
    "SELECT lang, split, docid, sent_pos, tok_pos, eventid, verb, pos, before, after FROM contexts",
    "col_rows", extra=[DUCK_CONTEXTS]))
def q_event_contexts(spark, sf_dir):
    return contexts(spark, sf_dir).select("lang", "split", "docid", "sent_pos", "tok_pos", "eventid",
                                          "verb", "pos", "before", "after")


@register("first_mention", fx.with_views("""
SELECT lang, split, docid, eventid, sent_pos, tok_pos, verb FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, split, docid, eventid ORDER BY sent_pos, tok_pos) AS rn
  FROM contexts) x WHERE rn = 1""", "col_rows", extra=[DUCK_CONTEXTS]))
def q_first_mention(spark, sf_dir):
    names = ["lang", "split", "docid", "eventid", "sent_pos", "tok_pos", "verb"]
    return corpus.first_mention(contexts(spark, sf_dir).select(*names)).select(*names)   # no text sides in its rows
