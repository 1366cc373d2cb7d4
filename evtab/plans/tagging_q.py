"""Queries: subword pieces by longest match, tags by a hidden Markov model."""

from __future__ import annotations

from pyspark.sql import functions as F

from evtab.operators import subwords, tagger, tasks
from evtab.operators.features import _local_fallback
from evtab.plans import fixtures as fx
from evtab.plans.registry import register
from evtab.plans.text_q import duck_quotes, duck_tokens
from evtab.session import landed

MAX_LEN, LONGEST, LEAST = 64, 6, 20

_WORDS = duck_tokens("concat_ws(' ', " + duck_quotes("before") + ", '[', verb, ']', " + duck_quotes("after") + ")")
DUCK_PIECES = [f"""rows AS (SELECT docid, eventid, {_WORDS} AS ws, len({duck_tokens('before')}) + 1 AS t FROM samples)""",
               "seen AS (SELECT DISTINCT unnest(ws) AS w FROM rows)",
               "spots AS (SELECT w, unnest(range(1, length(w) + 1)) AS s FROM seen)",
               f"""subs AS (SELECT w, s, n, substr(w, s, n) AS piece
  FROM (SELECT w, s, unnest(range(1, least({LONGEST}, length(w) - s + 1) + 1)) AS n FROM spots) x)""",
               f"""pieces AS (SELECT s = 1 AS first, piece, row_number() OVER (ORDER BY s = 1, piece) AS id
  FROM subs GROUP BY s = 1, piece HAVING count(DISTINCT w) >= {LEAST})""",
               """steps AS (SELECT w, s, max(n) AS n, arg_max(id, n) AS id FROM subs
  JOIN pieces p ON p.piece = subs.piece AND p.first = (subs.s = 1) GROUP BY w, s)""",
               """walk(w, c, ids) AS (
  SELECT w, 1, []::BIGINT[] FROM seen
  UNION ALL SELECT w, c + n, list_append(ids, id) FROM walk JOIN steps USING (w) WHERE s = c)""",
               """cuts AS (SELECT seen.w, coalesce(any_value(ids) FILTER (c = length(seen.w) + 1), [0]) AS ids
  FROM seen JOIN walk USING (w) GROUP BY seen.w)""",
               """words AS (SELECT docid, eventid, t, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i FROM rows)""",
               """placed AS (SELECT docid, eventid, t, i, ids, sum(len(ids)) OVER (
    PARTITION BY docid, eventid ORDER BY i ROWS UNBOUNDED PRECEDING) - len(ids) AS before FROM words JOIN cuts USING (w))""",
               """each AS (SELECT docid, eventid, t, i, before + k AS c, ids[k + 1] AS id
  FROM (SELECT *, unnest(range(len(ids))) AS k FROM placed) x)"""]


@register("subword_pieces", fx.with_views(f"""
SELECT docid, eventid, count(*) AS n_pieces, least(count(*), {MAX_LEN - 2}) + 2 AS n_kept,
       CAST(min(c) FILTER (i = t AND c < {MAX_LEN - 2}) + 1 AS INTEGER) AS first_subword,
       md5(string_agg(CAST(id AS VARCHAR), ' ' ORDER BY c) FILTER (c < {MAX_LEN - 2})) AS pieces_md5
FROM each GROUP BY docid, eventid""", "samples", extra=DUCK_PIECES).replace("WITH ", "WITH RECURSIVE ", 1))
def q_subword_pieces(spark, sf_dir):
    """Model input of every sample in pieces: all counted, the first ones kept, the target's place among them."""
    s = tasks.seq_clf_verbtok(fx.samples(spark, sf_dir).withColumn("label", F.lit(None).cast("int")),
                              include_brackets=True)
    s = landed(s.select("docid", "eventid", "input", "target_token_id"), "inputs", _local_fallback(spark))
    words = s.select(F.explode("input").alias("word")).distinct().checkpoint(eager=True)
    table = subwords.word_pieces(words, subwords.piece_vocabulary(words, "word", LONGEST, LEAST))
    p = subwords.with_pieces(s, table, ["docid", "eventid"], max_len=MAX_LEN)
    inner = F.slice("piece_ids", 2, F.size("piece_ids") - 2)
    return p.select("docid", "eventid", "n_pieces", F.size("piece_ids").cast("long").alias("n_kept"),
                    tasks.first_subword(F.col("word_ids"), F.col("target_token_id")).alias("first_subword"),
                    F.md5(F.array_join(inner.cast("array<string>"), " ")).alias("pieces_md5"))


TAGS = ["AUX", "NOUN", "VERB"]


def _ln(p: str) -> str:
    return f"CAST(floor(ln({p}) * 1000000 + 0.5) AS BIGINT)"


def _duck_best(scores: list[str]) -> tuple[str, str]:
    """Highest of the scores and the number of the first that has it."""
    top = f"greatest({', '.join(scores)})"
    return top, "CASE " + " ".join(f"WHEN {s} = {top} THEN {i}" for i, s in enumerate(scores)) + " END"


_STEP = [_duck_best([f"v.s{i} + m.f{i}{j}" for i in range(3)]) for j in range(3)]
_END = _duck_best(["s0", "s1", "s2"])[1]
DUCK_HMM = [
    "train AS (SELECT *, lag(pos) OVER (PARTITION BY lang, split, docid, sent_pos ORDER BY tok_pos) AS prev "
    "FROM col_rows WHERE split = 'train')",
    "size AS (SELECT count(DISTINCT token) AS v, "
    + ", ".join(f"count_if(pos = '{t}') AS c{i}, count_if(prev IS NULL AND pos = '{t}') + 1.0 AS a{i}, "
                f"count_if(prev = '{t}') + 3.0 AS p{i}" for i, t in enumerate(TAGS)) + ", "
    + ", ".join(f"count_if(prev = '{t}' AND pos = '{u}') + 1.0 AS n{i}{j}"
                for i, t in enumerate(TAGS) for j, u in enumerate(TAGS)) + " FROM train)",
    "m AS (SELECT " + ", ".join(f"{_ln(f'a{i} / (a0 + a1 + a2)')} AS a{i}, {_ln(f'1.0 / (c{i} + v + 1.0)')} AS u{i}"
                                for i in range(3)) + ", "
    + ", ".join(f"{_ln(f'n{i}{j} / p{i}')} AS f{i}{j}" for i in range(3) for j in range(3)) + " FROM size)",
    "emit AS (SELECT token, " + ", ".join(f"{_ln(f'(any_value(k{i}) + 1.0) / (any_value(c{i}) + any_value(v) + 1.0)')} AS e{i}"
                                          for i in range(3))
    + " FROM (SELECT token, " + ", ".join(f"count_if(pos = '{t}') AS k{i}" for i, t in enumerate(TAGS))
    + " FROM train GROUP BY token) x, size GROUP BY token)",
    "test AS (SELECT lang, split, docid, sent_pos, tok_pos, "
    + ", ".join(f"coalesce(e{i}, u{i}) AS e{i}" for i in range(3))
    + " FROM col_rows LEFT JOIN emit USING (token), m WHERE split = 'test')",
    "v(lang, docid, sent_pos, tok_pos, s0, s1, s2, b0, b1, b2) AS (SELECT lang, docid, sent_pos, tok_pos, "
    + ", ".join(f"a{i} + e{i}" for i in range(3)) + ", -1, -1, -1 FROM test, m WHERE tok_pos = 0 "
    "UNION ALL SELECT t.lang, t.docid, t.sent_pos, t.tok_pos, "
    + ", ".join(f"{_STEP[j][0]} + t.e{j}" for j in range(3)) + ", " + ", ".join(_STEP[j][1] for j in range(3))
    + " FROM v JOIN test t ON t.docid = v.docid AND t.sent_pos = v.sent_pos AND t.tok_pos = v.tok_pos + 1, m)",
    "ends AS (SELECT docid, sent_pos, max(tok_pos) AS tok_pos FROM test GROUP BY ALL)",
    f"back(docid, sent_pos, tok_pos, tag) AS (SELECT v.docid, v.sent_pos, v.tok_pos, {_END} FROM v "
    "JOIN ends USING (docid, sent_pos, tok_pos) "
    "UNION ALL SELECT v.docid, v.sent_pos, v.tok_pos - 1, CASE back.tag WHEN 0 THEN b0 WHEN 1 THEN b1 ELSE b2 END "
    "FROM back JOIN v ON v.docid = back.docid AND v.sent_pos = back.sent_pos AND v.tok_pos = back.tok_pos "
    "WHERE v.tok_pos > 0)"]


@register("hmm_tags", fx.with_views(
    f"SELECT docid, sent_pos, tok_pos, {TAGS!r}[tag + 1] AS tag FROM back", "col_rows", extra=DUCK_HMM)
    .replace("WITH ", "WITH RECURSIVE ", 1))
def q_hmm_tags(spark, sf_dir):
    """Tags of the test sentences by a model counted on the training sentences."""
    toks = fx.col_rows(spark, sf_dir)
    model = tagger.fit_tagger(toks.filter(F.col("split") == "train"))
    out = tagger.tag_tokens(toks.filter(F.col("split") == "test"), model, out="tag")
    return out.select("docid", "sent_pos", "tok_pos", "tag")
