"""The registered queries of the corpus operators, one per operator."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evtab.llm import (alignment, bpe, htmltext, language, mixing, neardup, recompression, shards, spelling, topk,
                       toxicity, vecdup, warc)
from evtab.llm.registry import register
from evtab.llm.util import table

VOCABULARY = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


@register("op1_language")
def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the documents outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    out = language.held_out(F.col("doc_id"), 4, 2)
    dictionaries = language.learn(docs.where(~out))
    return language.predict(docs.select("doc_id", "text"), dictionaries) \
        .select("doc_id", out.alias("held_out"), "lang_pred", "score", "rejected")


@register("op2_htmltext")
def op2_htmltext(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return htmltext.extract(table(spark, sf_dir, "pages"))


@register("op3_neardup")
def op3_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class, component and kept document of all documents: five-word shingles, similarity 0.8."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


@register("op4_toxicity")
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels outside the held-out fold."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = language.held_out(F.col("doc_id"), 5, 0)
    weights = toxicity.train(toxicity.sample(docs, labels.where(~out)))
    return toxicity.score(docs.select("doc_id", "text"), weights) \
        .select("doc_id", out.alias("held_out"), "score", "predicted")


@register("op5_topk", oracle="""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT a.vec_id AS query_id, b.vec_id,
                  list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i]))::BIGINT AS score
           FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
     r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5""")
def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best other rows of every embedding whose id is divisible by 50."""
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@register("op8_vecdup", oracle="""
WITH RECURSIVE
  v AS (SELECT vec_id, CASE WHEN embedding IS NOT NULL
                 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
               THEN list_transform(embedding, lambda x: x::DOUBLE) END AS e FROM embeddings),
  l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
        WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
  r(id, low) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.id, l.b FROM r JOIN l ON r.low = l.a),
  c AS (SELECT id, min(low) AS component_id FROM r GROUP BY id),
  n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT c.id AS vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id, c.id = component_id AS kept
FROM c LEFT JOIN n ON n.a = c.id""")
def op8_vecdup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, components and kept vectors of all embeddings at cosine 0.9."""
    return vecdup.near_duplicates(table(spark, sf_dir, "embeddings"))


@register("op6_shards")
def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document; equal texts together, row counts at most one apart."""
    placed = shards.balanced_shards(table(spark, sf_dir, "documents"), 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


@register("op7_mixing")
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words the mix takes from every document, and the output shards of its drawn blocks."""
    documents, blocks = mixing.mix(table(spark, sf_dir, "documents"))
    return mixing.with_shards(documents, blocks).select("doc_id", "size", "source_size", "target", "taken", "shards")


BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


@register("op9_warc", oracle=f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
     d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS h,
                  min(page_id) OVER (PARTITION BY sha1(b)) AS first FROM p),
     w AS (SELECT *, list_transform(range(0, 8), lambda i: ('0x' || substr(h, 1 + 5 * i, 5))::BIGINT) AS v FROM d)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(v, lambda x:
           substr('{BASE32}', 1 + ((x >> 15) & 31)::INT, 1) || substr('{BASE32}', 1 + ((x >> 10) & 31)::INT, 1) ||
           substr('{BASE32}', 1 + ((x >> 5) & 31)::INT, 1) || substr('{BASE32}', 1 + (x & 31)::INT, 1)),
           'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM w""")
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written to Zstandard WARC archives and read back."""
    rows = warc.archive_round_trip(table(spark, sf_dir, "pages"))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@register("op10_bpe")
def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every document."""
    docs = table(spark, sf_dir, "documents")
    return bpe.encode_decode(docs, public_tokenizers.path(VOCABULARY), keep=["doc_id"], ids=False)


#: CRC-32 as a table: what byte ``b`` adds when ``d`` bytes follow it (``z``), and what a text of ``n`` zero bytes gives
#: (``a``). The CRC of a text is the xor of its bytes' shares and of ``a`` at its length.
DUCK_CRC32 = """
  longest AS (SELECT max(length(m)) * 2 + 1 AS n FROM said),
  bits(b, v, k) AS (SELECT b, b, 0 FROM range(256) t(b)
                    UNION ALL SELECT b, CASE WHEN v & 1 = 1 THEN xor(3988292384, v >> 1) ELSE v >> 1 END, k + 1
                    FROM bits WHERE k < 8),
  t AS (SELECT b, v FROM bits WHERE k = 8),
  z(d, b, v) AS (SELECT 0, b, v FROM t
                 UNION ALL SELECT d + 1, z.b, xor(t.v, z.v >> 8) FROM z JOIN t ON t.b = z.v & 255, longest
                 WHERE d + 1 < longest.n),
  s(n, v) AS (SELECT 0, 4294967295
              UNION ALL SELECT s.n + 1, xor(t.v, s.v >> 8) FROM s JOIN t ON t.b = s.v & 255, longest
              WHERE s.n < longest.n),
  a AS (SELECT n, xor(v, 4294967295) AS v FROM s),
  spelt AS (SELECT m, hex(encode(m)) AS x FROM (SELECT DISTINCT m FROM said) y),
  shares AS (SELECT m, length(x) // 2 AS n, unnest(range(length(x) // 2)) AS j, x FROM spelt),
  crc AS (SELECT m, xor(bit_xor(z.v), any_value(a.v)) AS h
          FROM shares q JOIN z ON z.d = q.n - 1 - q.j AND z.b = ('0x' || substr(q.x, 1 + 2 * q.j, 2))::BIGINT
               JOIN a ON a.n = q.n GROUP BY m)"""


@register("op11_spelling", oracle=f"""
WITH RECURSIVE
  runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')) AS r FROM documents),
  said AS (SELECT w, coalesce(doc_id::VARCHAR, '') || ':' || w AS m, count(*) AS n
           FROM (SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM runs) x
           WHERE length(w) >= 6 GROUP BY ALL),
  {DUCK_CRC32.strip()},
  written AS (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2)
                          ELSE w END AS word, n FROM said JOIN crc USING (m)),
  vocab AS (SELECT word, sum(n)::BIGINT AS n FROM written GROUP BY word HAVING length(word) >= 6 AND sum(n) >= 5),
  places AS (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM vocab),
  holes AS (SELECT word, substr(word, 1, i - 1) || '?' || substr(word, i + 1) AS hole,
                   substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM places),
  pairs AS (SELECT x.word AS a, y.word AS b FROM holes x JOIN holes y ON x.hole = y.hole AND x.word <> y.word
            UNION SELECT h.word, v.word FROM holes h JOIN vocab v ON v.word = h.less
            UNION SELECT v.word, h.word FROM holes h JOIN vocab v ON v.word = h.less),
  near AS (SELECT a AS word, b, v.n AS m, count(*) OVER (PARTITION BY a) AS n_near,
                  row_number() OVER (PARTITION BY a ORDER BY v.n DESC, b) AS k FROM pairs JOIN vocab v ON v.word = b),
  given AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * v.n THEN b END AS form,
                   CASE WHEN m >= 5 * v.n THEN m END AS form_n
            FROM vocab v LEFT JOIN near ON near.word = v.word AND k = 1),
  chain(word, root) AS (SELECT word, word FROM vocab
                        UNION ALL SELECT chain.word, g.form FROM chain JOIN given g ON g.word = chain.root
                        WHERE g.form IS NOT NULL)
SELECT g.word, g.form, c.root, g.n, g.n_near, g.form_n
FROM given g JOIN chain c USING (word) JOIN given e ON e.word = c.root AND e.form IS NULL""")
def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, their most frequent near word and the end of that chain."""
    return spelling.variant_groups(table(spark, sf_dir, "documents"))


@register("op12_alignment")
def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of two tokenizers over every document."""
    return alignment.align_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY),
                                     public_tokenizers.path(PIECES))


@register("op13_substrings", oracle=r"""
WITH w AS (SELECT row_number() OVER () AS rid, doc_id,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
     words AS (SELECT rid, doc_id, len(ws) AS n, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
     wins AS (SELECT rid, doc_id, i, n, string_agg(word, ' ') OVER (
                PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING) AS k FROM words),
     whole AS (SELECT * FROM wins WHERE i <= n - 49 AND doc_id IS NOT NULL),
     firsts AS (SELECT k, min(doc_id) AS lo FROM whole GROUP BY k),
     hits AS (SELECT rid, i FROM whole JOIN firsts USING (k) WHERE lo < doc_id),
     marked AS (SELECT rid, i, word, max(CASE WHEN h.i IS NULL THEN 0 ELSE 1 END) OVER (
                  PARTITION BY rid ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone
                FROM words LEFT JOIN hits h USING (rid, i)),
     cut AS (SELECT rid, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS kept
             FROM marked GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN cut USING (rid)""")
def op13_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the 50-word passages that a document of smaller id holds."""
    return recompression.remove_repeats(table(spark, sf_dir, "documents"))
