"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from sitelattice.llm import (ann, bestfit, bpe, langid, lexical, linededup, nearjoin, packing, repeats, tokencount, topk,
                             variants, warc)
from sitelattice.llm.common import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under a name, with its SQL if there is one."""
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return wrap


@query("op1_packing")
def op1_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), keep=False)


@query("op2_bpe")
def op2_bpe(spark, sf_dir):
    return bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"),
                             keep=False)


@query("op3_warc", """
WITH own AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
sized AS (SELECT page_id, octet_length(encode(body)) AS payload_bytes, sha1(body) AS payload_digest FROM own),
last AS (SELECT payload_digest, max(page_id) AS response FROM sized WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN response IS NULL OR page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> response THEN response END AS refers_to
FROM sized LEFT JOIN last USING (payload_digest)
""")
def op3_warc(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    # the table has no capture time: one second per id from a fixed day on
    captures = warc.capture_index(pages, F.lit(1704067200) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(10**9)))
    return captures.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op4_language_id")
def op4_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.learn(docs, ~langid.held_out()))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "coverage")


@query("op5_repeats", r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, s, array_to_string(w[s:s + 19], ' ') AS k
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d)),
again AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS r FROM windows)
          WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(s, s + 20)) AS p FROM again)),
word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM d),
kept AS (SELECT word.doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY 1),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN lost USING (doc_id)
""")
def op5_repeats(spark, sf_dir):
    return repeats.remove_repeats(table(spark, sf_dir, "documents"), keep=False)


@query("op6_jaccard_join")
def op6_jaccard_join(spark, sf_dir):
    return nearjoin.jaccard_join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


@query("op7_token_counts")
def op7_token_counts(spark, sf_dir):
    return tokencount.count_tokens(table(spark, sf_dir, "documents"),
                                   public_tokenizers.path("piece_bpe_32k.model"))


@query("op8_line_dedup")
def op8_line_dedup(spark, sf_dir):
    out = linededup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


@query("op9_ann")
def op9_ann(spark, sf_dir):
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


@query("op10_topk", """
WITH own AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
             FROM embeddings
             WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
          FROM own q JOIN own c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
""")
def op10_topk(spark, sf_dir):
    return topk.largest_products(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


@query("op11_lexical_search", r"""
WITH p AS (SELECT '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+' AS re),
low AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS u, 'abcdefghijklmnopqrstuvwxyz' AS l),
d AS (SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all(translate(coalesce(text, ''), u, l), re) AS w FROM documents, p, low),
tot AS (SELECT count(*) AS nd, sum(len(w)) AS nl FROM d WHERE len(w) > 0),
tf AS (SELECT row_id, doc_id, t, CAST(count(*) AS BIGINT) AS tf, any_value(len(w)) AS n
       FROM (SELECT row_id, doc_id, w, unnest(w) AS t FROM d) GROUP BY 1, 2, 3),
q AS (SELECT item_id, t, CAST(count(*) AS BIGINT) AS k
      FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), u, l), re)) AS t FROM benchmark, p, low) GROUP BY 1, 2),
df AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * any_value(nd) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS wt FROM tf, tot GROUP BY t),
scored AS (SELECT item_id, row_id, doc_id,
                  CAST(sum(k * wt * ((1000000000 * tf) // (1000 * tf + 8 * (25 + CAST((75 * n * nd) // nl AS BIGINT))))) AS BIGINT) AS score
           FROM q JOIN tf USING (t) JOIN df USING (t), tot GROUP BY 1, 2, 3),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
""")
def op11_lexical_search(spark, sf_dir):
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op12_spelling_variants")
def op12_spelling_variants(spark, sf_dir):
    return variants.group_variants(table(spark, sf_dir, "documents"))


@query("op13_best_fit")
def op13_best_fit(spark, sf_dir):
    return bestfit.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), keep=False)
