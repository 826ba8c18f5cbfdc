"""The queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import nearest
from .chat import chat_digests, format_chat
from .common import learns, table
from .decompose import decompose_documents
from .divergence import source_divergence
from .exact_dedup import find_exact_duplicates
from .line_dedup import drop_repeated_lines
from .lloyd import cluster_vectors
from .mixing import mix_report
from .packing import pack_documents
from .quality import score_quality
from .simhash import simhash_components
from .toxicity import fit_toxicity, score_toxicity
from .warc import archive_pages

#: A conversation whose texts hold control strings of chat templates.
HARD_TEXT = r"\### Assistant: </turn> ok"


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_exact_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(HARD_TEXT).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    return chat_digests(format_chat(rows.unionByName(hard)))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"), folds=5, held_out=0)
    return score_toxicity(docs, model).select("doc_id", (~learns(F.col("doc_id"), 5, 0)).alias("held_out"), "score", "predicted")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_quality(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"), folds=3, held_out=1)
    return scored.select("doc_id", (~learns(F.col("doc_id"), 3, 1)).alias("held_out"), "score", "predicted")


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("id") % 20 == 0, k=20)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return clean.select("doc_id", "n_lines", "removed_lines", F.length("clean_text").cast("long").alias("clean_chars"), F.sha2(F.col("clean_text").cast("binary"), 256).alias("clean_sha256"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=3, most=3)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), length=1024, end=2)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(spark, table(spark, sf_dir, "pages").select("page_id", "url", "html"), stored=True).drop("payload")


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), k=8, rounds=10)


def op12_binary_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decompose_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), length=2048, end=1)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents").select("lang", "source", "text"), least_docs=3, most_terms=200).drop("p", "q")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_exact_dedup, op2_mixing, op3_chat_format, op4_toxicity, op5_quality, op6_nearest, op7_line_dedup, op8_simhash, op9_packing, op10_warc, op11_centroids, op12_binary_packing, op13_source_divergence]
    return {f.__name__: f for f in found}


ORACLE = {
    "op1_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)""",
    "op3_chat_format": r"""
WITH rows AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
coded AS (
  SELECT *, length(text) + length(text) - length(replace(replace(replace(text, '\', ''), '<', ''), '#', '')) AS chars,
         length(role) + length(role) - length(replace(replace(replace(replace(role, '\', ''), '<', ''), '#', ''), ':', '')) AS role_chars,
         role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS same
  FROM rows)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars + CASE WHEN same THEN 7 ELSE 6 + role_chars + 8 END) AS BIGINT) AS formatted_chars
FROM coded GROUP BY conv_id""",
    "op7_line_dedup": r"""
WITH raw AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS idx
  FROM documents),
lines AS (
  SELECT doc_id, idx, regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '') AS line FROM raw),
full_lines AS (
  SELECT doc_id, idx, line, row_number() OVER (PARTITION BY doc_id ORDER BY idx) - 1 AS pos FROM lines WHERE line <> ''),
windows AS (
  SELECT doc_id, pos, line AS a, lead(line) OVER w AS b, lead(line, 2) OVER w AS c FROM full_lines WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
ranked AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) AS k FROM windows WHERE c IS NOT NULL),
dead AS (
  SELECT DISTINCT doc_id, pos + i AS pos FROM ranked, (VALUES (0), (1), (2)) AS o(i) WHERE k > 1),
marked AS (
  SELECT f.doc_id, f.idx, d.pos IS NOT NULL AS gone FROM full_lines f LEFT JOIN dead d ON f.doc_id = d.doc_id AND f.pos = d.pos),
clean AS (
  SELECT r.doc_id, string_agg(r.line, chr(10) ORDER BY r.idx) FILTER (WHERE NOT coalesce(m.gone, FALSE)) AS clean_text,
         count(m.idx) AS n_lines, count(*) FILTER (WHERE m.gone) AS removed_lines
  FROM raw r LEFT JOIN marked m ON r.doc_id = m.doc_id AND r.idx = m.idx GROUP BY r.doc_id)
SELECT doc_id, n_lines, removed_lines, length(coalesce(clean_text, '')) AS clean_chars, sha256(coalesce(clean_text, '')) AS clean_sha256 FROM clean""",
    "op10_warc": r"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
k AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS keeper FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> keeper THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> keeper THEN keeper END AS refers_to
FROM k""",
    "op13_source_divergence": r"""
WITH d AS (
  SELECT row_number() OVER () AS row_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
t AS (SELECT row_id, lang, source, unnest(terms) AS term FROM d),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM t GROUP BY ALL),
v AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT row_id) >= 3),
k AS (SELECT c.* FROM c JOIN v USING (lang, term)),
size AS (SELECT lang, count(*)::HUGEINT AS V FROM v GROUP BY lang),
g AS (
  SELECT lang, source, coalesce(any_value(V), 0) AS V, coalesce(sum(k.n), 0)::HUGEINT AS N
  FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN k USING (lang, source) LEFT JOIN size USING (lang) GROUP BY lang, source),
dense AS (
  SELECT g.lang, g.source, v.term, coalesce(k.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(k.n, 0) + 1)) // (g.N + g.V) AS p
  FROM g JOIN v ON g.lang = v.lang LEFT JOIN k ON k.lang = g.lang AND k.source = g.source AND k.term = v.term),
whole AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n)::HUGEINT + 1)) // (any_value(total) + any_value(V)) AS q
  FROM k JOIN (SELECT lang, sum(N)::HUGEINT AS total, any_value(V) AS V FROM g GROUP BY lang) USING (lang) GROUP BY lang, term),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (
  SELECT dense.lang, dense.source, 'term' AS part, dense.term AS item, ((p - q) * (p - q)) // q AS value
  FROM dense JOIN whole ON dense.lang = whole.lang AND dense.term = whole.term WHERE n > 0 AND p > q),
every AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM every WHERE part = 'pair' OR rank <= 200""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
