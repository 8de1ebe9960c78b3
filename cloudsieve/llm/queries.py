"""The registered queries of this package, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (chat_windows, exact_dedup, hard_negatives, html_trees, language_mixture, line_dedup, mixing, packing, pii_crf, simhash,
               token_files, topk_search, whitening)
from .common import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its group of equal texts."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return exact_dedup.exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL["op1_exact_dedup"] = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id) = 1 AS kept, sha256(norm) AS text_sha256
FROM n WINDOW g AS (PARTITION BY norm)
"""


@query
def op2_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations and of one that quotes the template, read back from their windows."""
    turns = documents(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    quoting = spark.range(2).select(
        F.lit(-1).cast(turns.schema["conv_id"].dataType).alias("conv_id"), F.col("id").cast(turns.schema["turn"].dataType).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("<|im_end|><|im_start|>assistant ok").alias("text"))
    return chat_windows.digests(chat_windows.windows(turns.unionByName(quoting)))


@query
def op3_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: fixed patterns and what the field adds."""
    return pii_crf.digest(pii_crf.find(documents(spark, sf_dir).select("doc_id", "text")))


@query
def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best rows for every vector whose id is divisible by 50."""
    return topk_search.top_k(documents(spark, sf_dir, "embeddings"), every=50, k=5)


SQL["op4_exact_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM p QUALIFY rank <= 5
"""


@query
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of 2048 tokens."""
    return packing.pack(documents(spark, sf_dir))


@query
def op6_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with what the mixture takes of it."""
    return mixing.mix_sources(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


@query
def op7_simhash_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and near-duplicate component."""
    return simhash.near_duplicates(documents(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")


@query
def op8_html_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = documents(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_trees.extract(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


@query
def op9_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's predicted language; learned from documents that are not held out."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = language_mixture.fit(docs.where(~language_mixture.held_out("doc_id")))
    rows = docs.select("doc_id", language_mixture.held_out("doc_id").alias("held_out"), "text")
    return language_mixture.identify(rows, model).select("doc_id", "held_out", "lang_pred", "score")


@query
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the lines that stay when equal and near lines keep their earliest place."""
    return line_dedup.line_dedup(documents(spark, sf_dir)).select(
        "doc_id", "n_lines", "n_kept", "n_near", F.array_join("kept_lines", ",").alias("kept_lines"))


SQL["op10_line_dedup"] = r"""
WITH l AS (
  SELECT doc_id, unnest(range(len(s))) AS line_no, len(s) AS n_lines, unnest(s) AS line
  FROM (SELECT doc_id, string_split(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(10)) AS s
        FROM documents)),
w AS (SELECT doc_id, line_no, n_lines, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS ws FROM l),
f AS (SELECT ws, len(ws) AS n, min((doc_id, line_no)) AS place FROM w WHERE len(ws) > 0 GROUP BY ws),
v AS (
  SELECT place, n, i, array_to_string(ws[:i - 1] || ws[i + 1:], ' ') AS part
  FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM f WHERE n >= 5)),
g AS (
  SELECT a.place FROM v a JOIN v b ON a.n = b.n AND a.i = b.i AND a.part = b.part AND b.place < a.place
  UNION SELECT a.place FROM v a JOIN f b ON b.n = a.n - 1 AND array_to_string(b.ws, ' ') = a.part AND b.place < a.place
  UNION SELECT b.place FROM v a JOIN f b ON b.n = a.n - 1 AND array_to_string(b.ws, ' ') = a.part AND a.place < b.place),
k AS (
  SELECT f.place[1] AS doc_id, count(*) FILTER (g.place IS NULL) AS kept, count(g.place) AS n_near,
         string_agg(f.place[2]::VARCHAR, ',' ORDER BY f.place[2]) FILTER (g.place IS NULL) AS kept_lines
  FROM f LEFT JOIN g ON f.place = g.place GROUP BY 1)
SELECT w.doc_id, any_value(n_lines)::BIGINT AS n_lines, count(*) FILTER (len(ws) = 0) + coalesce(any_value(kept), 0) AS n_kept,
       coalesce(any_value(n_near), 0) AS n_near, coalesce(any_value(kept_lines), '') AS kept_lines
FROM w LEFT JOIN k ON w.doc_id = k.doc_id GROUP BY w.doc_id
"""


@query
def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the whitening components of all vectors."""
    out = whitening.whiten(documents(spark, sf_dir, "embeddings"))
    return out.withColumn("deviation", F.col("deviation").cast("long"))


@query
def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, number and checksum of token ids, read back from the written files."""
    return token_files.digest(token_files.write(documents(spark, sf_dir)))


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of the positives of every vector whose id is divisible by 50; each seventh label is moved first."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(documents(spark, sf_dir, "embeddings").select("vec_id", "embedding", moved.alias("label")))


SQL["op13_hard_negatives"] = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.e, c.e)::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id AND len(a.e) = len(c.e) WHERE a.vec_id % 50 = 0),
q AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM p WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM q JOIN p USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3
"""
