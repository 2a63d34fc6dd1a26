"""One query for each operator, over its whole table with production parameters, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dialogue, html, language, maxscore, media, mixing, oddsketch, pieces, pii, quality, runs, sharding, simhash
from .common import table

#: SentencePiece model file of the queries; the operator takes any path.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = maxscore.quantised(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return maxscore.search(vectors.where("id % 100 = 0"), vectors, 10)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shuffled(table(spark, sf_dir, "documents"), shards=40)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(table(spark, sf_dir, "documents"))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_checked(table(spark, sf_dir, "documents"), MODEL)


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digest(runs.periodic(runs.repeated_tail(table(spark, sf_dir, "documents"))))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oddsketch.near_duplicates(table(spark, sf_dir, "documents"))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.report_damaged(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_html_extraction, op2_pii, op3_mixing, op4_topk, op5_sharding, op6_simhash, op7_quality, op8_media, op9_langid, op10_sentencepiece, op11_runs, op12_minhash, op13_conversations)}

TOPK_SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS q
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda p: coalesce(p[1] * p[2], 0)))::BIGINT AS score
    FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
)
SELECT query_id, rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
WHERE rank <= 10
"""

#: Texts with equal sets are one node of the links; components by the least node that chains reach.
MINHASH_SQL = r"""
WITH RECURSIVE w AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
    FROM documents
), s AS (
    SELECT r, doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
        ELSE list_sort(list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')))) END AS shingles
    FROM w
), t AS (
    SELECT min(r) AS node, min(doc_id) AS least, shingles, len(shingles) AS n FROM s WHERE len(shingles) > 0 GROUP BY shingles
), x AS (
    SELECT node, n, unnest(shingles) AS shingle FROM t
), e AS (
    SELECT a.node AS u, b.node AS v FROM x a JOIN x b ON a.shingle = b.shingle AND a.node <> b.node AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
    GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach(u, v) AS (
    SELECT node, node FROM t UNION SELECT reach.u, e.v FROM reach JOIN e ON reach.v = e.u
), c AS (
    SELECT reach.u AS node, min(t.least) AS component_id FROM reach JOIN t ON t.node = reach.v GROUP BY reach.u
)
SELECT s.doc_id, len(s.shingles)::BIGINT AS n_shingles, CASE WHEN len(s.shingles) = 0 THEN s.doc_id ELSE c.component_id END AS component_id,
    coalesce(s.doc_id = CASE WHEN len(s.shingles) = 0 THEN s.doc_id ELSE c.component_id END, false) AS kept
FROM s LEFT JOIN t ON t.shingles = s.shingles LEFT JOIN c ON c.node = t.node
"""

ORACLE_SQL: dict[str, str] = {"op3_mixing": mixing.oracle_sql(), "op4_topk": TOPK_SQL, "op12_minhash": MINHASH_SQL}
