"""The queries of the operators for training data, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import bpe_roundtrip
from .licenses import license_scan
from .near_dedup import near_duplicates
from .packing import pack_documents
from .secret_scan import secret_spans
from .tiff import text_media
from .token_counts import token_counts
from .topk import exact_topk
from .toxicity import ALL_PAIRS, toxicity_scores
from .url_filter import judge_urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk(table(spark, sf_dir, "embeddings"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), pair_discount=ALL_PAIRS)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_roundtrip(table(spark, sf_dir, "documents"))


def op7_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_media(table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=4)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_token_counts, op2_exact_topk, op3_license_scan, op4_secret_scan, op5_toxicity, op6_byte_bpe, op7_tiff_media, op8_url_filter, op9_packing, op10_near_dedup)
    return {q.__name__: q for q in own}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_exact_topk": """
            WITH v AS (
                SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS c
                FROM embeddings
                WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                  AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)), true)
            ), s AS (
                SELECT q.vec_id AS query_id, e.vec_id,
                       CAST(list_sum(list_transform(list_zip(q.c, e.c), lambda p: p[1] * p[2])) AS BIGINT) AS score
                FROM v q JOIN v e ON q.vec_id % 50 = 0 AND e.vec_id <> q.vec_id AND len(q.c) = len(e.c)
            ), r AS (
                SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
            )
            SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
        """,
        # all pairs with a common shingle, and all that links reach: for tables of test size
        "op10_near_dedup": r"""
            WITH RECURSIVE d AS (
                SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
            ), s AS (
                SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                       ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS sh FROM d
            ), e AS (
                SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s
            ), links AS (
                SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id
                GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
            ), both_ways AS (
                SELECT a, b FROM links UNION ALL SELECT b, a FROM links
            ), reach(a, b) AS (
                SELECT doc_id, doc_id FROM s UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a
            ), least AS (
                SELECT a, min(b) AS b FROM reach GROUP BY a
            )
            SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, b AS component_id, doc_id = b AS kept FROM s JOIN least ON doc_id = a
        """,
    }
