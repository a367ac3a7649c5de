"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import centroids, codebooks, mixing
from .shared import table

#: op7_topk in DuckDB's SQL.
TOP_K = """
WITH whole AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM whole q, whole c WHERE q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 10
"""


def op1_mpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mpeg import media_features

    return media_features(table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import capture_table

    return capture_table(table(spark, sf_dir, "pages"))


def op3_rans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rans import token_table

    return token_table(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .kneser_ney import judge

    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("print")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract

    return extract(table(spark, sf_dir, "pages"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.expr("vec_id % 100 = 0"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licences import scan_documents

    return scan_documents(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clusters(table(spark, sf_dir, "embeddings")).drop("n_exact")


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_trie import score_texts

    return score_texts(table(spark, sf_dir, "documents"), order=3)


def op13_codebooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codebooks.codes(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mpeg": op1_mpeg,
    "op2_warc": op2_warc,
    "op3_rans": op3_rans,
    "op4_quality": op4_quality,
    "op5_bpe": op5_bpe,
    "op6_html": op6_html,
    "op7_topk": op7_topk,
    "op8_simhash": op8_simhash,
    "op9_licences": op9_licences,
    "op10_mixing": op10_mixing,
    "op11_centroids": op11_centroids,
    "op12_trie": op12_trie,
    "op13_codebooks": op13_codebooks,
}

ORACLES: dict[str, str] = {
    "op7_topk": TOP_K,
    "op10_mixing": mixing.ORACLE,
    "op11_centroids": centroids.ORACLE,
    "op13_codebooks": codebooks.ORACLE,
}
