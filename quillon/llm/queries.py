"""Queries of the operators on training text, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .cuts import cut_rates, cut_texts
from .encode import encode_corpus
from .knn import similar_queries
from .packing import pack_documents
from .pairs import broken_pairs
from .sentences import task_sentences
from .tokens import corpus_budget, document_tokens


_NEAREST = """
WITH u AS (SELECT query, min(embedding) AS v FROM query_embeddings WHERE query IS NOT NULL AND len(embedding) = 96 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY 1),
s AS (SELECT a.query AS a, b.query AS b FROM u a JOIN u b ON a.query <> b.query QUALIFY row_number() OVER (PARTITION BY a.query ORDER BY list_cosine_similarity(a.v::DOUBLE[], b.v::DOUBLE[]) DESC) <= 5)
SELECT DISTINCT least(a, b) AS query_a, greatest(a, b) AS query_b FROM s
"""


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return task_sentences(table(spark, d, "extraction_tasks"))


def p2_budget(spark: SparkSession, d: str) -> DataFrame:
    return corpus_budget(table(spark, d, "documents"), table(spark, d, "question_generations"), table(spark, d, "guides"))


def p2_documents(spark: SparkSession, d: str) -> DataFrame:
    return document_tokens(table(spark, d, "documents"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return similar_queries(table(spark, d, "query_embeddings"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return broken_pairs(table(spark, d, "question_generations"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(table(spark, d, "documents"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return pack_documents(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return cut_texts(table(spark, d, "documents")).where("cut AND doc_id IS NOT NULL").select("doc_id").distinct()


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    return cut_rates(table(spark, d, "documents")).withColumn("share", F.round("share", 6))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p2_budget, p2_documents, p5_found, p6_found, p7_ids, p8_containers, p9_found, p9_rates)}


def oracle_sql() -> dict[str, str]:
    """That of exact neighbours; no SQL splits, encodes or packs: the tests hold those operators against brute force."""
    return {"p5_found": _NEAREST}
