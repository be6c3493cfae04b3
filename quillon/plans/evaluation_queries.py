"""Evaluation frames over the tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ranking import with_average_rank, with_min_max
from ..operators import evaluation as E
from ..operators.citations import CITATION
from ..operators.embedding import FakeEmbedder, embed_missing
from ..operators.extraction import LinkProvider, extract_citations
from ..operators.retrieval import ndcg, precision, recall, reciprocal_rank
from ..session import table

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""
SELECT 'doc_' || d || '_query_' || q || '_' || m || '_' || t AS name, d AS doc_embed, q AS query_embed, m AS model, t AS translation, CASE WHEN q = 'base' THEN 'query_echr_retrieve' ELSE 'query_translation_echr_retrieve' END AS retrieval_language
FROM (VALUES ('base'), ('instruct')) a(d), (VALUES ('base'), ('translation_echr_retrieve')) b(q), (VALUES ('flash'), ('llama'), ('k2')) c(m), (VALUES ('pre'), ('post'), ('none')) e(t)
""")
def run_registry(spark: SparkSession, d: str) -> DataFrame:
    return E.registry(spark)


_GOLD = """
WITH r AS (SELECT DISTINCT guide_id, paragraph_id, citations FROM citation_extractions WHERE json_valid(citations)),
a AS (SELECT guide_id, paragraph_id, unnest(from_json(citations, '[["JSON"]]')) AS y FROM r), c AS (SELECT guide_id, paragraph_id, unnest(y) AS c FROM a),
i AS (SELECT DISTINCT guide_id, paragraph_id, trim(json_extract_string(c, '$.multilingual.eng.id')) AS id FROM c), g AS (SELECT * FROM i WHERE id IS NOT NULL AND id <> '')
"""


def _gold(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "citation_extractions").select("guide_id", "paragraph_id", "citations").distinct()
    parsed = F.from_json("citations", f"array<array<{CITATION}>>")
    ids = rows.select("guide_id", "paragraph_id", F.explode(F.flatten(parsed)).alias("c")).select("guide_id", "paragraph_id", F.trim(F.try_element_at(F.col("c.multilingual"), F.lit("eng"))["id"]).alias("id"))
    return ids.where("id <> ''").groupBy("guide_id", "paragraph_id").agg(F.array_sort(F.collect_set("id")).alias("gold"))


@query(_GOLD + "SELECT guide_id, paragraph_id, string_agg(id, ',' ORDER BY id) AS gold, count(*) AS n FROM g GROUP BY 1, 2")
def golden_ids(spark: SparkSession, d: str) -> DataFrame:
    """The ids of one paragraph's citations: a few, never a group that grows."""
    return _gold(spark, d).select("guide_id", "paragraph_id", F.array_join("gold", ",").alias("gold"), F.size("gold").cast("bigint").alias("n"))


@query(_GOLD + """, b AS (SELECT id FROM g GROUP BY 1 ORDER BY count(*) DESC, id LIMIT 65)
SELECT guide_id, paragraph_id, count(*) AS n FROM g GROUP BY 1, 2 HAVING count(*) FILTER (id IN (SELECT id FROM b)) = 0
""")
def gold_without_blocked(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs none of whose golden ids is among the 65 most cited (the block-list, whose size is fixed)."""
    gold = _gold(spark, d)
    most = gold.select(F.explode("gold").alias("id")).groupBy("id").count().orderBy(F.desc("count"), "id").limit(65)
    return E.usable_gold(gold, "gold", [r["id"] for r in most.collect()]).select("guide_id", "paragraph_id", F.size("gold").cast("bigint").alias("n"))


@query("""
WITH s AS (SELECT p_brand, p_partkey, p_size, CASE WHEN max(p_size) OVER w > min(p_size) OVER w THEN (p_size - min(p_size) OVER w) / (max(p_size) OVER w - min(p_size) OVER w) ELSE CAST(p_size AS DOUBLE) END AS v FROM part WINDOW w AS (PARTITION BY p_brand))
SELECT p_brand, p_partkey, round(v, 6) AS scaled, rank() OVER (PARTITION BY p_brand ORDER BY v DESC) + (count(*) OVER (PARTITION BY p_brand, v) - 1) / 2.0 AS position FROM s
""")
def tie_ranks(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_brand", "p_partkey", F.col("p_size").cast("double").alias("v"))
    ranked = with_average_rank(with_min_max(p, "v", "scaled", "p_brand"), "scaled", "position", "p_brand", descending=True)
    return ranked.select("p_brand", "p_partkey", F.round("scaled", 6).alias("scaled"), "position")


@query("""
WITH g AS (SELECT l_orderkey, list_slice(list(l_partkey % 40 ORDER BY l_linenumber, l_partkey), 1, 5) AS f, list_distinct(list(l_suppkey % 40 ORDER BY l_linenumber)) AS gold FROM lineitem GROUP BY 1),
h AS (SELECT *, len(list_intersect(f, gold)) AS tp, list_transform(f, lambda x, i: CASE WHEN list_contains(gold, x) THEN 1.0 / log2(i + 1) ELSE 0 END) AS gains, list_filter(list_transform(f, lambda x, i: CASE WHEN list_contains(gold, x) THEN i END), lambda z: z IS NOT NULL) AS hits FROM g)
SELECT l_orderkey, round(tp / len(list_distinct(f)), 6) AS p, round(tp / len(gold), 6) AS r, round(CASE WHEN len(hits) = 0 THEN 0.0 ELSE 1.0 / hits[1] END, 6) AS rr, round(list_sum(gains) / (SELECT sum(1.0 / log2(i + 1)) FROM range(1, 6) t(i) WHERE i <= least(len(gold), 5)), 6) AS ndcg FROM h
""")
def list_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Precision, recall, reciprocal rank and nDCG@5 on lists with repeats, which nDCG counts each time."""
    l = table(spark, d, "lineitem")
    g = l.groupBy("l_orderkey").agg(
        F.slice(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"] % 40), 1, 5).alias("f"), F.collect_set(F.col("l_suppkey") % 40).alias("gold"),
    )
    f, gold = F.col("f"), F.col("gold")
    return g.select("l_orderkey", F.round(precision(f, gold), 6).alias("p"), F.round(recall(f, gold), 6).alias("r"), F.round(reciprocal_rank(f, gold), 6).alias("rr"), F.round(ndcg(f, gold, 5), 6).alias("ndcg"))


@query("SELECT _id, counter, docname IS NOT NULL AND kpdate IS NOT NULL AND html IS NOT NULL AS complete FROM (SELECT DISTINCT _id, counter, docname, kpdate, html FROM echr_documents)")
def completeness(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "echr_documents").select("_id", "counter", "docname", "kpdate", "html").distinct()
    marks = e.select("_id", "counter", *[F.when(F.col(c).isNotNull(), 1.0).alias(c) for c in ("docname", "kpdate", "html")])
    return marks.select("_id", "counter", E.complete_rows(marks, ["docname", "kpdate", "html"]).alias("complete"))


@query("WITH t AS (SELECT question AS q FROM question_generations UNION SELECT paragraphs FROM question_generations) SELECT md5(q) AS key, CAST(16 AS INTEGER) AS dim FROM t WHERE q IS NOT NULL AND q NOT IN (SELECT query FROM query_embeddings WHERE query IS NOT NULL)")
def embedding_backlog(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of the deterministic embedder for distinct paragraphs that have none."""
    q = table(spark, d, "question_generations").select(F.col("question").alias("query"))
    p = table(spark, d, "question_generations").select(F.col("paragraphs").alias("query"))
    return embed_missing(q.union(p), "query", table(spark, d, "query_embeddings").where("query IS NOT NULL"), FakeEmbedder()).select(F.md5("query").alias("key"), F.size("embedding").alias("dim"))


@query()
def extraction_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Every paragraph through the extraction with a deterministic provider that takes the links for citations and makes faults, and a fallback: errors by kind, with what was extracted."""
    versions = F.from_json(F.get_json_object("data", "$.lang_versions"), "map<string,struct<id:string,docname:string>>")
    meta = table(spark, d, "meta_cache").where("url IS NOT NULL").groupBy("url").agg(F.max("data").alias("data")).select("url", F.get_json_object("data", "$.kpdate").alias("kpdate"), versions.alias("multilingual"))
    tasks = table(spark, d, "extraction_tasks").select("guide_id", "paragraph_id", "paragraph_text")
    out = extract_citations(tasks, meta, LinkProvider("links-1"), LinkProvider("links-2"))
    return out.groupBy(F.array_join("errors", "+").alias("errors")).agg(F.count("*").alias("n"), F.sum(F.size("sentences")).alias("n_sentences"), F.sum(F.coalesce(F.size("citations"), F.lit(0))).alias("n_citations"))
