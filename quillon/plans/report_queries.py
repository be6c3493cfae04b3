"""Reports, joins, sinks, retrieval and statistics over the tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import citations as C
from ..operators import stats
from ..operators.evaluation import mean_and_std, sample_groups, valid_scores
from ..operators.guides import parse_guides
from ..operators.judgments import headline_report, html_paragraphs
from ..operators.models import FakeProvider, qa_pairs, rag_answers, scored
from ..operators.retrieval import evaluate, f1, top_k
from ..session import stored, table
from ..sources import sinks
from ..sources.fetch import NoFetcher, fetch_judgments

Q: dict = {}
SQL: dict[str, str] = {}
K = 10


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- retrieval: queries are the vectors whose id is divisible by 50, searched in all

_NEAR = """
WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS a, label AS q_label FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query_id, q_label, vec_id, label, {score} AS score FROM q JOIN embeddings ON vec_id <> query_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score {order}, vec_id) AS rank FROM s QUALIFY rank <= {k})
"""
_COSINE = _NEAR.format(score="list_cosine_similarity(a, embedding::DOUBLE[])", order="DESC", k=K)


def _near(spark: SparkSession, d: str, metric: str = "cosine", k: int = K) -> DataFrame:
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return top_k(v.where("id % 50 = 0"), v, k, metric)


@query(_COSINE + "SELECT query_id, vec_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM r")
def knn_cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d).withColumn("score", F.round("score", 6))


@query(_NEAR.format(score="list_sum(list_transform(list_zip(a, embedding::DOUBLE[]), lambda p: (p[1] - p[2]) * (p[1] - p[2])))", order="ASC", k=K) + "SELECT query_id, vec_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM r")
def knn_l2_topk(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d, "l2").withColumn("score", F.round("score", 6))


@query(_COSINE + """,
n AS (SELECT label, count(*) - 1 AS gold FROM embeddings GROUP BY 1),
m AS (SELECT query_id, q_label, count(*) AS n_found, count(*) FILTER (label = q_label) AS hits, coalesce(1.0 / min(rank) FILTER (label = q_label), 0) AS mrr, coalesce(sum(1.0 / log2(rank + 1)) FILTER (label = q_label), 0) AS dcg FROM r GROUP BY 1, 2),
e AS (SELECT m.*, gold, hits / n_found AS p, CASE WHEN gold = 0 THEN 0.0 ELSE hits / gold END AS rc, CASE WHEN gold = 0 THEN 0 ELSE dcg / (SELECT sum(1.0 / log2(i + 1)) FROM range(1, 11) t(i) WHERE i <= least(gold, 10)) END AS ndcg FROM m JOIN n ON n.label = m.q_label)
SELECT q_label AS label, count(*) AS n_queries, round(avg(p), 6) AS precision_at_10, round(avg(rc), 6) AS recall_at_10, round(avg(CASE WHEN p + rc = 0 THEN 0 ELSE 2 * p * rc / (p + rc) END), 6) AS f1_at_10, round(avg(mrr), 6) AS mrr_at_10, round(avg(ndcg), 6) AS ndcg_at_10 FROM e GROUP BY 1
""")
def retrieval_metrics_by_label(spark: SparkSession, d: str) -> DataFrame:
    """Gold of a query: all other vectors of its label. Gold sets are counted, never gathered."""
    e = table(spark, d, "embeddings")
    labels = e.select("vec_id", "label")
    near = _near(spark, d).join(labels, "vec_id").join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("q_label")), "query_id")
    hit = F.col("label") == F.col("q_label")
    m = near.groupBy("query_id", "q_label").agg(
        F.count("*").alias("n_found"), F.count_if(hit).alias("hits"), F.coalesce(1.0 / F.min(F.when(hit, F.col("rank"))), F.lit(0.0)).alias("mrr"), F.coalesce(F.sum(F.when(hit, 1.0 / F.log2(F.col("rank") + 1.0))), F.lit(0.0)).alias("dcg"),
    )
    gold = labels.groupBy(F.col("label").alias("q_label")).agg((F.count("*") - 1).alias("gold"))
    ideal = F.aggregate(F.transform(F.sequence(F.lit(1), F.least(F.col("gold"), F.lit(K)).cast("int")), lambda i: 1.0 / F.log2(i + 1.0)), F.lit(0.0), lambda s, x: s + x)
    p, r = F.col("hits") / F.col("n_found"), F.when(F.col("gold") == 0, 0.0).otherwise(F.try_divide("hits", "gold"))
    x = m.join(gold, "q_label").withColumn("p", p).withColumn("r", r).withColumn("ndcg", F.when(F.col("gold") == 0, 0.0).otherwise(F.col("dcg") / F.when(F.col("gold") > 0, ideal)))
    out = {"precision_at_10": F.col("p"), "recall_at_10": F.col("r"), "f1_at_10": f1(F.col("p"), F.col("r")), "mrr_at_10": F.col("mrr"), "ndcg_at_10": F.col("ndcg")}
    return x.groupBy(F.col("q_label").alias("label")).agg(F.count("*").alias("n_queries"), *[F.round(F.avg(c), 6).alias(k) for k, c in out.items()])


@query(_COSINE + "SELECT query_id, string_agg(CAST(vec_id AS VARCHAR), ',' ORDER BY rank) AS context, count(*) AS n FROM r WHERE vec_id // 8 <> query_id // 8 GROUP BY 1")
def context_excluding_group(spark: SparkSession, d: str) -> DataFrame:
    """The k best first, then without those of the query's own group: fewer than k may be left."""
    near = _near(spark, d).where(F.floor(F.col("vec_id") / 8) != F.floor(F.col("query_id") / 8))
    return near.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "vec_id"))), lambda x: x["vec_id"].cast("string")), ",").alias("context"), F.count("*").alias("n"))


# ---- grouping and reports


@query("""
WITH l AS (SELECT guide_id, CAST(paragraph_id AS INTEGER) AS pid, paragraph_text AS t FROM citation_extractions QUALIFY row_number() OVER (PARTITION BY guide_id, paragraph_id ORDER BY updated_at DESC NULLS LAST, citations DESC NULLS LAST) = 1)
SELECT guide_id, CAST(pid // 10 AS BIGINT) AS group_id, md5(string_agg(t, ' ' ORDER BY pid)) AS hash, count(t) AS n FROM l WHERE guide_id IS NOT NULL AND pid IS NOT NULL GROUP BY 1, 2
""")
def group_text_concat(spark: SparkSession, d: str) -> DataFrame:
    e = sinks.latest(table(spark, d, "citation_extractions").select("guide_id", "paragraph_id", "paragraph_text", "updated_at", "citations"), ["guide_id", "paragraph_id"], "updated_at", "citations")
    e = e.select("guide_id", F.col("paragraph_id").try_cast("int").alias("pid"), "paragraph_text").where("guide_id IS NOT NULL AND pid IS NOT NULL")
    texts = F.filter(F.transform(F.sort_array(F.collect_list(F.struct("pid", "paragraph_text"))), lambda x: x["paragraph_text"]), lambda t: t.isNotNull())
    return e.groupBy("guide_id", F.floor(F.col("pid") / 10).alias("group_id")).agg(F.when(F.count("paragraph_text") > 0, F.md5(F.array_join(texts, " "))).alias("hash"), F.count("paragraph_text").alias("n"))


@query("""
SELECT coalesce(source, 'unknown') AS source, count(*) FILTER (lower(lang) IN ('eng', 'en')) AS eng, count(*) FILTER (lower(lang) IN ('fre', 'fr')) AS fre, count(*) FILTER (lower(lang) IN ('ron', 'ro')) AS ron,
 round(100.0 * count(*) FILTER (lower(lang) IN ('eng', 'en')) / count(*), 1) AS eng_share, count(*) AS n FROM documents GROUP BY 1
""")
def lang_source_pivot(spark: SparkSession, d: str) -> DataFrame:
    lang = F.lower("lang")
    g = table(spark, d, "documents").groupBy(F.coalesce("source", F.lit("unknown")).alias("source"))
    out = g.agg(*[F.count_if(lang.isin(k, k2)).alias(k) for k, k2 in (("eng", "en"), ("fre", "fr"), ("ron", "ro"))], F.count("*").alias("n"))
    return out.withColumn("eng_share", F.round(100.0 * F.col("eng") / F.col("n"), 1))


@query("""
WITH c AS (SELECT model_name, least(coalesce(num_paragraphs, 0), 3) AS category, count(*) AS n FROM question_generations WHERE model_name IS NOT NULL GROUP BY 1, 2),
g AS (SELECT m.model_name, k.category FROM (SELECT DISTINCT model_name FROM question_generations WHERE model_name IS NOT NULL) m CROSS JOIN (VALUES (0), (1), (2), (3)) k(category))
SELECT g.model_name, g.category, coalesce(c.n, 0) AS n, round(100.0 * coalesce(c.n, 0) / sum(coalesce(c.n, 0)) OVER (PARTITION BY g.model_name), 1) AS share FROM g LEFT JOIN c ON c.model_name = g.model_name AND c.category = g.category
""")
def score_value_counts(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "question_generations").where("model_name IS NOT NULL")
    c = q.groupBy("model_name").agg(*[F.count_if(F.least(F.coalesce("num_paragraphs", F.lit(0)), F.lit(3)) == i).alias(f"c{i}") for i in range(4)])
    long = c.selectExpr("model_name", "stack(4, 0, c0, 1, c1, 2, c2, 3, c3) AS (category, n)")
    return long.withColumn("share", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("model_name")), 1))


@query("""
WITH s AS (SELECT doctype, CASE WHEN counter % 13 = 0 THEN -1 WHEN counter % 17 = 0 THEN -2 ELSE counter % 6 END AS score FROM echr_documents)
SELECT doctype, count(score) FILTER (score NOT IN (-1, -2)) AS n, round(avg(score) FILTER (score NOT IN (-1, -2)), 6) AS mean, round(stddev_samp(score) FILTER (score NOT IN (-1, -2)), 6) AS sd,
 CASE WHEN count(score) FILTER (score <> -1) = 0 THEN 'N/A' ELSE printf('%.3f ± ', avg(score) FILTER (score <> -1)) || coalesce(printf('%.3f', stddev_samp(score) FILTER (score <> -1)), 'NaN') END AS report FROM s GROUP BY 1
""")
def mean_std_report(spark: SparkSession, d: str) -> DataFrame:
    """Without both sentinels as numbers, without the first alone as the report's text."""
    c = F.col("counter")
    s = table(spark, d, "echr_documents").select("doctype", F.when(c % 13 == 0, -1).when(c % 17 == 0, -2).otherwise(c % 6).alias("score"))
    valid = valid_scores(s, "score").groupBy("doctype").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean"), F.round(F.stddev_samp("score"), 6).alias("sd"))
    return mean_and_std(s, "score", "doctype", sentinels=(-1,)).join(valid, "doctype", "left")


@query("SELECT coalesce(source, 'unknown') AS source, min(length(text)) AS least, max(length(text)) AS most, round(avg(length(text)), 6) AS mean, CAST(median(length(text)) AS DOUBLE) AS median FROM documents GROUP BY 1")
def text_length_stats(spark: SparkSession, d: str) -> DataFrame:
    n = F.length("text").cast("bigint")
    return table(spark, d, "documents").groupBy(F.coalesce("source", F.lit("unknown")).alias("source")).agg(F.min(n).alias("least"), F.max(n).alias("most"), F.round(F.avg(n), 6).alias("mean"), F.median(n).alias("median"))


@query("SELECT doctype, count(*) AS n, count(*) FILTER (coalesce(lower(isplaceholder), 'false') <> 'true') AS n_real, count(*) FILTER (kpdate >= '1990' AND kpdate < '2006') AS n_in_years, count(*) FILTER (kpdate IS NULL OR left(kpdate, 4) = '0001') AS n_undated FROM echr_documents GROUP BY 1")
def doctype_histogram(spark: SparkSession, d: str) -> DataFrame:
    e, k = table(spark, d, "echr_documents"), F.col("kpdate")
    return e.groupBy("doctype").agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.lower("isplaceholder"), F.lit("false")) != "true").alias("n_real"), F.count_if((k >= "1990") & (k < "2006")).alias("n_in_years"), F.count_if(k.isNull() | (F.left(k, F.lit(4)) == "0001")).alias("n_undated"))


@query("SELECT count(*) AS n, count(*) FILTER (question IS NULL OR trim(question) = '') AS n_without_question, count(*) FILTER (num_paragraphs >= 4) AS n_passed, count(*) FILTER (num_paragraphs < 4) AS n_failed, count(*) FILTER (nullif(num_paragraphs % 5, 0) > 2) AS n_grounded, count(*) FILTER (nullif(num_paragraphs % 5, 0) <= 2) AS n_ungrounded, count(*) FILTER (nullif(num_paragraphs % 5, 0) IS NULL) AS n_not_asked, count(DISTINCT (group_id, guide_id)) AS n_groups FROM question_generations")
def pipeline_counters(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "question_generations")
    gate, grounded = F.col("num_paragraphs") >= 4, F.nullif(F.col("num_paragraphs") % 5, F.lit(0)) > 2  # of three states: null where it wasn't asked
    return q.agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.trim("question"), F.lit("")) == "").alias("n_without_question"), F.count_if(gate).alias("n_passed"), F.count_if(~gate).alias("n_failed"), F.count_if(grounded).alias("n_grounded"), F.count_if(~grounded).alias("n_ungrounded"), F.count_if(grounded.isNull()).alias("n_not_asked"), F.countDistinct(F.struct("group_id", "guide_id")).alias("n_groups"))


@query("""
WITH f AS (SELECT grouping_method, model_name, min(guide_id || '/' || group_id) AS first_key, count(*) AS n FROM question_generations WHERE model_name IS NOT NULL GROUP BY 1, 2)
SELECT split_part(model_name, '-', 1) AS family, count(DISTINCT model_name) AS n_models, CAST(sum(n) AS BIGINT) AS n, min(first_key) AS first_key FROM f GROUP BY 1 HAVING count(DISTINCT model_name) >= 2
""")
def model_families(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "question_generations").where("model_name IS NOT NULL")
    f = q.groupBy("model_name").agg(F.min(F.concat("guide_id", F.lit("/"), F.col("group_id").cast("string"))).alias("first_key"), F.count("*").alias("n"))
    return f.groupBy(F.substring_index("model_name", "-", 1).alias("family")).agg(F.count("*").alias("n_models"), F.sum("n").alias("n"), F.min("first_key").alias("first_key")).where("n_models >= 2")


@query("""
WITH r AS (SELECT guide_id, json_array_length(errors) AS n FROM citation_extractions WHERE errors IS NOT NULL AND json_valid(errors))
SELECT guide_id, count(*) AS n_rows, count(*) FILTER (n > 0) AS n_failed, round(100.0 * count(*) FILTER (n > 0) / count(*), 6) AS percent FROM r GROUP BY 1
""")
def extraction_failures(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "citation_extractions").select("guide_id", F.size(F.from_json("errors", "array<string>")).alias("n")).where("n IS NOT NULL AND n >= 0")
    return r.groupBy("guide_id").agg(F.count("*").alias("n_rows"), F.count_if(F.col("n") > 0).alias("n_failed"), F.round(100.0 * F.avg((F.col("n") > 0).cast("double")), 6).alias("percent"))


# ---- sources and sinks


@query("SELECT DISTINCT q.question, sha256(q.question) AS hash FROM question_generations q SEMI JOIN query_embeddings e ON e.query = q.question")
def cache_hits(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "question_generations").select("question").distinct()
    return q.join(table(spark, d, "query_embeddings").select(F.col("query").alias("question")), "question", "left_semi").select("question", F.sha2("question", 256).alias("hash"))


@query("SELECT q.guide_id, count(DISTINCT q.paragraphs) AS n_missing FROM question_generations q ANTI JOIN query_embeddings e ON e.query = q.paragraphs WHERE q.paragraphs IS NOT NULL GROUP BY 1")
def cache_misses(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "question_generations").where("paragraphs IS NOT NULL").select("guide_id", F.xxhash64("paragraphs").alias("h"), F.sha2("paragraphs", 256).alias("key")).distinct()
    known = table(spark, d, "query_embeddings").where("query IS NOT NULL").select(F.sha2("query", 256).alias("key"))
    return q.join(known, "key", "left_anti").groupBy("guide_id").agg(F.countDistinct("key").alias("n_missing"))


@query("""
WITH m AS (SELECT url, created_at, md5(data) AS hash, length(data) % 2 AS odd, data FROM meta_cache), l AS (SELECT * FROM m WHERE odd IS NOT NULL QUALIFY row_number() OVER (PARTITION BY url, odd ORDER BY created_at DESC NULLS LAST, data DESC NULLS LAST) = 1),
n AS (SELECT url, created_at, hash FROM l WHERE odd = 0)
SELECT * FROM n UNION ALL SELECT l.url, l.created_at, l.hash FROM l ANTI JOIN n ON n.url = l.url WHERE odd = 1
""")
def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    """Half of the cache's rows put into the other half."""
    m = table(spark, d, "meta_cache")
    old = sinks.latest(m.where("length(data) % 2 = 1"), ["url"], "created_at", "data")
    return sinks.upsert(old, m.where("length(data) % 2 = 0"), ["url"], "created_at", "data").select("url", "created_at", F.md5("data").alias("hash"))


@query("""
WITH old AS (SELECT case_id, paragraph_number, paragraph_text FROM judgements WHERE recently_parsed IS NULL AND case_id IS NOT NULL),
fresh AS (SELECT case_id, paragraph_number, paragraph_text FROM judgements WHERE recently_parsed IS NOT NULL AND case_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY case_id, paragraph_number ORDER BY created_at ASC NULLS LAST, paragraph_text ASC NULLS LAST) = 1),
a AS (SELECT * FROM old UNION ALL SELECT f.* FROM fresh f ANTI JOIN old o ON o.case_id = f.case_id AND o.paragraph_number = f.paragraph_number)
SELECT case_id, count(*) AS n, count(DISTINCT paragraph_number) AS n_numbers, CAST(sum(length(paragraph_text)) AS BIGINT) AS n_chars FROM a GROUP BY 1
""")
def insert_if_absent(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "judgements").where("case_id IS NOT NULL").select("case_id", "paragraph_number", "paragraph_text", "recently_parsed", "created_at")
    out = sinks.insert_if_absent(j.where("recently_parsed IS NULL"), j.where("recently_parsed IS NOT NULL"), ["case_id", "paragraph_number"], "created_at", "paragraph_text")
    return out.groupBy("case_id").agg(F.count("*").alias("n"), F.countDistinct("paragraph_number").alias("n_numbers"), F.sum(F.length("paragraph_text")).alias("n_chars"))


@query("""
WITH old AS (SELECT DISTINCT languagenumber FROM echr_documents WHERE languagenumber = 0)
SELECT languagenumber, count(*) AS n FROM echr_documents WHERE languagenumber = 0 OR languagenumber NOT IN (SELECT languagenumber FROM old) GROUP BY 1
""")
def version_append(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "echr_documents").select("languagenumber", "_id")
    return sinks.append_versions(e.where("languagenumber = 0"), e.where("languagenumber IS NOT NULL"), "languagenumber").groupBy("languagenumber").agg(F.count("*").alias("n"))


@query("""
WITH h AS (SELECT case_id, paragraph_number, 0 AS version, max(paragraph_text) AS t FROM judgements WHERE recently_parsed IS NULL AND paragraph_text IS NOT NULL AND case_id IS NOT NULL AND paragraph_number IS NOT NULL GROUP BY 1, 2),
n AS (SELECT case_id, paragraph_number, max(paragraph_text) AS t FROM judgements WHERE recently_parsed IS NOT NULL AND paragraph_text IS NOT NULL AND case_id IS NOT NULL AND paragraph_number IS NOT NULL GROUP BY 1, 2)
SELECT n.case_id || '#' || n.paragraph_number AS key, CASE WHEN h.version IS NULL THEN 0 ELSE 1 END AS version, md5(n.t) AS hash FROM n LEFT JOIN h ON h.case_id = n.case_id AND h.paragraph_number = n.paragraph_number WHERE h.t IS NULL OR h.t <> n.t
""")
def text_versions(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "judgements").where("paragraph_text IS NOT NULL AND case_id IS NOT NULL AND paragraph_number IS NOT NULL")
    key = F.concat("case_id", F.lit("#"), F.col("paragraph_number").cast("string")).alias("key")
    old = j.where("recently_parsed IS NULL").groupBy(key).agg(F.max("paragraph_text").alias("text")).withColumn("version", F.lit(0))
    new = j.where("recently_parsed IS NOT NULL").groupBy(key).agg(F.max("paragraph_text").alias("text"))
    return sinks.next_versions(old, new, "key", "text").select("key", "version", F.md5("text").alias("hash"))


@query("""
WITH w AS (SELECT DISTINCT _id AS case_id FROM echr_documents WHERE _id IS NOT NULL), c AS (SELECT case_id, min(paragraph_text) FILTER (paragraph_number = 1) AS first FROM judgements WHERE case_id IS NOT NULL GROUP BY 1),
s AS (SELECT DISTINCT _id FROM echr_documents WHERE coalesce(lower(isplaceholder), 'false') <> 'true' AND html <> '' AND NOT starts_with(ltrim(html), '{'))
SELECT w.case_id, CASE WHEN c.case_id IS NOT NULL THEN 'cache' WHEN s._id IS NOT NULL THEN 'store' END AS tier, CASE WHEN c.case_id IS NOT NULL THEN md5(coalesce(first, 'Paragraph missing')) END AS hash FROM w LEFT JOIN c ON c.case_id = w.case_id LEFT JOIN s ON s._id = w.case_id
""")
def tiered_fetch(spark: SparkSession, d: str) -> DataFrame:
    """The first paragraph of every case in the catalogue, from the tier that has the case; the texts of the cache by hash."""
    e = table(spark, d, "echr_documents").where("_id IS NOT NULL")
    wanted = e.select(F.col("_id").alias("case_id"), F.lit(1).alias("paragraph_number")).distinct()
    rows, _ = fetch_judgments(wanted, table(spark, d, "judgements"), e, NoFetcher())
    return rows.select("case_id", "tier", F.when(F.col("tier") == "cache", F.md5("paragraph_text")).alias("hash"))


# ---- joins and sets


@query("""
WITH w AS (SELECT l_orderkey, l_partkey, l_linenumber, l_extendedprice FROM lineitem), t AS (SELECT p_partkey, p_retailprice AS v FROM part WHERE p_partkey % 7 <> 0)
SELECT l_orderkey, bool_and(t.p_partkey IS NOT NULL) AS whole, CASE WHEN bool_and(t.p_partkey IS NOT NULL) THEN count(*) ELSE 0 END AS n_found, CASE WHEN bool_and(t.p_partkey IS NOT NULL) THEN round(sum(v), 2) ELSE 0.0 END AS total FROM w LEFT JOIN t ON t.p_partkey = w.l_partkey GROUP BY 1
""")
def all_or_nothing_lookup(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("p_partkey"), F.col("l_linenumber").alias("ord"))
    there = table(spark, d, "part").where("p_partkey % 7 <> 0").select("p_partkey", "p_retailprice")
    v = C.all_or_nothing(w, there, "l_orderkey", ["p_partkey"], "p_retailprice")
    total = F.round(F.aggregate("values", F.lit(0.0), lambda s, x: s + x), 2)
    return v.select("l_orderkey", F.col("values").isNotNull().alias("whole"), F.when(F.col("values").isNotNull(), F.size("values")).otherwise(0).cast("bigint").alias("n_found"), F.coalesce(total, F.lit(0.0)).alias("total"))


@query("""
WITH l AS (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey) FILTER (l_returnflag = 'R') AS g0, list(l_partkey ORDER BY l_linenumber, l_partkey) FILTER (l_quantity > 25) AS h0 FROM lineitem GROUP BY 1),
g AS (SELECT l_orderkey, coalesce(list_filter(g0, lambda x, i: list_position(g0, x) = i), []) AS gen, coalesce(list_filter(h0, lambda x, i: list_position(h0, x) = i), []) AS gold FROM l)
SELECT l_orderkey, array_to_string(list_filter(gen, lambda x: NOT list_contains(gold, x)), ',') AS only_gen, array_to_string(list_filter(gen, lambda x: list_contains(gold, x)), ',') AS both_sets, array_to_string(list_filter(gold, lambda x: NOT list_contains(gen, x)), ',') AS only_gold FROM g
""")
def citation_set_diff(spark: SparkSession, d: str) -> DataFrame:
    """What only one side has and what both have, each in its side's own order."""
    side = lambda c: F.array_distinct(F.transform(F.sort_array(F.collect_list(F.when(c, F.struct("l_linenumber", "l_partkey")))), lambda x: x["l_partkey"]))
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(side(F.col("l_returnflag") == "R").alias("gen"), side(F.col("l_quantity") > 25).alias("gold"))
    text = lambda a: F.array_join(a.cast("array<string>"), ",")
    return g.select("l_orderkey", text(F.array_except("gen", "gold")).alias("only_gen"), text(F.array_intersect("gen", "gold")).alias("both_sets"), text(F.array_except("gold", "gen")).alias("only_gold"))


@query("""
WITH u AS (SELECT regexp_extract(m, '(\\d{3}-\\d+)', 1) AS id, count(*) AS n FROM (SELECT unnest(regexp_extract_all(answer, '"eng[\\\\]*": [{][\\\\]*"id[\\\\]*": [\\\\]*" *\\d{3}-\\d+')) AS m FROM question_generations) GROUP BY 1),
k AS (SELECT u.*, e._id IS NOT NULL AS there, j.case_id IS NOT NULL AS parsed FROM u LEFT JOIN (SELECT DISTINCT _id FROM echr_documents) e ON e._id = u.id LEFT JOIN (SELECT DISTINCT case_id FROM judgements) j ON j.case_id = u.id)
SELECT count(*) AS n_ids, CAST(sum(n) AS BIGINT) AS n_references, count(*) FILTER (there) AS n_there, count(*) FILTER (parsed) AS n_parsed, round(100.0 * count(*) FILTER (NOT there) / greatest(count(*), 1), 6) AS percent_missing, min(id) FILTER (NOT there) AS first_missing FROM k
""")
def availability_stats(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "question_generations").select(F.explode(F.regexp_extract_all("answer", F.lit(r'"eng[\\]*": [{][\\]*"id[\\]*": [\\]*" *(\d{3}-\d+)'), 1)).alias("id"))
    u = ids.groupBy("id").agg(F.count("*").alias("n"))
    e = table(spark, d, "echr_documents").select(F.col("_id").alias("id")).distinct().withColumn("there", F.lit(True))
    j = table(spark, d, "judgements").select(F.col("case_id").alias("id")).distinct().withColumn("parsed", F.lit(True))
    k = u.join(e, "id", "left").join(j, "id", "left").withColumn("there", F.coalesce("there", F.lit(False))).withColumn("parsed", F.coalesce("parsed", F.lit(False)))
    return k.agg(
        F.count("*").alias("n_ids"), F.sum("n").alias("n_references"), F.count_if("there").alias("n_there"), F.count_if("parsed").alias("n_parsed"),
        F.round(100.0 * F.count_if(~F.col("there")) / F.greatest(F.count("*"), F.lit(1)), 6).alias("percent_missing"), F.min(F.when(~F.col("there"), F.col("id"))).alias("first_missing"),
    )


@query("""
WITH u AS (SELECT guide_id, group_id, model_name, regexp_extract(m, '(\\d{3}-\\d+)', 1) AS id FROM (SELECT guide_id, group_id, model_name, unnest(regexp_extract_all(answer, '"eng[\\\\]*": [{][\\\\]*"id[\\\\]*": [\\\\]*" *\\d{3}-\\d+')) AS m FROM question_generations))
SELECT u.id, count(*) AS n_references, count(DISTINCT guide_id) AS n_guides FROM u ANTI JOIN echr_documents e ON e._id = u.id GROUP BY 1
""")
def missing_ids(spark: SparkSession, d: str) -> DataFrame:
    """Cited ids that the catalogue lacks, in order."""
    ids = table(spark, d, "question_generations").select("guide_id", F.explode(F.regexp_extract_all("answer", F.lit(r'"eng[\\]*": [{][\\]*"id[\\]*": [\\]*" *(\d{3}-\d+)'), 1)).alias("id"))
    lost = ids.join(table(spark, d, "echr_documents").select(F.col("_id").alias("id")).distinct(), "id", "left_anti")
    return lost.groupBy("id").agg(F.count("*").alias("n_references"), F.countDistinct("guide_id").alias("n_guides")).orderBy("id")


@query("""
WITH u AS (SELECT DISTINCT guide_id, group_id, grouping_method, model_name, unnest(regexp_extract_all(answer, '\\d{3}-\\d{4,}')) AS id FROM question_generations WHERE guide_id IS NOT NULL AND group_id IS NOT NULL AND grouping_method IS NOT NULL AND model_name IS NOT NULL),
k AS (SELECT u.*, e._id IS NOT NULL AS there FROM u LEFT JOIN (SELECT DISTINCT _id FROM echr_documents) e ON e._id = u.id)
SELECT model_name, count(*) AS n_answers, count(*) FILTER (whole) AS n_complete FROM (SELECT guide_id, group_id, grouping_method, model_name, bool_and(there) AS whole FROM k GROUP BY 1, 2, 3, 4) GROUP BY 1
""")
def complete_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers all of whose cited ids the catalogue has, by model."""
    key = ["guide_id", "group_id", "grouping_method", "model_name"]
    q = table(spark, d, "question_generations").where(" AND ".join(f"{k} IS NOT NULL" for k in key))
    ids = q.select(*key, F.explode(F.regexp_extract_all("answer", F.lit(r"(\d{3}-\d{4,})"), 1)).alias("id")).distinct()
    there = ids.join(table(spark, d, "echr_documents").select(F.col("_id").alias("id")).distinct().withColumn("there", F.lit(True)), "id", "left")
    whole = there.groupBy(*key).agg(F.every(F.coalesce("there", F.lit(False))).alias("whole"))
    return whole.groupBy("model_name").agg(F.count("*").alias("n_answers"), F.count_if("whole").alias("n_complete"))


@query("""
WITH c AS (SELECT DISTINCT case_id FROM judgements WHERE case_id IS NOT NULL AND case_name IS NULL),
v AS (SELECT json_extract(data, '$.lang_versions') AS v FROM meta_cache WHERE json_valid(data)),
f AS (SELECT unnest(json_keys(v)) AS lang, v FROM v WHERE json_type(v) = 'OBJECT'),
g AS (SELECT trim(json_extract_string(v, '$.' || lang || '.id')) AS case_id, lang, json_extract_string(v, '$.' || lang || '.docname') AS docname FROM f)
SELECT g.case_id, docname FROM g SEMI JOIN c ON c.case_id = g.case_id WHERE docname IS NOT NULL QUALIFY row_number() OVER (PARTITION BY g.case_id ORDER BY CASE lang WHEN 'eng' THEN 0 WHEN 'fre' THEN 1 ELSE 2 END, lang, docname) = 1
""")
def missing_case_names(spark: SparkSession, d: str) -> DataFrame:
    return C.missing_names(table(spark, d, "judgements"), table(spark, d, "meta_cache"))


@query("""
SELECT appno, lang, _id, docname FROM (SELECT *, CASE upper(languageisocode) WHEN 'ENG' THEN 'eng' WHEN 'FRE' THEN 'fre' WHEN 'RUM' THEN 'ron' ELSE languageisocode END AS lang FROM echr_documents
 WHERE appno IS NOT NULL AND docname IS NOT NULL AND NOT starts_with(_id, '002-') AND coalesce(lower(isplaceholder), 'false') <> 'true') QUALIFY row_number() OVER (PARTITION BY appno, lang ORDER BY counter, _id, docname) = 1
""")
def translation_versions(spark: SparkSession, d: str) -> DataFrame:
    up = F.upper("languageisocode")
    lang = F.when(up == "ENG", "eng").when(up == "FRE", "fre").when(up == "RUM", "ron").otherwise(F.col("languageisocode"))
    e = table(spark, d, "echr_documents").where("appno IS NOT NULL AND docname IS NOT NULL AND NOT startswith(_id, '002-') AND coalesce(lower(isplaceholder), 'false') <> 'true'").withColumn("lang", lang)
    w = Window.partitionBy("appno", "lang").orderBy(F.asc_nulls_last("counter"), "_id", "docname")
    return e.withColumn("n", F.row_number().over(w)).where("n = 1").select("appno", "lang", "_id", "docname")


@query("""
WITH c AS (SELECT source, lang, avg(n_chars) AS m FROM documents WHERE source IS NOT NULL AND lang IN ('eng', 'fre', 'ron') GROUP BY 1, 2)
SELECT a.source AS a, b.source AS b, a.lang, round(b.m - a.m, 4) AS diff FROM c a JOIN c b ON a.lang = b.lang AND a.source < b.source
""")
def config_pairs(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "documents").where("source IS NOT NULL AND lang IN ('eng', 'fre', 'ron')").groupBy("source", "lang").agg(F.avg("n_chars").alias("m"))
    a, b = c.alias("a"), c.alias("b")
    return a.join(b, (F.col("a.lang") == F.col("b.lang")) & (F.col("a.source") < F.col("b.source"))).select(F.col("a.source").alias("a"), F.col("b.source").alias("b"), F.col("a.lang").alias("lang"), F.round(F.col("b.m") - F.col("a.m"), 4).alias("diff"))


@query("""
WITH e AS (SELECT guide_id, CAST(paragraph_id AS INTEGER) AS pid, json_array_length(errors) AS bad, (length(citations) - length(replace(citations, '"original_url"', ''))) // 14 AS n FROM citation_extractions QUALIFY row_number() OVER (PARTITION BY guide_id, paragraph_id ORDER BY updated_at DESC NULLS LAST, citations DESC NULLS LAST) = 1),
w AS (SELECT guide_id, pid, pid // 3 AS g FROM e UNION SELECT guide_id, pid + 1, pid // 3 FROM e WHERE pid % 17 = 0)
SELECT w.guide_id, CAST(g AS BIGINT) AS group_id, bool_and(e.pid IS NOT NULL) AND coalesce(sum(bad), 0) = 0 AND coalesce(sum(n), 0) > 0 AS valid FROM w LEFT JOIN e ON e.guide_id = w.guide_id AND e.pid = w.pid GROUP BY 1, 2
""")
def valid_citation_groups(spark: SparkSession, d: str) -> DataFrame:
    e = sinks.latest(table(spark, d, "citation_extractions").select("guide_id", "paragraph_id", "errors", "citations", "updated_at"), ["guide_id", "paragraph_id"], "updated_at", "citations")
    e = e.select("guide_id", F.col("paragraph_id").try_cast("int").alias("paragraph_id"), F.from_json("errors", "array<string>").alias("errors"), F.regexp_count("citations", F.lit('"original_url"')).alias("n_citations"))
    g = F.floor(F.col("paragraph_id") / 3).alias("group_id")
    wanted = e.select("guide_id", "paragraph_id", g).union(e.where("paragraph_id % 17 = 0").select("guide_id", F.col("paragraph_id") + 1, g)).distinct()
    return C.valid_groups(wanted, e)


@query("""
WITH g AS (SELECT DISTINCT guide_id, group_id FROM question_generations WHERE guide_id IS NOT NULL),
r AS (SELECT guide_id, count(*) AS n, row_number() OVER (ORDER BY md5('112' || guide_id), guide_id) AS guide_rank FROM g GROUP BY 1 QUALIFY guide_rank <= 15), c AS (SELECT guide_id, least(10, min(n) OVER (ORDER BY guide_rank ROWS UNBOUNDED PRECEDING)) AS cap FROM r),
k AS (SELECT g.*, row_number() OVER (PARTITION BY guide_id ORDER BY md5('112' || guide_id || '/' || group_id), group_id) AS rank FROM g)
SELECT k.guide_id, k.group_id, CAST(rank AS INTEGER) AS rank FROM k JOIN c ON c.guide_id = k.guide_id WHERE rank <= cap
""")
def seeded_group_sample(spark: SparkSession, d: str) -> DataFrame:
    """15 guides, then up to 10 groups of each, fewer after a guide that has fewer: the sampling operator itself."""
    return sample_groups(table(spark, d, "question_generations"))


# ---- statistics: quantities of a supplier's parts before and after, by return flag

_PAIRS = "WITH m AS (SELECT l_suppkey AS id, l_returnflag AS g, l_linestatus AS s, avg(l_quantity) AS v FROM lineitem GROUP BY 1, 2, 3), p AS (SELECT id, g, max(v) FILTER (s = 'O') AS a, max(v) FILTER (s = 'F') AS b FROM m GROUP BY 1, 2), d AS (SELECT *, b - a AS d FROM p WHERE a IS NOT NULL AND b IS NOT NULL)"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("id"), F.col("l_returnflag").alias("g")).agg(F.avg(F.when(F.col("l_linestatus") == "O", F.col("l_quantity"))).alias("a"), F.avg(F.when(F.col("l_linestatus") == "F", F.col("l_quantity"))).alias("b"))
    return m


@query(_PAIRS + "SELECT g, count(*) AS n, round(avg(d), 6) AS mean_diff, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 6) AS t, round(avg(d) / stddev_samp(d), 6) AS cohens_d FROM d GROUP BY 1")
def paired_ttest(spark: SparkSession, d: str) -> DataFrame:
    return stats.paired_t(_pairs(spark, d), "g").select("g", "n", *[F.round(c, 6).alias(c) for c in ("mean_diff", "t", "cohens_d")])


_RANKED = _PAIRS + ", x AS (SELECT *, round(abs(d), 9) AS z FROM d WHERE d <> 0), r AS (SELECT *, rank() OVER (PARTITION BY g ORDER BY z) + (count(*) OVER (PARTITION BY g, z) - 1) / 2.0 AS r FROM x), w AS (SELECT g, count(*) AS n, least(coalesce(sum(r) FILTER (d > 0), 0), coalesce(sum(r) FILTER (d < 0), 0)) AS statistic FROM r GROUP BY 1)"


@query(_RANKED + "SELECT w.g, n, CAST(statistic AS DOUBLE) AS statistic, round((statistic - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0), 6) AS z, round(abs((statistic - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0)) / sqrt(n), 6) AS effect_size_r FROM w")
def paired_wilcoxon(spark: SparkSession, d: str) -> DataFrame:
    return stats.wilcoxon(_pairs(spark, d), "g").select("g", "n", "statistic", F.round("z", 6).alias("z"), F.round("effect_size_r", 6).alias("effect_size_r"))


@query()
def paired_p_values(spark: SparkSession, d: str) -> DataFrame:
    """p of both tests with their adjustment; no SQL has these distributions."""
    p = _pairs(spark, d)
    t, w = stats.paired_t(p, "g").select("g", F.lit("t").alias("test"), "p"), stats.wilcoxon(p, "g").select("g", F.lit("wilcoxon").alias("test"), "p")
    return stats.benjamini_hochberg(t.unionByName(w), "p", "g", "test")


@query("""
WITH t AS (SELECT event_type, user_id % 20 AS u, round(1.0 / (1 + count(*)), 9) AS p FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (ORDER BY p, event_type, u) AS k, count(*) OVER () AS m FROM t)
SELECT event_type, u, p, round(least(1.0, min(p * m / k) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING)), 9) AS p_adjusted FROM r
""")
def bh_adjust(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "events").groupBy("event_type", (F.col("user_id") % 20).alias("u")).agg(F.round(1.0 / (1 + F.count("*")), 9).alias("p"))
    return stats.benjamini_hochberg(t, "p", "event_type", "u").select("event_type", "u", "p", F.round("p_adjusted", 9).alias("p_adjusted"))


@query("""
WITH p AS (SELECT p_brand AS g, CAST(p_size AS DOUBLE) AS a, p_retailprice AS b FROM part), r AS (SELECT g, rank() OVER (PARTITION BY g ORDER BY a) + (count(*) OVER (PARTITION BY g, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY g ORDER BY b) + (count(*) OVER (PARTITION BY g, b) - 1) / 2.0 AS rb FROM p)
SELECT g, count(*) AS n, round(corr(ra, rb), 6) AS rho FROM r GROUP BY 1
""")
def spearman_rank(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_brand").alias("g"), F.col("p_size").cast("double").alias("a"), F.col("p_retailprice").alias("b"))
    return stats.spearman(p, "g").select("g", "n", F.round("rho", 6).alias("rho"))


# scores that runs gave to questions: a line's quantity and price, by mode of a run
_RUNS = "q AS (SELECT l_suppkey AS id, CAST(l_linenumber AS VARCHAR) AS doc, l_returnflag AS query, round(avg(l_quantity), 6) AS v FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1, 2, 3)"
_SIGNED = """,
d AS (SELECT *, b - a AS d FROM p), e AS (SELECT {g}, count(*) AS n_pairs, count(*) FILTER (d <> 0) AS n, avg(d) AS mean_diff FROM d GROUP BY {g} HAVING count(*) >= 5),
x AS (SELECT {g}, d, round(abs(d), 9) AS z FROM d WHERE d <> 0), r AS (SELECT *, rank() OVER (PARTITION BY {g} ORDER BY z) + (count(*) OVER (PARTITION BY {g}, z) - 1) / 2.0 AS r FROM x),
w AS (SELECT {g}, least(coalesce(sum(r) FILTER (d > 0), 0), coalesce(sum(r) FILTER (d < 0), 0)) AS statistic FROM r GROUP BY {g})
SELECT {g}, n_pairs, n_pairs - n AS n_ties, round((n_pairs - n) / n_pairs, 6) AS ties_pct, CAST(coalesce(statistic, 0) AS DOUBLE) AS statistic, round(mean_diff, 6) AS mean_diff FROM e LEFT JOIN w USING ({g})
"""


def _runs(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").where("l_linenumber <= 3")
    return lines.groupBy(F.col("l_suppkey").alias("id"), F.col("l_linenumber").cast("string").alias("doc"), F.col("l_returnflag").alias("query")).agg(F.round(F.avg("l_quantity"), 6).alias("v"))


def _tested(out: DataFrame, *names: str) -> DataFrame:
    return out.select(*names, "n_pairs", "n_ties", F.round("ties_pct", 6).alias("ties_pct"), F.col("statistic").cast("double").alias("statistic"), F.round("mean_diff", 6).alias("mean_diff"))


@query("WITH " + _RUNS + ", p AS (SELECT a.doc AS a_doc, a.query AS a_query, b.doc AS b_doc, b.query AS b_query, a.v AS a, b.v AS b FROM q a JOIN q b ON a.id = b.id AND (a.doc, a.query) < (b.doc, b.query))" + _SIGNED.format(g="a_doc, a_query, b_doc, b_query"))
def wilcoxon_all_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every two configurations over common keys, at least five."""
    out = stats.wilcoxon_of_configurations(_runs(spark, d), ["doc", "query"], "id", "v")
    return _tested(out, "a_doc", "a_query", "b_doc", "b_query")


@query("WITH " + _RUNS + ", p AS (SELECT b.doc AS b_doc, b.query AS b_query, a.v AS a, b.v AS b FROM q a JOIN q b ON a.id = b.id AND a.doc = '1' AND a.query = 'A' AND NOT (b.doc = '1' AND b.query = 'A'))" + _SIGNED.format(g="b_doc, b_query"))
def wilcoxon_baseline(spark: SparkSession, d: str) -> DataFrame:
    out = stats.wilcoxon_of_configurations(_runs(spark, d), ["doc", "query"], "id", "v", {"doc": "1", "query": "A"})
    return _tested(out, "b_doc", "b_query")


@query("""
WITH g AS (SELECT l_orderkey AS g, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS DOUBLE) AS position, floor(l_quantity / 10) AS score FROM lineitem),
a AS (SELECT position, rank() OVER (PARTITION BY g ORDER BY score DESC) + (count(*) OVER (PARTITION BY g, score) - 1) / 2.0 AS auto FROM g),
r AS (SELECT rank() OVER (ORDER BY auto) + (count(*) OVER (PARTITION BY auto) - 1) / 2.0 AS ra, rank() OVER (ORDER BY position) + (count(*) OVER (PARTITION BY position) - 1) / 2.0 AS rb FROM a)
SELECT count(*) AS n, round(corr(ra, rb), 6) AS rho FROM r
""")
def pooled_spearman(spark: SparkSession, d: str) -> DataFrame:
    """Ranks by quantity within orders against the places of the lines, over all orders together."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity")  # an order's few lines
    rows = table(spark, d, "lineitem").select("l_orderkey", F.row_number().over(w).alias("position"), F.floor(F.col("l_quantity") / 10).cast("double").alias("score"))
    return stats.pooled_spearman(rows, "l_orderkey").select("n", F.round("rho", 6).alias("rho"))


@query("""
WITH g AS (SELECT l_orderkey, CAST(l_orderkey % 2 AS VARCHAR) AS doc_db, CASE l_orderkey % 3 WHEN 0 THEN 'base' ELSE 'legal' END AS query_embedding, list_slice(list(l_partkey % 40 ORDER BY l_linenumber, l_partkey), 1, 7) AS f, list_distinct(list(l_suppkey % 40) FILTER (l_quantity > 5)) AS gold0 FROM lineitem GROUP BY 1, 2, 3),
k AS (SELECT g.*, coalesce(gold0, []) AS gold, k FROM g, (VALUES (2), (5)) t(k)), h AS (SELECT *, list_slice(f, 1, k) AS ff FROM k),
m AS (SELECT *, len(list_intersect(list_distinct(ff), gold)) / len(list_distinct(ff)) AS p, CASE WHEN len(gold) = 0 THEN 0.0 ELSE len(list_intersect(list_distinct(ff), gold)) / len(gold) END AS r,
 coalesce(1.0 / list_min(list_filter(list_transform(ff, lambda x, i: CASE WHEN list_contains(gold, x) THEN i END), lambda z: z IS NOT NULL)), 0) AS rr,
 CASE WHEN len(gold) = 0 THEN 0.0 ELSE list_sum(list_transform(ff, lambda x, i: CASE WHEN list_contains(gold, x) THEN 1.0 / log2(i + 1) ELSE 0.0 END)) / list_sum(list_transform(range(1, least(len(gold), k) + 1), lambda i: 1.0 / log2(i + 1))) END AS nd FROM h)
SELECT doc_db, query_embedding, CAST(k AS INTEGER) AS k, count(*) AS n_questions, count(*) FILTER (len(gold) > 0) AS n_recall, round(avg(p), 6) AS p, round(avg(r), 6) AS r, round(avg(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END), 6) AS f1, round(avg(rr), 6) AS mrr, round(avg(nd), 6) AS ndcg FROM m GROUP BY 1, 2, 3
""")
def eval_full(spark: SparkSession, d: str) -> DataFrame:
    """Five metrics at two k by (doc_db, query_embedding); some questions have no gold."""
    l = table(spark, d, "lineitem")
    runs = l.groupBy("l_orderkey").agg(
        F.slice(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"] % 40), 1, 7).alias("found"), F.collect_set(F.when(F.col("l_quantity") > 5, F.col("l_suppkey") % 40)).alias("gold"),
    )
    runs = runs.select((F.col("l_orderkey") % 2).cast("string").alias("doc_db"), F.when(F.col("l_orderkey") % 3 == 0, "base").otherwise("legal").alias("query_embedding"), "found", "gold")
    out = evaluate(runs, ["doc_db", "query_embedding"], (2, 5))
    rows = [F.struct(F.lit(k).alias("k"), *[F.round(F.col(f"`{m}@{k}`"), 6).alias(n) for m, n in (("precision", "p"), ("recall", "r"), ("f1", "f1"), ("mrr", "mrr"), ("ndcg", "ndcg"))]) for k in (2, 5)]
    return out.select("doc_db", "query_embedding", "n_questions", "n_recall", F.explode(F.array(*rows)).alias("x")).select("doc_db", "query_embedding", "n_questions", "n_recall", "x.*")


# ---- parsers and model pipelines (with the deterministic provider)


# pages and guides are built from the lines of orders, with a headline of each kind between them
_HEADS = (
    ("<h3>Conventional head</h3>", "Conventional head", "headings"), ("<p>CAPITAL HEAD</p>", "CAPITAL HEAD", "caps"), ("<p><b>Bold head</b> <strong>line</strong></p>", "Bold head line", "bold"),
    ('<p style="font-size:9pt">SMALL CAPITALS STAY</p>', "SMALL CAPITALS STAY", ""), ('<p style="font: 9pt serif"><b>Small bold stays</b></p>', "Small bold stays", ""), ('<p style="font-size:18px">Larger line</p>', "Larger line", "size"),
)
_LINES = "l AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS n, l_partkey, CAST(l_partkey % 6 AS INTEGER) AS k FROM lineitem)"
_COUNTED = ", ".join(f"count(*) FILTER (k = {i}) AS {kind}" for i, (_, _, kind) in enumerate(_HEADS) if kind)
_REPORT = f"WITH {_LINES}, r AS (SELECT l_orderkey, {_COUNTED}, count(*) + count(*) FILTER (k <> 0) AS paragraphs FROM l GROUP BY 1), d AS (SELECT *, size > 0.3 * paragraphs AS doubtful FROM r)"


def _pages(spark: SparkSession, d: str) -> DataFrame:
    head = F.element_at(F.array(*(F.lit(h) for h, _, _ in _HEADS)), (F.col("l_partkey") % 6).cast("int") + 1)
    line = F.struct("l_linenumber", "l_partkey", head.alias("head"))
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("ls"))
    body = F.transform("ls", lambda x, i: F.concat(F.lit("<p>\n"), (i + 1).cast("string"), F.lit(". Part "), x["l_partkey"].cast("string"), F.lit(" was\xa0<i>sold</i>.</p>"), x["head"]))
    return g.select("l_orderkey", F.concat(F.lit("<style>b {color:red}</style><body>Court "), F.array_join(body, "")).alias("html"))


@query(_REPORT + ", t AS (SELECT l_orderkey, n, l_partkey, CASE k " + " ".join(f"WHEN {i} THEN CASE WHEN doubtful OR {str(not kind).upper()} THEN ' {text}' ELSE '' END" for i, (_, text, kind) in enumerate(_HEADS)) + " END AS rest FROM l JOIN d USING (l_orderkey)) SELECT l_orderkey, CAST(n AS INTEGER) AS paragraph_number, n || '. Part ' || l_partkey || ' was sold .' || rest AS paragraph_text FROM t")
def judgment_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return html_paragraphs(_pages(spark, d), "l_orderkey", "html", scanned=False)


@query(_REPORT + " SELECT l_orderkey, " + ", ".join(f"CAST({c} AS INTEGER) AS {c}" for c in ("headings", "caps", "bold", "size", "paragraphs")) + ", doubtful FROM d")
def judgment_headlines(spark: SparkSession, d: str) -> DataFrame:
    return headline_report(_pages(spark, d), "l_orderkey", "html", scanned=False)


@query(f"""WITH {_LINES} SELECT 'g' || l_orderkey || CASE l_orderkey % 2 WHEN 0 THEN '_eng' ELSE '_fre' END AS guide_id, CAST(n AS INTEGER) AS paragraph_id,
 'Part ' || l_partkey || ' was sold' || CASE n WHEN 1 THEN ', as in 1. above' ELSE '' END || CASE l_partkey % 3 WHEN 0 THEN ' <sup>' || n || '</sup>' || chr(10) || '<sup>' || n || '</sup> Note ' || l_partkey ELSE '' END AS paragraph FROM l""")
def guide_texts(spark: SparkSession, d: str) -> DataFrame:
    """Guides with headings, page marks, footnotes and, in those of one language, a start string and rules of their own."""
    part = F.col("l_partkey").cast("string")
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", part.alias("p")))).alias("ls"))
    english, number = F.col("l_orderkey") % 2 == 0, lambda i: (i + 1).cast("string")
    line = lambda x, i: F.concat(
        F.when(i == 0, "").when(i % 3 == 2, F.concat(F.lit("\n- "), number(i), F.lit("."))).otherwise(F.concat(F.lit("\n"), number(i), F.lit(". "))),
        F.when((i == 0) & ~english, F.concat(F.lit(" "), x["p"])).otherwise(F.concat(F.lit("Part "), x["p"])), F.lit(" was\xa0 sold"), F.when(i == 0, ", as in 1. above").otherwise(""),
        F.when(x["l_partkey"] % 3 == 0, F.concat(F.lit(" <sup>"), number(i), F.lit("</sup>\n  <sup>"), number(i), F.lit("</sup> Note "), x["p"])).otherwise(""),
        F.lit("\n## Heading 9. of it\n<span id=\"page-1\"></span>\n"), F.when(english, "").otherwise("Pied de page 77. ici\n"),
    )
    start = F.when(english, "1. no\nHUDOC keywords\nkey\n1. ").otherwise("Avant\n1. Part")
    end = F.when(english, "\nList of cited cases\n8. no").otherwise("\nListe des affaires citées\n8. no")
    texts = g.select(F.concat(F.lit("g"), F.col("l_orderkey").cast("string"), F.when(english, "_eng").otherwise("_fre")).alias("guide_id"), F.concat(start, F.array_join(F.transform("ls", line), ""), end).alias("text"))
    french = texts.where("endswith(guide_id, '_fre')").select("guide_id")
    told = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(i).alias("ord"), F.lit(p).alias("pattern"), F.lit("").alias("replacement")) for i, (k, p) in enumerate((("start", "1. Part"), ("remove", "^Pied de page.*$")))))
    rules = french.select("guide_id", F.explode(told).alias("x")).select("guide_id", "x.*")
    return parse_guides(texts, rules)


def qa_groups(extractions: DataFrame) -> DataFrame:
    """Groups of up to three consecutive paragraphs of a guide: guide_id, group_id, paragraphs, citations (as the answer prompt names them, equivalent ones once).

    Paragraphs whose citations are null or unreadable have none.
    """
    e = sinks.latest(extractions.select("guide_id", "paragraph_id", "paragraph_text", "citations", "updated_at"), ["guide_id", "paragraph_id"], "updated_at", "citations")
    e = e.select("guide_id", F.col("paragraph_id").try_cast("int").alias("pid"), "paragraph_text", "citations").where("guide_id IS NOT NULL AND pid IS NOT NULL AND paragraph_text IS NOT NULL")
    g = e.groupBy("guide_id", F.floor(F.col("pid") / 3).cast("int").alias("group_id")).agg(F.sort_array(F.collect_list(F.struct("pid", "paragraph_text", "citations"))).alias("rows"))
    lists = F.flatten(F.transform("rows", lambda x: F.flatten(F.filter(F.coalesce(C.citation_lists(x["citations"]), F.array().cast(f"array<array<{C.CITATION}>>")), lambda c: c.isNotNull()))))
    told = F.transform(F.filter(lists, lambda c: c.isNotNull()), lambda c: F.struct(F.coalesce(c["citation_paragraphs"], F.array().cast("array<string>")).alias("pars"), C.ids_of(c).alias("ids"), C.citation_string(c).alias("named")))
    return g.select("guide_id", "group_id", F.transform("rows", lambda x: x["paragraph_text"]).alias("paragraphs"), F.transform(C.merged(told), lambda c: c["named"]).alias("citations"))


@query()
def qa_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Groups of up to three consecutive paragraphs of a guide, with the citations extracted from them."""
    return qa_pairs(qa_groups(table(spark, d, "citation_extractions")), FakeProvider()).select("guide_id", "group_id", "question", F.size("facts").alias("n_facts"), "quality", "grounded")


@query()
def rag_pipeline(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.concat(F.lit("Passage of label "), F.col("label").cast("string")).alias("text"))
    q = v.where("id % 50 = 0").select("id", F.concat(F.lit("What about "), F.col("id").cast("string"), F.lit("?")).alias("question"), "embedding")
    out = rag_answers(q, v, FakeProvider())
    return out.select("id", F.posexplode("sentences").alias("n", "s")).select("id", "n", "s.sentence", F.array_join(F.col("s.citations").cast("array<string>"), ",").alias("citations"))


@query()
def judge_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Rows by metric and score. The answers, as gold, against their paragraphs as the generated text, which cites of each citation the first paragraph that the judgements have."""
    key = ["guide_id", "group_id", "grouping_method", "model_name"]
    once = table(spark, d, "question_generations").groupBy(*key).agg(F.min(F.struct("question", "answer", "paragraphs")).alias("q"))
    rows = stored(once.select(F.to_json(F.struct(*key)).alias("id"), "q.question", F.col("q.answer").alias("target_answer"), F.col("q.paragraphs").alias("generated_answer")))
    judgements = table(spark, d, "judgements")
    facts = rows.select("id", F.posexplode(F.from_json("target_answer", f"array<struct<text:string,citations:array<{C.CITATION}>>>")).alias("n", "f"))
    cited = facts.select("id", "n", F.col("f.text").alias("sentence"), F.posexplode_outer("f.citations").alias("k", "c")).select("id", "n", "sentence", "k", F.try_element_at("c.multilingual", F.lit("eng"))["id"].alias("case_id"), F.explode_outer("c.citation_paragraphs").alias("paragraph_number")).withColumn("paragraph_number", F.col("paragraph_number").try_cast("int"))
    texts = judgements.groupBy("case_id", "paragraph_number").agg(F.min("paragraph_text").alias("paragraph_text"))
    there = cited.join(texts, ["case_id", "paragraph_number"], "left")
    first = there.groupBy("id", "n", "sentence", "k").agg(F.min(F.when(F.col("paragraph_text").isNotNull(), F.struct("paragraph_number", "case_id", "paragraph_text"))).alias("p"))
    said = first.groupBy("id", "n", "sentence").agg(F.sort_array(F.collect_list(F.when(F.col("p").isNotNull(), F.struct("k", "p")))).alias("cs"))
    whole = said.groupBy("id").agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("n", "sentence", "cs"))), lambda s: F.struct(s["sentence"].alias("sentence"), F.transform(s["cs"], lambda c: c["p"]).alias("citations")))).alias("generated_citations"))
    out = scored(stored(rows.join(whole, "id", "left")), judgements, FakeProvider())
    metrics = ["llm_claim_recall", "llm_faithfulness", "llm_citation_correctness", "llm_citation_semantic_similarity"]
    return out.select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("score")) for m in metrics))).alias("x")).groupBy("x.metric", "x.score").agg(F.count("*").alias("n"))
