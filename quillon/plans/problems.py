"""Queries of the data-preparation operators of the core, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.nested import lowest_children, node_table
from ..operators.orphans import orphan_references, orphans_by_period
from ..session import table


# an answer or list unwrapped from the strings it is in, if it is readable
_UNWRAP = "CASE WHEN json_valid({0}) THEN CASE WHEN json_type(json({0})) = 'VARCHAR' THEN CASE WHEN json_valid(json({0}) ->> '$') THEN json(json({0}) ->> '$') END ELSE json({0}) END END"
_LIST = "CASE json_type({0}) WHEN 'ARRAY' THEN from_json({0}, '[\"JSON\"]') WHEN 'OBJECT' THEN [{0}] ELSE [] END"
_YEAR = "coalesce(CASE json_type(json_extract(c, '$.citation_year')) WHEN 'BOOLEAN' THEN '' ELSE json_extract_string(c, '$.citation_year') END, '')"
#: Citations (k0 to k3, fact_pos, citation_pos, c) of distinct answers, and of their language versions (lang, id).
_CITED = f"""
a AS (SELECT DISTINCT guide_id AS k0, group_id AS k1, grouping_method AS k2, model_name AS k3, {_UNWRAP.format("answer")} AS j FROM question_generations WHERE guide_id IS NOT NULL AND group_id IS NOT NULL AND grouping_method IS NOT NULL AND model_name IS NOT NULL),
u AS (SELECT k0, k1, k2, k3, CASE WHEN json_type(j) = 'OBJECT' AND json_exists(j, '$.facts') THEN json_extract(j, '$.facts') ELSE j END AS j FROM a WHERE j IS NOT NULL),
fl AS (SELECT k0, k1, k2, k3, {_LIST.format("j")} AS fs FROM u), f AS (SELECT k0, k1, k2, k3, generate_subscripts(fs, 1) - 1 AS fact_pos, unnest(fs) AS f FROM fl),
cl AS (SELECT k0, k1, k2, k3, fact_pos, {_LIST.format("json_extract(f, '$.citations')")} AS cs FROM f WHERE json_type(f) = 'OBJECT'), c AS (SELECT k0, k1, k2, k3, fact_pos, generate_subscripts(cs, 1) - 1 AS citation_pos, unnest(cs) AS c FROM cl),
m AS (SELECT k0, k1, k2, k3, fact_pos, citation_pos, json_extract(c, '$.multilingual') AS m, {_YEAR} AS y FROM c WHERE json_type(c) = 'OBJECT'),
mo AS (SELECT k0, k1, k2, k3, fact_pos, citation_pos, y, m, unnest(json_keys(m)) AS lang FROM m WHERE json_type(m) = 'OBJECT'), mv AS (SELECT k0, k1, k2, k3, fact_pos, citation_pos, y, lang, json_extract(m, '$."' || lang || '"') AS v FROM mo),
ml AS (SELECT k0, k1, k2, k3, fact_pos, citation_pos, y, unnest(from_json(m, '["JSON"]')) AS v FROM m WHERE json_type(m) = 'ARRAY'),
v AS (SELECT k0, k1, k2, k3, fact_pos, citation_pos, y, lang, CASE json_type(v) WHEN 'OBJECT' THEN json_extract_string(v, '$.id') WHEN 'VARCHAR' THEN v ->> '$' END AS id FROM mv
 UNION ALL SELECT k0, k1, k2, k3, fact_pos, citation_pos, y, json_extract_string(v, '$.lang'), json_extract_string(v, '$.id') FROM ml WHERE json_type(v) = 'OBJECT')
"""
_CHILDREN = f"""WITH {_CITED},
p AS (SELECT k0, k1, k2, k3, fact_pos, citation_pos, unnest(CASE json_type(json_extract(c, '$.citation_paragraphs')) WHEN 'ARRAY' THEN from_json(json_extract(c, '$.citation_paragraphs'), '["VARCHAR"]') ELSE [json_extract_string(c, '$.citation_paragraphs')] END) AS t FROM c WHERE json_type(c) = 'OBJECT'),
i AS (SELECT k0, k1, k2, k3, fact_pos, citation_pos, string_split_regex(trim(unnest(string_split(replace(replace(replace(t, ';', ','), '–', '-'), '—', '-'), ','))), ' *- *') AS e FROM p WHERE t IS NOT NULL),
n AS (SELECT k0, k1, k2, k3, fact_pos, citation_pos, CAST(unnest(range(TRY_CAST(e[1] AS BIGINT), TRY_CAST(e[-1] AS BIGINT) + 1)) AS VARCHAR) AS key FROM i WHERE len(e) <= 2 AND regexp_full_match(e[1], '[0-9]+(\\.0)?') AND regexp_full_match(e[-1], '[0-9]+(\\.0)?'))
SELECT DISTINCT k0 AS guide_id, k1 AS group_id, k2 AS grouping_method, k3 AS model_name, CAST(fact_pos AS INTEGER) AS fact_pos, CAST(citation_pos AS INTEGER) AS citation_pos, kind AS child_kind, lang AS child_lang, key AS child_key FROM
 (SELECT k0, k1, k2, k3, fact_pos, citation_pos, 'language' AS kind, lower(trim(lang)) AS lang, trim(id) AS key FROM v WHERE trim(id) <> '' AND lang IS NOT NULL UNION ALL SELECT k0, k1, k2, k3, fact_pos, citation_pos, 'paragraph', '', key FROM n)
"""
NORMAL_URL = """CASE WHEN contains({0}, '?i=') OR NOT contains({0}, '#') THEN {0} ELSE coalesce('https://' || nullif(regexp_extract({0}, '^[a-z]+://([^/#?]+)/+([^/#?]+)', 1), '') || '/' || nullif(regexp_extract({0}, '^[a-z]+://([^/#?]+)/+([^/#?]+)', 2), '') || '?i=' ||
 nullif(regexp_extract(url_decode(substr({0}, strpos({0}, '#') + 1)), '(?:itemid|ItemId|ITEMID)"?\\s*:\\s*\\[\\s*"([^"]*)"[^\\]]*\\]', 1), ''), {0}) END"""
_MISSING = f"""WITH {_CITED},
e0 AS (SELECT guide_id, paragraph_id, updated_at, citations FROM citation_extractions WHERE guide_id IS NOT NULL AND paragraph_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY guide_id, paragraph_id ORDER BY updated_at DESC NULLS LAST, citations DESC NULLS LAST) = 1),
e1 AS (SELECT guide_id, paragraph_id, updated_at, unnest(from_json(json(citations), '["JSON"]')) AS y FROM e0 WHERE json_valid(citations) AND json_type(json(citations)) = 'ARRAY'), e2 AS (SELECT guide_id, paragraph_id, updated_at, unnest({_LIST.format("y")}) AS c FROM e1),
e AS (SELECT * FROM e2 WHERE json_type(c) = 'OBJECT'), ev AS (SELECT guide_id, paragraph_id, updated_at, json_extract(c, '$.multilingual') AS m FROM e), ek AS (SELECT *, unnest(json_keys(m)) AS lang FROM ev WHERE json_type(m) = 'OBJECT'),
ei AS (SELECT guide_id, paragraph_id, updated_at, json_extract(m, '$."' || lang || '"') AS v FROM ek UNION ALL SELECT guide_id, paragraph_id, updated_at, unnest(from_json(m, '["JSON"]')) FROM ev WHERE json_type(m) = 'ARRAY'),
refs AS (SELECT 'question_generations' AS src_table, k0 AS guide_id, CAST(k1 AS VARCHAR) AS unit_id, k2 AS grouping_method, k3 AS model_name, 'multilingual' AS ref_field, trim(id) AS ref_key, NULL::TIMESTAMP AS t, y AS period FROM v WHERE lang IS NOT NULL
 UNION ALL SELECT 'question_generations', k0, CAST(k1 AS VARCHAR), k2, k3, 'original_url', coalesce(nullif(trim(json_extract_string(c, '$.original_url')), ''), json_extract_string(c, '$.citation_url')), NULL, {_YEAR} FROM c WHERE json_type(c) = 'OBJECT'
 UNION ALL SELECT 'citation_extractions', guide_id, paragraph_id, '', '', 'multilingual', trim(CASE json_type(v) WHEN 'OBJECT' THEN json_extract_string(v, '$.id') WHEN 'VARCHAR' THEN v ->> '$' END), updated_at, coalesce(strftime(updated_at, '%Y-%m'), '') FROM ei
 UNION ALL SELECT 'citation_extractions', guide_id, paragraph_id, '', '', 'original_url', coalesce(nullif(trim(json_extract_string(c, '$.original_url')), ''), json_extract_string(c, '$.citation_url')), updated_at, coalesce(strftime(updated_at, '%Y-%m'), '') FROM e),
r AS (SELECT DISTINCT src_table, guide_id, unit_id, grouping_method, model_name, ref_field, CASE WHEN ref_field = 'original_url' THEN {NORMAL_URL.format("ref_key")} ELSE ref_key END AS ref_key, t, period FROM refs WHERE trim(ref_key) <> ''),
urls AS (SELECT url, CASE WHEN count(*) = count(created_at) THEN min(created_at) END AS first_at FROM meta_cache WHERE url IS NOT NULL GROUP BY 1), ids AS (SELECT trim(_id) AS id, bool_and(coalesce(lower(trim(isplaceholder)) = 'true', false)) AS gone FROM echr_documents WHERE _id IS NOT NULL GROUP BY 1),
s AS (SELECT r.*, CASE WHEN ref_field = 'original_url' THEN CASE WHEN url IS NULL THEN 'missing' WHEN first_at > t THEN 'late' END ELSE CASE WHEN id IS NULL THEN 'missing' WHEN gone THEN 'deleted' END END AS status FROM r LEFT JOIN urls ON ref_field = 'original_url' AND url = ref_key LEFT JOIN ids ON ref_field = 'multilingual' AND id = ref_key)
"""
_COLUMNS = "src_table, guide_id, unit_id, grouping_method, model_name, ref_field, ref_key, status"


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return orphan_references(*(table(spark, d, t) for t in ("question_generations", "citation_extractions", "meta_cache", "echr_documents")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).drop("period").distinct()


def p3_by_period(spark: SparkSession, d: str) -> DataFrame:
    return orphans_by_period(_orphans(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return lowest_children(table(spark, d, "question_generations"))


def p4_nodes(spark: SparkSession, d: str) -> DataFrame:
    key = ["guide_id", "group_id", "grouping_method", "model_name"]
    rows = table(spark, d, "question_generations").groupBy(*key).agg(F.min("answer").alias("answer"))
    return node_table(rows, key, "answer")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p3_found, p3_by_period, p4_found, p4_nodes)}


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that can be told in it; p4_nodes is rebuilt to its documents in the tests."""
    return {
        "p3_found": _MISSING + f"SELECT DISTINCT {_COLUMNS} FROM s WHERE status IS NOT NULL", "p4_found": _CHILDREN,
        "p3_by_period": _MISSING + f"SELECT src_table, period, ref_field, status, count(*) AS n FROM (SELECT DISTINCT {_COLUMNS}, period FROM s WHERE status IS NOT NULL) GROUP BY 1, 2, 3, 4",
    }
