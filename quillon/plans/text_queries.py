"""Text, URL, JSON and array functions over the tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.urls import normal_url, normal_urls
from ..operators import citations as C
from ..operators.guides import split_paragraphs
from ..session import table
from .problems import NORMAL_URL

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
SELECT doc_id, array_to_string(list_sort(list_distinct(flatten(list_transform(flatten(list_transform(regexp_extract_all(text, ' ?\\[\\d+(?:-\\d+)?(?:, ?\\d+(?:-\\d+)?)*\\]'), lambda g: regexp_extract_all(g, '\\d+(?:-\\d+)?'))),
  lambda i: CASE WHEN contains(i, '-') THEN (CASE WHEN length(i) > 18 THEN []::BIGINT[] ELSE range(CAST(split_part(i, '-', 1) AS BIGINT), CAST(split_part(i, '-', 2) AS BIGINT) + 1) END) ELSE [CAST(i AS BIGINT)] END)))), ',') AS numbers,
  length(regexp_replace(text, ' ?\\[\\d+(?:-\\d+)?(?:, ?\\d+(?:-\\d+)?)*\\]', '', 'g')) AS n_left
FROM documents WHERE regexp_matches(text, '\\[\\d+(?:-\\d+)?(?:, ?\\d+(?:-\\d+)?)*\\]')
""")
def bracket_citations(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where(F.col("text").rlike(r"\[\d+(?:-\d+)?(?:, ?\d+(?:-\d+)?)*\]"))
    return docs.select("doc_id", F.array_join(X.bracket_numbers(F.col("text")).cast("array<string>"), ",").alias("numbers"), F.length(X.without_brackets(F.col("text"))).cast("bigint").alias("n_left"))


@query("""
WITH s AS (SELECT l_orderkey, l_linenumber, 'Holds [Doc ' || (l_partkey % 9 + 1) || ', ' || (l_suppkey % 7 + 1) || ' and ' || (l_linenumber % 5 + 1) || '] [' || (l_partkey % 4) || '-' || (l_linenumber % 6) || '].' AS t FROM lineitem),
n AS (SELECT *, replace(replace(t, ', and', ','), ' and', ',') AS u FROM s)
SELECT l_orderkey, l_linenumber, array_to_string(list_sort(list_distinct(flatten(list_transform(flatten(list_transform(list_concat(regexp_extract_all(u, 'Doc\\s(\\d+(?:-\\d+)?(?:,\\s\\d+)*)', 1), regexp_extract_all(u, '\\[(\\d+(?:-\\d+)?(?:,\\s\\d+)*)\\]', 1)), lambda g: string_split(g, ', '))),
  lambda i: CASE WHEN contains(i, '-') THEN range(CAST(split_part(i, '-', 1) AS BIGINT), CAST(split_part(i, '-', 2) AS BIGINT) + 1) ELSE [CAST(i AS BIGINT)] END)))), ',') AS numbers,
  regexp_replace(t, ' \\[.*?\\]', '', 'g') AS bare
FROM n
""")
def doc_citations(spark: SparkSession, d: str) -> DataFrame:
    t = F.concat(F.lit("Holds [Doc "), (F.col("l_partkey") % 9 + 1).cast("string"), F.lit(", "), (F.col("l_suppkey") % 7 + 1).cast("string"), F.lit(" and "), (F.col("l_linenumber") % 5 + 1).cast("string"), F.lit("] ["), (F.col("l_partkey") % 4).cast("string"), F.lit("-"), (F.col("l_linenumber") % 6).cast("string"), F.lit("]."))
    s = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", t.alias("t"))
    return s.select("l_orderkey", "l_linenumber", F.array_join(X.doc_numbers(F.col("t")).cast("array<string>"), ",").alias("numbers"), X.without_citations(F.col("t")).alias("bare"))


@query("""
WITH a AS (SELECT l_orderkey, string_agg('Line ' || l_linenumber || ' holds [' || (l_partkey % 4 + 1) || '].', ' ' ORDER BY l_linenumber) AS answer FROM lineitem GROUP BY 1),
p AS (SELECT l_orderkey, unnest(string_split(replace(answer, '].', '].' || chr(1)), chr(1))) AS s FROM a)
SELECT l_orderkey, regexp_replace(trim(s), ' ?\\[\\d+(?:-\\d+)?(?:, ?\\d+(?:-\\d+)?)*\\]', '', 'g') AS fact, regexp_extract(s, '\\[(\\d+)\\]', 1) AS numbers FROM p WHERE trim(s) <> ''
""")
def fact_split(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat(F.lit("Line "), F.col("l_linenumber").cast("string"), F.lit(" holds ["), (F.col("l_partkey") % 4 + 1).cast("string"), F.lit("]."))
    a = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", line.alias("s")))), lambda x: x["s"]), " ").alias("answer"))
    f = a.select("l_orderkey", F.explode(X.facts_of(F.col("answer"))).alias("f"))
    return f.select("l_orderkey", F.col("f.text").alias("fact"), F.array_join(F.col("f.numbers").cast("array<string>"), ",").alias("numbers"))


@query("""
SELECT group_id, guide_id, model_name, CASE group_id % 3 WHEN 0 THEN split_part(question, '?', 1) || '?' WHEN 1 THEN split_part(question, '?', 1) || '?' ELSE split_part(question, '?', 1) || '?' END AS asked
FROM (SELECT DISTINCT group_id, guide_id, model_name, trim(question) AS question FROM question_generations WHERE trim(question) <> '')
""")
def question_extract(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "question_generations").where("trim(question) <> ''").select("group_id", "guide_id", "model_name", F.trim("question").alias("question")).distinct()
    reply = F.when(F.col("group_id") % 3 == 0, F.concat(F.lit("Thinking.\n**Question:** "), "question", F.lit(" More?"))).when(F.col("group_id") % 3 == 1, F.concat(F.lit("Question:\n"), "question", F.lit("\nend"))).otherwise(F.col("question"))
    return q.select("group_id", "guide_id", "model_name", X.question_of(reply).alias("asked"))


@query("""
WITH u AS (SELECT DISTINCT unnest(regexp_extract_all(citations, '"original_url": "((?:[^"\\\\]|\\\\.)*)"', 1)) AS raw FROM citation_extractions),
v AS (SELECT replace(raw, '\\"', '"') AS url FROM u),
w AS (SELECT url, CASE WHEN contains(url, '?i=') OR NOT contains(url, '#') THEN NULL ELSE url_decode(substr(url, strpos(url, '#') + 1)) END AS frag FROM v),
x AS (SELECT url, CASE WHEN frag IS NULL THEN NULL WHEN starts_with(frag, '{') AND ends_with(frag, '}') THEN frag ELSE '{' || trim(frag, '{} ') || '}' END AS js FROM w),
y AS (SELECT url, CASE WHEN js IS NOT NULL AND json_valid(js) THEN coalesce(json_extract_string(js, '$.itemid[0]'), json_extract_string(js, '$.ItemId[0]'), json_extract_string(js, '$.ITEMID[0]')) END AS item FROM x),
z AS (SELECT url, CASE WHEN item IS NULL THEN url ELSE 'https://' || regexp_extract(url, '^[a-z]+://([^/#?]+)/+([^/#?]+)', 1) || '/' || regexp_extract(url, '^[a-z]+://([^/#?]+)/+([^/#?]+)', 2) || '?i=' || item END AS normal FROM y)
SELECT url, normal, CASE WHEN contains(normal, '?i=') THEN split_part(split_part(normal, '?i=', 2), '&', 1) ELSE split_part(normal, '&', 1) END AS case_id FROM z
""")
def url_normalise(spark: SparkSession, d: str) -> DataFrame:
    urls = table(spark, d, "citation_extractions").select(F.explode(F.regexp_extract_all("citations", F.lit(r'"original_url": "((?:[^"\\]|\\.)*)"'), 1)).alias("raw")).distinct()
    urls = urls.select(F.replace("raw", F.lit('\\"'), F.lit('"')).alias("url"))
    normal = urls.withColumn("normal", normal_url(F.col("url")))
    return normal.withColumn("case_id", X.case_id_of(F.col("normal")))


@query("SELECT event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) % 10 AS bucket, count(*) AS n, round(avg(CAST(json_extract_string(props, '$.k') AS DOUBLE)), 6) AS mean_k FROM events GROUP BY 1, 2")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    k = F.from_json("props", "k int")["k"]
    return table(spark, d, "events").select("event_type", k.alias("k")).groupBy("event_type", (F.col("k") % 10).alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg(F.col("k").cast("double")), 6).alias("mean_k"))


@query("""
WITH w AS (SELECT doc_id, string_split(text, ' ') AS ws FROM documents WHERE text IS NOT NULL),
n AS (SELECT doc_id, ws, len(ws) AS n, CASE WHEN len(ws) <= 64 THEN 0 ELSE CAST(ceil((len(ws) - 64) / 48.0) AS INTEGER) END AS last FROM w),
c AS (SELECT doc_id, ws, unnest(range(0, last + 1)) AS chunk FROM n)
SELECT doc_id, CAST(chunk AS INTEGER) AS chunk, CAST(len(ws[chunk * 48 + 1 : chunk * 48 + 64]) AS INTEGER) AS n_words, md5(array_to_string(ws[chunk * 48 + 1 : chunk * 48 + 64], ' ')) AS hash FROM c
""")
def chunk_stride(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(X.chunks(F.split("text", " "), 64, 48)).alias("chunk", "words"))
    return w.select("doc_id", "chunk", F.size("words").alias("n_words"), F.md5(F.array_join("words", " ")).alias("hash"))


@query("""
WITH o AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
SELECT user_id, count(*) AS n_runs, count(*) FILTER (event_type = 'error') AS n_errors FROM o WHERE before IS NULL OR before <> event_type GROUP BY 1
""")
def consecutive_dedupe(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").select("user_id", "event_type", F.lag("event_type").over(w).alias("before"))
    return e.where("before IS NULL OR before <> event_type").groupBy("user_id").agg(F.count("*").alias("n_runs"), F.count_if(F.col("event_type") == "error").alias("n_errors"))


@query("""
SELECT doc_id, len(l) AS n_lines, md5(array_to_string(l, chr(10))) AS hash FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda s: regexp_replace(s, '^[\\s\\x{00A0}\\x{0085}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{1680}\\x0B]+|[\\s\\x{00A0}\\x{0085}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{1680}\\x0B]+$', '', 'g')), lambda s: s <> '') AS l FROM documents WHERE text IS NOT NULL)
""")
def line_split(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", X.lines(F.col("text")).alias("l"))
    return t.select("doc_id", F.size("l").cast("bigint").alias("n_lines"), F.md5(F.array_join("l", "\n")).alias("hash"))


@query("""
SELECT case_id, paragraph_number, md5(content) AS hash, replace(content, case_name || '; § ' || paragraph_number || ': ', '') AS bare FROM (
SELECT DISTINCT case_id, case_name, paragraph_number, case_name || '; § ' || paragraph_number || ': ' || trim(replace(paragraph_text, paragraph_number || '.', '')) AS content FROM judgements WHERE case_name IS NOT NULL AND paragraph_text IS NOT NULL AND paragraph_number IS NOT NULL)
""")
def page_contents(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "judgements").where("case_name IS NOT NULL AND paragraph_text IS NOT NULL AND paragraph_number IS NOT NULL")
    j = j.select("case_id", "case_name", "paragraph_number", X.page_content(F.col("case_name"), F.col("paragraph_number"), F.col("paragraph_text")).alias("content")).distinct()
    return j.select("case_id", "paragraph_number", F.md5("content").alias("hash"), X.without_prefix(F.col("content"), F.col("case_name"), F.col("paragraph_number")).alias("bare"))


@query("""
WITH g AS (SELECT l_orderkey, list('part ' || l_partkey ORDER BY l_linenumber, 'part ' || l_partkey) AS s FROM lineitem GROUP BY 1)
SELECT l_orderkey, array_to_string(list_transform(s, lambda x, i: '[' || i || ']: ' || x), chr(10)) AS numbered, array_to_string(list_transform(s, lambda x, i: '[Doc ' || i || ']: ' || x), chr(10)) AS docs,
'Answer in ENGLISH: ' || s[1] AS prompt, sha256('sys' || s[1]) AS prompt_hash FROM g
""")
def prompt_strings(spark: SparkSession, d: str) -> DataFrame:
    part = F.concat(F.lit("part "), F.col("l_partkey").cast("string"))
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", part.alias("p")))), lambda x: x["p"]).alias("s"))
    first = F.get("s", F.lit(0))
    return g.select("l_orderkey", X.numbered(F.col("s")).alias("numbered"), X.numbered(F.col("s"), "Doc").alias("docs"), X.filled("Answer in LANG: {x}".replace("LANG", "English".upper()), x=first).alias("prompt"), X.prompt_hash(F.lit("sys"), first).alias("prompt_hash"))


@query("""
SELECT o_orderkey, o_orderkey % 7 AS relevance, '<p>' || o_orderstatus || '</p>' AS answer, 'order ' || o_orderkey AS thought, '{"a": ' || o_orderkey || '}' AS inner_json FROM orders
""")
def reply_parts(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey").cast("string")
    o = table(spark, d, "orders").select(
        "o_orderkey", F.concat(F.lit("**Relevance Score**: about\n "), (F.col("o_orderkey") % 7).cast("string"), F.lit("/5\nClarity Score: 9")).alias("rated"),
        F.concat(F.lit("<think>order "), key, F.lit("</think><p>"), "o_orderstatus", F.lit("</p>")).alias("reply"), F.concat(F.lit('```json{"a": '), key, F.lit("}```")).alias("fenced"),
    )
    inner, answer = X.thoughts(F.col("reply"))
    return o.select("o_orderkey", X.score(F.col("rated"), "Relevance").cast("bigint").alias("relevance"), answer.alias("answer"), inner.alias("thought"), X.without_fence(F.col("fenced")).alias("inner_json"))


@query("""
WITH e AS (SELECT guide_id, paragraph_id, unnest(regexp_extract_all(paragraph_text, '\\((http.*?)\\)', 1)) AS link FROM (SELECT DISTINCT guide_id, paragraph_id, paragraph_text FROM citation_extractions))
SELECT guide_id, count(*) AS n_links, count(DISTINCT link) AS n_distinct, count(*) FILTER (starts_with(link, 'https://hudoc.')) AS n_valid, max(left(split_part(link, '?i=', 2), 3)) AS top FROM e GROUP BY 1
""")
def markdown_links(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "citation_extractions").select("guide_id", "paragraph_id", "paragraph_text").distinct()
    e = e.select("guide_id", F.explode(X.link_targets(F.col("paragraph_text"))).alias("link"))
    tail = F.when(F.contains("link", F.lit("?i=")), F.substring_index("link", "?i=", -1)).otherwise("")
    return e.groupBy("guide_id").agg(F.count("*").alias("n_links"), F.countDistinct("link").alias("n_distinct"), F.count_if(F.col("link").startswith("https://hudoc.")).alias("n_valid"), F.max(F.left(tail, F.lit(3))).alias("top"))


@query("""
WITH n AS (SELECT doc_id, 'doc_' || lower(coalesce(source, 'none')) || '_query_' || CASE WHEN doc_id % 2 = 0 THEN 'translation_echr_retrieve' ELSE 'base_x' END || '_m' || (doc_id % 3) || '_t' || (doc_id % 4) AS name,
 CASE doc_id % 3 WHEN 0 THEN 'ron_x_ron' WHEN 1 THEN 'translation_ron_q_ron' ELSE 'base_ron' END AS cfg FROM documents)
SELECT doc_id, name, split_part(split_part(name, 'doc_', 2), '_query_', 1) AS doc_embed, CASE WHEN doc_id % 2 = 0 THEN 'translation_echr_retrieve' ELSE 'base_x' END AS query_embed, 'm' || (doc_id % 3) AS model, 't' || (doc_id % 4) AS translation,
 CASE WHEN doc_id % 2 = 0 THEN 'query_translation_echr_retrieve' ELSE 'query_echr_retrieve' END AS retrieval_language, CASE doc_id % 3 WHEN 0 THEN 'ron_x' WHEN 1 THEN 'translation_ron_q' ELSE 'base_ron' END AS cfg FROM n
""")
def strategy_parse(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    name = F.concat(F.lit("doc_"), F.lower(F.coalesce("source", F.lit("none"))), F.lit("_query_"), F.when(i % 2 == 0, "translation_echr_retrieve").otherwise("base_x"), F.lit("_m"), (i % 3).cast("string"), F.lit("_t"), (i % 4).cast("string"))
    cfg = F.when(i % 3 == 0, "ron_x_ron").when(i % 3 == 1, "translation_ron_q_ron").otherwise("base_ron")
    s = table(spark, d, "documents").select("doc_id", name.alias("name"), cfg.alias("cfg"))
    return s.select("doc_id", "name", *[c.alias(k) for k, c in X.strategy(F.col("name")).items()], X.without_ron_suffix(F.col("cfg")).alias("cfg"))


@query("""
SELECT _id, counter, md5(trim(regexp_replace(docname, '[\\s\\x{00A0}\\x0B\\x{0085}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{1680}]+', ' ', 'g'))) AS name_hash, array_to_string(string_split_regex(trim(docname), '\\s+')[1:3], ' ') AS three,
 coalesce(TRY_CAST(left(kpdate, 4) AS INTEGER), 0) AS year, replace(_id || '_eng', '_eng', '_ron') AS local_id, 'Instruct: find' || chr(10) || 'Document: ' || docname AS instruct,
 CASE upper(languageisocode) WHEN 'ENG' THEN 'eng' WHEN 'FRE' THEN 'fre' WHEN 'RUM' THEN 'ron' ELSE languageisocode END AS lang
FROM (SELECT DISTINCT _id, counter, docname, kpdate, languageisocode FROM echr_documents WHERE docname IS NOT NULL)
""")
def catalogue_strings(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "echr_documents").where("docname IS NOT NULL").select("_id", "counter", "docname", "kpdate", "languageisocode").distinct()
    up = F.upper("languageisocode")
    return e.select(
        "_id", "counter", F.md5(X.collapse_space(F.col("docname"))).alias("name_hash"), X.first_words(F.trim("docname"), 3).alias("three"), X.year_of(F.col("kpdate")).alias("year"), F.replace(F.concat("_id", F.lit("_eng")), F.lit("_eng"), F.lit("_ron")).alias("local_id"),
        F.concat(F.lit("Instruct: find\nDocument: "), "docname").alias("instruct"), F.when(up == "ENG", "eng").when(up == "FRE", "fre").when(up == "RUM", "ron").otherwise(F.col("languageisocode")).alias("lang"),
    )


@query("""
SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, 'Part ' || l_partkey) AS INTEGER) AS paragraph_id, 'Part ' || l_partkey || ' of the order.' AS paragraph FROM lineitem
""")
def guide_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    body = F.concat(F.lit("Part "), F.col("l_partkey").cast("string"), F.lit(" of the order."))
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", body.alias("p")))), lambda x: x["p"]).alias("ps"))
    text = F.array_join(F.transform("ps", lambda p, i: F.concat(F.when(i % 3 == 2, F.concat(F.lit("\n- "), (i + 1).cast("string"), F.lit(". "))).otherwise(F.concat(F.lit("\n"), (i + 1).cast("string"), F.lit(". "))), p)), "")
    s = g.select("l_orderkey", F.posexplode(split_paragraphs(text, F.size("ps"))).alias("pos", "part"))
    return s.select("l_orderkey", (F.col("pos") + 1).alias("paragraph_id"), F.regexp_replace(X.collapse_space(F.col("part")), r"^(?:- )?\d+\. ", "").alias("paragraph"))


_CLEAN = "regexp_replace(regexp_replace(message, '\\b\\d{3,}-\\d+\\b', '<ID>', 'g'), 'https?://\\S+|\\bwww\\.\\S+', '<URL>', 'g')"
_CATEGORY = """CASE WHEN regexp_matches(message, '(?i)Failed to fetch .*judgment') THEN 'Failed to fetch judgment' WHEN regexp_matches(message, '(?i)Failed to fetch .* for citation') THEN 'Failed to fetch resource for citation'
 WHEN contains(lower(clean), 'year mismatch') THEN 'Year mismatch' WHEN contains(lower(clean), 'link mismatch') THEN 'Link mismatch' WHEN contains(lower(clean), 'unconsumed links') THEN 'Unconsumed links' WHEN contains(lower(clean), 'still links in the stripped sentences') THEN 'Links in stripped sentences'
 WHEN contains(lower(clean), 'no ```json block found') THEN 'JSON block not found' WHEN contains(lower(clean), 'invalid json format') THEN 'Invalid JSON' WHEN contains(lower(clean), 'no paragraphs provided') THEN 'No paragraphs in citation' WHEN contains(lower(clean), 'missing field') THEN 'Missing field in citation'
 ELSE left(trim(regexp_extract(clean, '^(.+?)(?:[:.\\-]| for citation| for |$)', 1)), 120) END"""


@query(f"""
WITH e AS (SELECT guide_id, paragraph_id, unnest(from_json(errors, '["VARCHAR"]')) AS message FROM (SELECT DISTINCT guide_id, paragraph_id, errors FROM citation_extractions WHERE errors IS NOT NULL AND json_valid(errors))),
c AS (SELECT message, {_CLEAN} AS clean FROM e WHERE message IS NOT NULL), k AS (SELECT message, {_CATEGORY} AS category FROM c)
SELECT category, count(*) AS n, min(message) AS first_message FROM k GROUP BY 1
""")
def error_categories(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "citation_extractions").select("guide_id", "paragraph_id", "errors").distinct().select(F.explode(F.from_json("errors", "array<string>")).alias("message")).where("message IS NOT NULL")
    return e.groupBy(X.error_category(F.col("message")).alias("category")).agg(F.count("*").alias("n"), F.min("message").alias("first_message"))


@query(f"""
WITH d AS (SELECT DISTINCT guide_id, paragraph_id, errors FROM citation_extractions WHERE errors IS NOT NULL AND json_valid(errors)), e AS (SELECT guide_id, paragraph_id, errors, unnest(from_json(errors, '["VARCHAR"]')) AS message FROM d),
c AS (SELECT *, {_CLEAN} AS clean FROM e), k AS (SELECT guide_id, paragraph_id, errors, {_CATEGORY} AS category FROM c), r AS (SELECT guide_id, paragraph_id, errors, string_agg(DISTINCT category, ' + ' ORDER BY category) AS combination FROM k GROUP BY 1, 2, 3)
SELECT combination, count(*) AS n, min(guide_id || '/' || paragraph_id) AS example FROM r GROUP BY 1
""")
def error_combinations(spark: SparkSession, d: str) -> DataFrame:
    """Rows by the set of their errors' categories."""
    e = table(spark, d, "citation_extractions").select("guide_id", "paragraph_id", "errors").distinct().withColumn("m", F.from_json("errors", "array<string>")).where("size(m) > 0")
    kinds = F.array_sort(F.array_distinct(F.transform("m", X.error_category)))
    return e.groupBy(F.array_join(kinds, " + ").alias("combination")).agg(F.count("*").alias("n"), F.min(F.concat("guide_id", F.lit("/"), "paragraph_id")).alias("example"))


@query("SELECT case_id, paragraph_number, count(*) AS n FROM judgements WHERE case_name IS NULL AND regexp_full_match(case_id, '\\d{3}-\\d+') AND paragraph_number IS NOT NULL GROUP BY 1, 2")
def missing_log(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of id and paragraph out of the lines of a log, with how often they stand there; the lines are built from judgments without a name."""
    said = F.concat(F.lit("Batch 7: missing [('"), "case_id", F.lit("', "), F.col("paragraph_number").cast("string"), F.lit(")] of 12"))
    lines = table(spark, d, "judgements").where("case_name IS NULL").select(said.alias("line"))
    return X.logged_pairs(lines, "line").groupBy("case_id", "paragraph_number").agg(F.count("*").alias("n"))


@query("""
SELECT regexp_extract(m, '(\\d{3}-\\d+)', 1) AS case_id, count(*) AS n FROM (SELECT unnest(regexp_extract_all(citations, '\\d{3}-\\d+')) AS m FROM citation_extractions) GROUP BY 1
""")
def log_pairs(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "citation_extractions").select(F.explode(F.regexp_extract_all("citations", F.lit(r"(\d{3}-\d+)"), 1)).alias("case_id"))
    return m.groupBy("case_id").agg(F.count("*").alias("n"))


def _citations(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "citation_extractions").select("guide_id", "paragraph_id", "citations").distinct()
    return rows.select("guide_id", "paragraph_id", F.posexplode(C.citation_lists(F.col("citations"))).alias("s", "list")).select("guide_id", "paragraph_id", "s", F.posexplode("list").alias("i", "c"))


@query("""
WITH r AS (SELECT DISTINCT guide_id, paragraph_id, citations FROM citation_extractions WHERE json_valid(citations)),
a AS (SELECT guide_id, paragraph_id, generate_subscripts(x, 1) - 1 AS s, unnest(x) AS y FROM (SELECT guide_id, paragraph_id, from_json(citations, '[["JSON"]]') AS x FROM r)),
c AS (SELECT guide_id, paragraph_id, s, generate_subscripts(y, 1) - 1 AS i, unnest(y) AS c FROM a)
SELECT guide_id, paragraph_id, CAST(s AS INTEGER) AS s, CAST(i AS INTEGER) AS i, json_extract_string(c, '$.multilingual.eng.docname') AS eng_name, json_extract_string(c, '$.citation_year') AS year, CAST(coalesce(json_array_length(c, '$.citation_paragraphs'), 0) AS INTEGER) AS n_paragraphs FROM c
""")
def citation_rows(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("c")
    return _citations(spark, d).select("guide_id", "paragraph_id", "s", "i", F.try_element_at(c["multilingual"], F.lit("eng"))["docname"].alias("eng_name"), c["citation_year"].alias("year"), F.when(c["citation_paragraphs"].isNull(), 0).otherwise(F.size(c["citation_paragraphs"])).alias("n_paragraphs"))


_ROWS = """
WITH r AS (SELECT DISTINCT guide_id, paragraph_id, citations FROM citation_extractions WHERE json_valid(citations)),
a AS (SELECT guide_id, paragraph_id, generate_subscripts(x, 1) - 1 AS s, unnest(x) AS y FROM (SELECT guide_id, paragraph_id, from_json(citations, '[["JSON"]]') AS x FROM r)),
c AS (SELECT guide_id, paragraph_id, CAST(s AS INTEGER) AS s, CAST(generate_subscripts(y, 1) - 1 AS INTEGER) AS i, unnest(y) AS c FROM a)
"""
_NAMES = "list_filter([{}], lambda n: n IS NOT NULL)".format
_DOCNAME = "json_extract_string(c, '$.multilingual.{}.docname')".format
_NAMED = """coalesce(json_extract_string(c, '$.citation_year'), '0') || CASE WHEN json_array_length(c, '$.citation_tags') > 0 THEN ' ' || array_to_string(from_json(json_extract(c, '$.citation_tags'), '["VARCHAR"]'), ' ') ELSE '' END || ', ' || coalesce(nullif({0}[1], ''), 'Unknown Case') || ', ' ||
 CASE WHEN json_array_length(c, '$.citation_paragraphs') > 0 THEN 'Paragraphs: ' || array_to_string(from_json(json_extract(c, '$.citation_paragraphs'), '["VARCHAR"]'), ', ') ELSE 'No paragraphs' END || CASE WHEN len(list_filter({0}[2:], lambda n: n <> '')) > 0 THEN ', Alternative names: ' || array_to_string(list_filter({0}[2:], lambda n: n <> ''), ', ') ELSE '' END"""
_FRENCH, _ROMANIAN = _NAMED.format("names"), _NAMED.format("ron_names")


@query(_ROWS + f", n AS (SELECT *, {_NAMES(_DOCNAME('fre') + ', ' + _DOCNAME('eng'))} AS names, {_NAMES(', '.join(map(_DOCNAME, ('ron', 'fre', 'eng'))))} AS ron_names FROM c) SELECT guide_id, paragraph_id, s, i, {_FRENCH} AS named, {_ROMANIAN} AS named_ron FROM n")
def citation_names(spark: SparkSession, d: str) -> DataFrame:
    return _citations(spark, d).select("guide_id", "paragraph_id", "s", "i", C.citation_string(F.col("c")).alias("named"), C.citation_string(F.col("c"), "ron").alias("named_ron"))


@query(_ROWS.replace("WITH", "WITH RECURSIVE", 1) + """,
k AS (SELECT row_number() OVER () AS id, * FROM c), m AS (SELECT id, json_extract(c, '$.multilingual') AS m FROM k), v AS (SELECT id, m, unnest(json_keys(m)) AS lang FROM m WHERE json_type(m) = 'OBJECT'),
t AS (SELECT id, trim(json_extract_string(m, '$."' || lang || '".id')) AS t FROM v), i AS (SELECT id, list(DISTINCT t ORDER BY t) AS ids FROM t WHERE t <> '' GROUP BY 1),
f AS (SELECT guide_id, paragraph_id, s, k.i, coalesce(from_json(json_extract(c, '$.citation_paragraphs'), '["VARCHAR"]'), []) AS pars, coalesce(ids, []) AS ids FROM k LEFT JOIN i ON i.id = k.id),
g AS (SELECT row_number() OVER () AS id, guide_id, paragraph_id, list({'pars': pars, 'ids': ids} ORDER BY s, i, pars, ids) AS a FROM f GROUP BY guide_id, paragraph_id),
st AS (SELECT id, 0 AS n, []::INTEGER[] AS kept FROM g UNION ALL SELECT st.id, n + 1, CASE WHEN len(list_filter(kept, lambda x: a[x].pars = a[n + 1].pars AND list_has_any(a[x].ids, a[n + 1].ids))) > 0 THEN kept ELSE list_append(kept, n + 1) END FROM st JOIN g ON g.id = st.id WHERE n < len(a))
SELECT guide_id, paragraph_id, CAST(len(a) AS INTEGER) AS n_all, CAST(len(kept) AS INTEGER) AS n_kept FROM g JOIN st ON st.id = g.id AND st.n = len(a)
""")
def citations_merged(spark: SparkSession, d: str) -> DataFrame:
    """Citations of each paragraph without those equivalent to an earlier one."""
    c = _citations(spark, d)
    g = c.groupBy("guide_id", "paragraph_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("s", "i", F.coalesce(F.col("c.citation_paragraphs"), F.array().cast("array<string>")).alias("pars"), C.ids_of(F.col("c")).alias("ids")))), lambda x: F.struct(x["pars"].alias("pars"), x["ids"].alias("ids"))).alias("all"))
    return g.select("guide_id", "paragraph_id", F.size("all").alias("n_all"), F.size(C.merged(F.col("all"))).alias("n_kept"))


_LINKS = r"regexp_extract_all(paragraph_text, '\((http.*?)\)', 1)"
_SENT = "regexp_extract_all(sentences, '" + r"\((http.*?)\)" + "', 1)"


@query(f"""
WITH RECURSIVE r AS (SELECT row_number() OVER () AS id, * FROM (SELECT DISTINCT guide_id, paragraph_id, paragraph_text, citations, sentences FROM citation_extractions)),
a AS (SELECT id, generate_subscripts(x, 1) AS s, unnest(x) AS y FROM (SELECT id, from_json(citations, '[["JSON"]]') AS x FROM r WHERE json_valid(citations))), b AS (SELECT id, s, generate_subscripts(y, 1) AS i, unnest(y) AS c FROM a),
u0 AS (SELECT id, s, i, coalesce(json_extract_string(c, '$.original_url'), json_extract_string(c, '$.citation_url'), '') AS u FROM b), u AS (SELECT id, list({NORMAL_URL.format("u")} ORDER BY s, i) AS us FROM u0 GROUP BY 1),
l0 AS (SELECT id, list_transform({_LINKS}, lambda x: replace(replace(x, 'https', 'http'), 'http', 'https')) AS ls FROM r WHERE paragraph_text IS NOT NULL), l1 AS (SELECT id, generate_subscripts(ls, 1) AS i, unnest(ls) AS l, ls FROM l0),
l AS (SELECT id, list({NORMAL_URL.format("l")} ORDER BY i) FILTER (starts_with({NORMAL_URL.format("l")}, 'https://hudoc.')) AS ls FROM l1 WHERE i = 1 OR l <> ls[i - 1] GROUP BY 1),
w AS (SELECT r.id, guide_id, paragraph_id, CASE WHEN json_valid(citations) THEN coalesce(us, []) END AS us, CASE WHEN paragraph_text IS NOT NULL THEN coalesce(ls, []) END AS ls, len({_SENT}) AS n_left FROM r LEFT JOIN u ON u.id = r.id LEFT JOIN l ON l.id = r.id),
st AS (SELECT id, 0 AS i, 0 AS j, 0 AS bad FROM w WHERE us IS NOT NULL
 UNION ALL SELECT st.id, i + 1, j + CASE WHEN coalesce(ls[j + 1] = us[i + 1], false) THEN 1 ELSE 0 END, bad + CASE WHEN coalesce(ls[j + 1] = us[i + 1], false) OR (j > 0 AND ls[j] = us[i + 1]) THEN 0 ELSE 1 END FROM st JOIN w ON w.id = st.id WHERE i < len(us))
SELECT guide_id, paragraph_id, bad AS mismatched, CAST(len(ls) - j AS INTEGER) AS unconsumed, CAST(n_left AS INTEGER) AS left FROM w LEFT JOIN st ON st.id = w.id AND st.i = len(us)
""")
def link_validation(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "citation_extractions").select("guide_id", "paragraph_id", "paragraph_text", "citations", "sentences").distinct()
    urls = normal_urls(F.transform(F.flatten(C.citation_lists(F.col("citations"))), C.url_of))
    rows = rows.withColumn("urls", urls).withColumn("links", normal_urls(C.paragraph_links(F.col("paragraph_text"))))
    links = F.filter("links", lambda u: u.startswith("https://hudoc."))
    v = rows.select("guide_id", "paragraph_id", C.link_mismatches(F.col("urls"), links).alias("v"), F.size(X.link_targets(F.col("sentences"))).alias("left"))
    return v.select("guide_id", "paragraph_id", "v.mismatched", "v.unconsumed", "left")
