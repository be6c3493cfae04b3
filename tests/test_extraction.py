"""Extraction with a scripted model, embeddings that are missing, tiers."""

import json

from quillon.operators.embedding import FakeEmbedder, embed_missing, instructed
from quillon.operators.extraction import extract_citations
from quillon.plans import evaluation_queries
from quillon.sources.fetch import MISSING, NoFetcher, download_report, fetch_judgments

U = "https://h.example/eng?i=001-1"


def Scripted(name, replies):
    class Provider:  # local, so that workers needn't import this module
        def complete(self, prompts):
            return [next((r for key, r in self.replies.items() if key in p), None) for p in prompts]

    provider = Provider()
    provider.name, provider.replies = name, replies
    return provider


def reply(url, year, paragraphs=(1,), sentence="It was so."):
    return "```json\n" + json.dumps({"sentences": [{"stripped_sentence": sentence, "citations": [{"citation_url": url, "citation_year": year, "citation_tags": [], "citation_paragraphs": list(paragraphs)}]}]}) + "\n```"


def test_extraction(spark):
    rows = [("g", 1, f"Good ([x]({U}))."), ("g", 1, f"Good ([x]({U}))."), ("g", 2, f"Retry ([x]({U}))."), ("g", 3, f"Year ([x]({U}))."), ("g", 4, "Silent."), ("g", 5, " "), ("g", 6, None)]
    tasks = spark.createDataFrame(rows, "guide_id string, paragraph_id int, paragraph_text string")
    meta = spark.createDataFrame([(U, "2001-05-01", {"eng": ("001-1", "N")})], "url string, kpdate string, multilingual map<string,struct<id:string,docname:string>>")
    first = Scripted("a", {"Good": reply(U, 2001), "Retry": "no json here", "Year": reply(U, 1990)})
    second = Scripted("b", {"Retry": reply(U.replace("https", "http"), 2001)})
    got = {r["paragraph_id"]: r for r in extract_citations(tasks, meta, first, second).collect()}
    assert set(got) == {1, 2, 3, 4}
    assert got[1]["errors"] == [] and got[1]["citations"][0]["multilingual"]["eng"]["id"] == "001-1"
    assert got[2]["errors"] == [] and got[2]["sentences"] == ["It was so."]
    assert got[3]["errors"] == ["year_mismatch"] and got[4]["errors"] == ["no_json"]


def test_embeddings(spark):
    texts = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "query string")
    known = embed_missing(texts.where("query = 'a'"), "query", None, FakeEmbedder())
    assert [r["query"] for r in embed_missing(texts, "query", known, FakeEmbedder()).collect()] == ["b"]
    assert instructed(texts.limit(1), "query", "find").first()[0] == "Instruct: find\nQuery: a"


def test_tiers(spark):
    class Web(NoFetcher):
        def get(self, case_id):
            return "<p>Court</p><p>1. From the web.</p>" if case_id == "w" else None

    wanted = spark.createDataFrame([("c", 1), ("c", 2), ("s", 1), ("w", 1), ("x", 1), ("p", 1)], "case_id string, paragraph_number int")
    cache = spark.createDataFrame([("c", 1, "cached")], "case_id string, paragraph_number int, paragraph_text string")
    store = spark.createDataFrame([("s", "<p>Court</p><p>1. Stored.</p>", None), ("p", "<p>Court</p><p>1. No.</p>", "True"), ("w", '{"error": 1}', "False")], "_id string, html string, isplaceholder string")
    out, fresh = fetch_judgments(wanted, cache, store, Web())
    got = {(r["case_id"], r["paragraph_number"]): (r["paragraph_text"], r["tier"]) for r in out.collect()}
    assert got == {("c", 1): ("cached", "cache"), ("c", 2): (MISSING, "cache"), ("s", 1): ("1. Stored.", "store"), ("w", 1): ("1. From the web.", "web"), ("x", 1): (None, None), ("p", 1): (None, None)}
    assert fresh.count() == 2
    assert download_report(spark.createDataFrame([("success",), ("error",)], "status string")).count() == 2


def test_the_query_extracts_citations(spark):
    rows = evaluation_queries.extraction_pipeline(spark, "/root/testdata/sf0.001").collect()
    by = {r["errors"]: r for r in rows}
    assert by[""]["n"] > 0 and by[""]["n_sentences"] >= by[""]["n"] and sum(r["n_citations"] for r in rows) > 0
    assert sum(r["n"] for k, r in by.items() if "no_json" in k) < 0.1 * sum(r["n"] for r in rows)
