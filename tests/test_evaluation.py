"""Evaluation frames, replies as JSON, batch results."""

import json

from pyspark.sql import functions as F

from quillon.functions.jsonrepair import extracted_json, json_of_reply
from quillon.operators import evaluation as E
from quillon.sources import readers


def test_registry_and_selection(spark):
    runs = E.registry(spark)
    assert runs.count() == 36 and E.select_runs(runs, model="k2", translation="pre", doc_embed=None).count() == 4
    evals = spark.createDataFrame([("e_doc_base_query_base_k2_pre", 1), ("doc_base_query_base_k2_post", 2), ("e_doc_base_query_base_k2_post", 3)], "file_key string, v int")
    got = {r["name"]: r["v"] for r in E.with_eval(runs, evals).where("v IS NOT NULL").collect()}
    assert got == {"doc_base_query_base_k2_pre": 1, "doc_base_query_base_k2_post": 2}


def test_scores(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 3.0, None), ("a", -1.0, 1.0), ("a", -2.0, 1.0), ("b", float("nan"), 1.0)], "g string, s double, t double")
    assert {r["g"]: r["report"] for r in E.mean_and_std(df, "s", "g").collect()} == {"a": "2.000 ± 1.414", "b": "N/A"}
    assert E.valid_scores(df, "s", (-1,)).count() == 3
    assert df.where(E.complete_rows(df, ["s", "t"])).count() == 3 and df.where(E.complete_rows(df, ["s", "x"])).count() == 0
    assert [r["g"] for r in E.in_order(spark.createDataFrame([("translation_a",), ("z",), ("b",), ("a",)], "g string"), "g", ["b", "a"]).collect()] == ["b", "a", "z", "translation_a"]
    gold = spark.createDataFrame([(["x"],), ([],), (["x", "bad"],)], "g array<string>")
    assert E.usable_gold(gold, "g", ["bad"]).count() == 1 and E.unanswered(gold).count() == 3
    pairs = spark.createDataFrame([("d", "q", "d", "q_ron"), ("d", "q", "e", "q_ron")], "a_doc string, a_query string, b_doc string, b_query string")
    assert E.same_root(pairs).count() == 1 and E.first_rows(df, "s", 2).count() == 2


def test_keys(spark):
    gen = json.dumps([{"sentence": "s", "citations": [{"case_id": "1", "paragraph_number": 2, "paragraph_text": "t"}, {"case_id": "1", "paragraph_number": 2, "paragraph_text": "t"}]}, {"sentence": "n", "citations": []}])
    gold = json.dumps([{"text": "f", "citations": [{"citation_paragraphs": [3, 4], "multilingual": {"eng": {"id": "9"}}}]}])
    lacks = json.dumps([{"text": "f", "citations": [{"citation_paragraphs": [3], "multilingual": {"fre": {"id": "9"}}}]}])
    r = spark.createDataFrame([(gen, gold, lacks)], "g string, o string, l string").select(E.unique_keys(F.col("g")).alias("u"), E.gold_keys(F.col("o")).alias("k"), E.gold_keys(F.col("l")).alias("n"), E.sentence_texts(F.col("g")).alias("t")).first()
    assert [tuple(x) for x in r["u"]] == [("1", 2)] and [tuple(x) for x in r["k"]] == [("9", 3), ("9", 4)] and r["n"] is None
    assert json.loads(r["t"])[0] == {"sentence": "s", "citations": {"1": "t", "2": "t"}}


def test_reply_json(spark):
    assert json_of_reply('x ```json\n{"a": "x"y"z"}\n```') == ('{"a": "x\\"y\\"z"}', None)
    assert json_of_reply("nothing") == (None, "No ```json block found") and json_of_reply("```json\n{x}\n```") == (None, "Invalid JSON format")
    df = spark.createDataFrame([(1, '{"a": 1}'), (2, None), (3, "")], "i int, r string").select("i", extracted_json(F.col("r")).alias("x"))
    assert {r["i"]: r["x"]["json"] for r in df.collect()} == {1: '{"a": 1}', 2: None, 3: None}


def test_batch_results(spark):
    requests = spark.createDataFrame([(0, "p"), (1, "q")], "request_id int, prompt string")
    lines = spark.createDataFrame([('{"request_id": "1", "response": "r"}',), ("broken",)], "value string")
    assert {r["request_id"]: r["response"] for r in readers.batch_results(requests, lines).collect()} == {0: None, 1: "r"}


def test_csv_tables_and_discovery(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "e_one.csv").write_text('a,b\n1,"x\ny"\n')
    assert readers.load_csv_tables(spark, str(tmp_path / "c"), "a int, b string") == ["e_one"]
    assert spark.table("e_one").first()[:] == (1, "x\ny")
    spark.sql("DROP TABLE e_one")
    spark.range(3).withColumn("doc_db", F.lit("d")).write.partitionBy("doc_db").parquet(str(tmp_path / "p"))
    assert readers.discover(spark, str(tmp_path / "p"), "doc_db").where("doc_db = 'd'").count() == 3
    assert readers.existing_or_base(spark, str(tmp_path / "none"), str(tmp_path / "p")).count() == 3
