"""Sinks, parsers, pipelines, entry points and plans."""

import glob
import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In

import __spark_entry__ as entry
from quillon.functions import text as X
from quillon.operators import citations as C
from quillon.operators import embedding, evaluation, guides, judgments, models, retrieval
from quillon.operators.retrieval import f1, ndcg, precision, recall, reciprocal_rank, top_k
from quillon.plans import catalogue, problems
from quillon.plans.report_queries import qa_groups
from quillon.session import scratch_dir
from quillon.sources import fetch, readers, sinks

SF = "/root/testdata/sf0.001"


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k int, t int, v string")
    new = spark.createDataFrame([(2, 2, "c"), (2, 3, "d"), (3, None, "e")], "k int, t int, v string")
    once = sinks.upsert(old, new, ["k"], "t", "v")
    want = {(1, "a"), (2, "d"), (3, "e")}
    assert {(r["k"], r["v"]) for r in once.collect()} == want
    assert {(r["k"], r["v"]) for r in sinks.upsert(once, new, ["k"], "t", "v").collect()} == want
    assert {(r["k"], r["v"]) for r in sinks.insert_if_absent(old, new, ["k"], "t", "v").collect()} == {(1, "a"), (2, "b"), (3, "e")}
    assert sinks.append_versions(old, new.where("t IS NOT NULL"), "t").count() == 4


def test_next_versions(spark):
    history = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y"), ("b", 0, "z")], "key string, version int, text string")
    new = spark.createDataFrame([("a", "x"), ("b", "z"), ("c", "n")], "key string, text string")
    assert {tuple(r) for r in sinks.next_versions(history, new, "key", "text").collect()} == {("a", 2, "x"), ("c", 0, "n")}


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([('say "x"\nnext', json.dumps({"a": 'q"'})), ("plain", "2")], "a string, b string")
    sinks.write_csv(df, str(tmp_path / "t"))
    assert sorted(map(tuple, readers.read_csv(spark, str(tmp_path / "t"), "a string, b string").collect())) == sorted(map(tuple, df.collect()))


def test_sqlite_source(spark, tmp_path):
    import sqlite3

    with sqlite3.connect(tmp_path / "x.db") as db:
        db.execute("CREATE TABLE t (id INTEGER, name TEXT, v REAL)")
        db.executemany("INSERT INTO t VALUES (?, ?, ?)", [(i, f"n{i}", i / 2) for i in range(25)])
    spark.dataSource.register(readers.SqliteSource)
    df = spark.read.format("sqlite").option("path", str(tmp_path / "x.db")).option("table", "t").load()
    assert df.agg(F.count("*"), F.sum("id"), F.sum("v")).first()[:] == (25, 300, 150.0)
    again = readers.read_sqlite(spark, str(tmp_path / "x.db"), "t")
    assert sorted(r["id"] for r in again.where("name IN ('n3', 'n20') AND v > 2").collect()) == [20]
    assert [r["name"] for r in again.where("id = 7").collect()] == ["n7"]
    reader = readers._PushingReader(again.schema, {})
    assert not list(reader.pushFilters([EqualTo(("id",), 7), In(("name",), ("a", "b"))])) and reader.where == [("id", [7]), ("name", ["a", "b"])]
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_guides(spark):
    body = "".join(f"\n{'- ' if i == 5 else ''}{i}. Text {i}" for i in range(2, 12))
    text = "Cover\nHUDOC keywords\nshort\n1. First <sup>1</sup> one <sup>7</sup>.\n  ## Head\n <sup>1.</sup> The note.\n<span id=\"page-3\"></span>" + body + "\nList of cited cases\n12. no"
    french = "Avant\n1. Le début est ici 2?Deux\nGuide sur x\n3. Trois" + "".join(f"\n{i}. T{i}" for i in range(4, 12)) + "\nListe des affaires citées"
    df = spark.createDataFrame([("g_eng", text), ("h_eng", "no keyword\n1. x"), ("n_eng", None), ("m_eng", text.replace("\n7. ", "\n7.")), ("g_fre", french)], "guide_id string, text string")
    rules = spark.createDataFrame([("g_fre", "start", 0, "1. Le début", None), ("g_fre", "remove", 1, "^Guide sur.*$", None), ("g_fre", "replace", 1, r" 2\?D", "\n2. D"), ("x_eng", "remove", 1, ".", None)], guides.RULES)
    every = {(r["guide_id"], r["paragraph_id"]): r["paragraph"] for r in guides.parse_guides(df, rules).collect()}
    rows = {i: p for (g, i), p in every.items() if g == "g_eng"}
    assert rows[1] == "First <sup>1</sup> one <sup>7</sup>.\n<sup>1</sup> The note." and rows == {1: rows[1], **{i: f"Text {i}" for i in range(2, 12)}}
    assert {g for g, _ in every} == {"g_eng", "g_fre"}
    assert [every["g_fre", i] for i in (1, 2, 3)] == ["Le début est ici", "Deux", "Trois"]
    assert guides.residual_clutter(guides.parse_guides(df.where("guide_id = 'g_eng'"))).count() == 0
    left = spark.createDataFrame([("a_fre", "x Cour européenne des droits de l’homme 3/4"), ("a_eng", "[Guide on x](y)"), ("b_eng", "Guide on x"), ("c_ron", "x ## y")], "guide_id string, paragraph string")
    assert sorted((r["guide_id"], r["problem"]) for r in guides.residual_clutter(left).collect()) == [("a_fre", "footer"), ("b_eng", "header"), ("c_ron", "heading")]


def test_html(spark):
    html = '<style>.h{font-size:16pt}</style>Court\n<h2>TITLE</h2><p class="h">Bigger heading here</p><p>THE LAW OF IT</p><p><b>Bold heading line</b></p>' + "".join(f"<p>\n{i}. Paragraph <b>bold</b> {i}.</p>" for i in range(1, 12))
    rows, report, doubtful = judgments.paragraphs_of(html)
    assert [n for n, _ in rows] == list(range(1, 12)) and rows[1][1] == "2. Paragraph bold 2."
    assert report == {"headings": 1, "caps": 1, "bold": 1, "size": 1, "paragraphs": 14} and not doubtful
    assert judgments.paragraphs_of("<p>unclosed <b>1. x")[0] == [(1, "1. x")]
    assert judgments.paragraphs_of("<p>no numbers")[0] == []
    df = spark.createDataFrame([("a", html), ("b", None), ("c", "")], "_id string, html string")
    assert judgments.html_paragraphs(df).count() == 11
    assert judgments.headline_report(df).count() == 1


def test_headlines_by_their_style():
    def kinds(*paragraphs, css=""):
        doc = judgments.Judgment(f"<style>{css}</style><body style='font-size:12pt'>" + "".join(paragraphs))
        return [doc.why(n) for n in doc.walk() if n.tag == "p"]

    small = 'style="font-size:9pt"'
    assert kinds("<p>ALL IN CAPITALS</p>", f"<p {small}>ALL IN CAPITALS</p>", "<p>ABCD</p>", "<p>CAPS and small</p>") == ["caps", None, None, None]
    assert kinds("<p><b>Bold line</b></p>", f"<p {small}><b>Bold line</b></p>", '<p style="font-weight:700">x <i>line here</i></p>', "<p><b>Bold</b> and not</p>") == ["bold", None, "bold", None]
    assert kinds('<p style="font:bold 16px/1.2 serif">Twelve points</p>', '<p style="font-size:16pt;font:9pt x">Wide</p>', '<p style="font-size:16pt">12</p>') == ["bold", "size", "size"]
    assert kinds('<p class="u">small capitals</p>', '<p class="a">nothing</p>', css=".u, p.v {font-variant: small-caps} /* .a{font-weight:bold} */") == ["caps", None]
    nested = judgments.Judgment('<div class="MsoHeading2"><h3>In it</h3></div><p role="heading">x</p><p style="mso-style-name:\'Heading 1\'">y</p><p class="titled">z</p>')
    assert nested.strip_headlines()["headings"] == 3
    # larger type is normal type, where more than 0.3 of the paragraphs have it; bold headings don't matter for that
    big = "x\n" + "".join(f'<p style="font-size:14pt">\n{i}. Text {i}</p>' for i in (1, 2, 3))
    assert judgments.paragraphs_of(big)[2] and len(judgments.paragraphs_of(big)[0]) == 3
    mixed = "x\n" + "".join(f"<p><b>Head line</b></p><p>\n{i}. Text {i}</p>" for i in (1, 2, 3))
    assert judgments.paragraphs_of(mixed)[0] == [(i, f"{i}. Text {i}") for i in (1, 2, 3)]


def test_marks_of_paragraphs():
    text = "Head\n1. One\n2 . Two it is 3. Three"
    assert judgments.numbered_paragraphs(text) == {1: "1. One", 2: "2. Two it is 3. Three"}  # no line begins with 3
    text = "Head\n1. One see 4/2. x\n2 . Two\n3 Three (see 4.1)\n4\n. Four\n5"
    assert judgments.numbered_paragraphs(text) == {1: "1. One see 4/2. x", 2: "2. Two", 3: "3. Three (see 4.1)", 4: "4. Four"}
    assert judgments.numbered_paragraphs("x\n11. y\n22. z") == {1: "1. 1. y", 2: "2. 2. z"}
    assert judgments.docname_of('<p class="docname"> A v. <b>B</b> </p><p>x</p>') == "A v. B" and judgments.docname_of("<p>x") is None


def test_retrieval_metrics(spark):
    df = spark.createDataFrame([(["a", "a", "b"], ["a", "c"]), ([], []), (["x"], [])], "f array<string>, g array<string>")
    f, g = F.col("f"), F.col("g")
    p, r = precision(f, g), recall(f, g)
    rows = df.select(p, r, f1(p, r), reciprocal_rank(f, g), ndcg(f, g, 10)).collect()
    assert rows[0][:4] == (0.5, 0.5, 0.5, 1.0) and rows[0][4] == pytest.approx((1 + 0.63092975) / 1.63092975)
    assert rows[1][:3] == (0.0, 1.0, 0.0) and rows[2][1] == 0.0


def test_top_k_ties_zero_and_null(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 0.0]), (5, None), (6, [1.0]), (7, [float("nan"), 1.0])], "id long, embedding array<double>")
    got = [(r["vec_id"], r["rank"], round(r["score"], 6)) for r in top_k(v.where("id = 1"), v, 3).orderBy("rank").collect()]
    assert got == [(2, 1, 1.0), (3, 2, 1.0), (4, 3, 0.0)]
    assert top_k(v.limit(0), v, 3).count() == 0


def test_top_k_in_blocks_gives_the_same(spark, monkeypatch):
    rnd = random.Random(8)
    rows = [(i, [float(rnd.randint(-2, 2)) for _ in range(3)]) for i in range(300)]  # many ties
    v = spark.createDataFrame(rows, "id long, embedding array<float>").repartition(3)
    for metric in ("cosine", "l2"):
        want = {tuple(r) for r in top_k(v.where("id < 40"), v, 4, metric).collect()}
        for name, size in (("QUERY_BLOCK", 10), ("QUERIES", 16), ("VECTORS", 70), ("TILE", 7)):
            monkeypatch.setattr(retrieval, name, size)
        assert {tuple(r) for r in top_k(v.where("id < 40"), v, 4, metric).collect()} == want and len(want) == 160
        monkeypatch.undo()
    with pytest.raises(ValueError, match="dimensions"):
        top_k(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id long, embedding array<double>"), v, 3)


def test_evaluate(spark):
    df = spark.createDataFrame([("a", ["x", "y"], ["y"]), ("a", ["x"], []), ("a", None, ["z"]), ("b", ["x", "y"], ["x", "q"])], "c string, found array<string>, gold array<string>")
    got = {r["c"]: r for r in retrieval.evaluate(df, ["c"], (1, 2)).collect()}
    assert (got["a"]["n_questions"], got["a"]["n_recall"], got["b"]["recall@1"], got["b"]["precision@2"]) == (3, 2, 0.5, 0.5)
    assert got["a"]["recall@2"] == pytest.approx(1 / 3) and got["a"]["mrr@1"] == 0 and got["a"]["mrr@2"] == pytest.approx(1 / 6)


def test_completion_cache(spark):
    prompts = spark.createDataFrame([(1, None, "a"), (2, None, "a"), (3, "s", "a"), (4, None, None)], "prompt_id int, system string, prompt string")
    rows, fresh = models.complete(prompts, None, models.FakeProvider())
    assert fresh.count() == 2 and rows.where("response IS NULL").count() == 1
    again, none = models.complete(prompts, fresh, models.FakeProvider())
    assert none.count() == 0 and {tuple(r) for r in again.select("prompt_id", "response").collect()} == {tuple(r) for r in rows.select("prompt_id", "response").collect()}


def test_judge_and_translation(spark):
    df = spark.createDataFrame([("1", '{"evaluation": {"rating": 6}}'), ("2", 'broken "rating": "3"'), ("3", '{"evaluation": {"rating": 9}}'), ("4", "none"), ("5", None)], "id string, r string")
    assert [r[0] for r in df.orderBy("id").select(models.judged_rating(F.col("r"), 6)).collect()] == [6, 3, -1, -1, -2]
    t = models.translated(spark.createDataFrame([(1, None), (2, ""), (3, "x")], "i int, t string"), "t", "ron", models.FakeProvider())
    got = {r["i"]: r["translation"] for r in t.collect()}
    assert got[1] is None and got[2] == "" and got[3]


def test_citations(spark):
    c = '[[{"original_url": "u", "citation_year": 2001, "citation_tags": ["GC"], "citation_paragraphs": [1, 2], "multilingual": {"eng": {"id": "1", "docname": "E"}, "fre": {"id": "2", "docname": "F"}}}, {"citation_url": "v", "citation_paragraphs": [1, 2], "multilingual": {"ron": {"id": "2"}}}]]'
    df = spark.createDataFrame([(c,)], "c string").select(F.explode(F.flatten(C.citation_lists(F.col("c")))).alias("c"))
    rows = df.select(C.citation_string(F.col("c")).alias("s"), C.url_of(F.col("c")).alias("u"), C.ids_of(F.col("c")).alias("ids")).collect()
    assert rows[0]["s"] == "2001 GC, F, Paragraphs: 1, 2, Alternative names: E" and rows[1]["u"] == "v" and rows[0]["ids"] == ["1", "2"]
    links = spark.createDataFrame([(["a", "a", "b", "x"], ["a", "b", "c"])], "u array<string>, l array<string>").select(C.link_mismatches(F.col("u"), F.col("l")).alias("v")).first()["v"]
    assert (links["mismatched"], links["unconsumed"]) == (1, 1)


def test_extraction_stream(spark, tmp_path):
    from quillon.streaming.extraction import process_tasks

    src = str(tmp_path / "in")
    spark.createDataFrame([("g", 1, "a"), ("g", 1, "a"), ("g", 2, "b")], "guide_id string, paragraph_id int, paragraph_text string").write.parquet(src)
    process_tasks(spark, src, str(tmp_path / "out"), str(tmp_path / "cp"), lambda df: df.withColumn("n", F.length("paragraph_text"))).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_entry_points(spark):
    assert entry.entry(spark).count() > 0
    queries = entry.queries()
    assert set(entry.oracle_sql()) <= set(queries) and len(queries) > 40


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if value is None or isinstance(value, bool | str):
        return value
    if isinstance(value, int | float):
        return "nan" if value != value else round(float(value), 6) + 0.0
    return str(value)


CORE = catalogue.queries() | problems.queries()
CORE_SQL = catalogue.oracle_sql() | problems.oracle_sql()


@pytest.mark.parametrize("name", sorted(CORE))
def test_queries_give_what_their_sql_gives(spark, duck, name):
    """Every query is run over its whole tables; those without SQL must give rows of their schema."""
    df = CORE[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in CORE_SQL:
        assert got and len(set(columns)) == len(columns)
        return
    result = duck.execute(CORE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=repr)


def test_plans_have_no_cartesian_product(spark):
    for name in ("cache_hits", "missing_case_names", "all_or_nothing_lookup"):
        plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan
    plan = entry.queries()["upsert_latest"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    plan = entry.queries()["doctype_histogram"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "html" not in plan


def test_four_judges(spark):
    def gold(*nums, case="001-1"):
        return json.dumps([{"text": "t", "citations": [{"citation_paragraphs": list(nums), "multilingual": {"eng": {"id": case, "docname": "A v. B"}}}]}])

    def cited(*nums, text="p"):
        return json.dumps([{"sentence": "S.", "citations": [{"case_id": "001-1", "paragraph_number": n, "paragraph_text": text} for n in nums]}])

    class Judge:
        name, prompts = "judge", []

        def complete(self, prompts):
            out = []
            for p in prompts:
                if p.startswith("Do the cited"):
                    out.append('{"faithfullness_evaluation": {"faithfullness_rating": "3"}, "citation_correctness_evaluation": {"citation_correctness_rating": %d}}' % (9 if "BAD" in p else 5))
                elif p.startswith("How near"):
                    ok = "Generated only:\nX, paragraph 3: p3\nBoth:\nX, paragraph 1: p1\nGold only:\nX, paragraph 2: p2" in p
                    out.append('{"evaluation": {"rating": %d}}' % (4 if ok else 0 if p.count("None") == 3 else 1))
                else:
                    out.append('{"evaluation": {"rating": 6}}')
            return out

    rows = [
        ("sets", gold(1, 2), "g", cited(3, 1, 3)), ("missing", gold(1, 77), "g", cited(1)), ("bad", gold(1), "g", cited(1, text="BAD")), ("unread", gold(1), None, "{"), ("null", gold(1), "g", None),
        ("lang", json.dumps([{"text": "t", "citations": [{"citation_paragraphs": [1], "multilingual": {"fre": {"id": "001-2"}}}]}]), "g", cited(1)), ("none", "[]", "g", "[]"),
    ]
    df = spark.createDataFrame([(i, "q", t, a, c) for i, t, a, c in rows], "id string, question string, target_answer string, generated_answer string, generated_citations string")
    paragraphs = spark.createDataFrame([("001-1", "X", n, f"p{n}") for n in (1, 1, 2, 3)], "case_id string, case_name string, paragraph_number int, paragraph_text string")
    got = {r["id"]: tuple(r)[-4:] for r in models.scored(df, paragraphs, Judge()).collect()}
    assert got == {"sets": (6, 3, 5, 4), "missing": (6, 3, 5, -2), "bad": (6, -1, -1, 1), "unread": (-2, -2, -2, -2), "null": (6, -2, -2, -2), "lang": (6, 3, 5, -2), "none": (6, 3, 5, 0)}


def test_qa_groups_carry_the_extracted_citations(spark):
    def c(name, case, *pars):
        return {"citation_year": 2001, "citation_tags": ["GC"], "citation_paragraphs": list(pars), "multilingual": {"eng": {"id": case, "docname": name}}}

    a, b = c("A v. B", "001-1", 4), c("C v. D", "001-2")
    rows = [("g", "3", "First.", json.dumps([[a], [], [b]])), ("g", "4", "Second.", json.dumps([[a], [c("A v. B", "001-1", 5)]])), ("g", "5", "Third.", "{"), ("g", "6", "Alone.", None)]
    df = spark.createDataFrame(rows, "guide_id string, paragraph_id string, paragraph_text string, citations string").withColumn("updated_at", F.current_timestamp())
    got = {r["group_id"]: r for r in qa_groups(df).collect()}
    assert got[1]["paragraphs"] == ["First.", "Second.", "Third."] and got[2]["citations"] == []
    assert got[1]["citations"] == ["2001 GC, A v. B, Paragraphs: 4", "2001 GC, C v. D, No paragraphs", "2001 GC, A v. B, Paragraphs: 5"]


def test_guides_of_any_number_of_paragraphs(spark):
    text = "HUDOC keywords" + "".join(f"\n{i}. Text {i}" for i in range(1, 2304)) + "\nList of cited cases"
    rnd = random.Random(5)
    texts = ["", "2.", "1. 12. x", "1.2.3.05.", "11. 2. 3", "1234567890123. 4.", *("".join(rnd.choice("123450. ") for _ in range(60)) for _ in range(200))]
    df = spark.createDataFrame([("g_eng", text)], "guide_id string, text string")
    rows = {r["paragraph_id"]: r["paragraph"] for r in guides.parse_guides(df).collect()}
    assert len(rows) == 2303 and all(rows[i] == f"Text {i}" for i in rows)

    def plain(t):
        return next(i for i in range(1, 99) if f"{i}." not in t) - 1

    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", guides.number_of_paragraphs(F.col("t")).alias("n")).collect()
    assert [r["n"] for r in got] == [plain(r["t"]) for r in got]


def test_csv_columns_by_name(spark, tmp_path):
    (tmp_path / "x.csv").write_text(',b,Unnamed: 0,a,other\n0,"x\ny",7,1,z\n')
    row = readers.read_csv(spark, str(tmp_path / "x.csv"), "a int, b string, missing double").first()
    assert row.asDict() == {"a": 1, "b": "x\ny", "missing": None}


def test_retries_and_counters(spark):
    class Shaky:
        def __init__(self, fails):
            self.fails = fails

        def get(self, case_id):
            self.fails -= 1
            if self.fails >= 0:
                raise OSError("not now")
            return f"<p>{case_id}"

        def embed(self, texts):
            self.get("")
            return np.ones((len(texts), 2))

    assert fetch.RetryingFetcher(Shaky(2), delay=0).get("x") == "<p>x" and fetch.RetryingFetcher(Shaky(3), delay=0).get("x") is None
    with pytest.raises(OSError, match="not now"):
        fetch.with_retry(Shaky(9).get, "x", delay=0)
    patient = embedding.RetryingEmbedder(Shaky(4), wait=0)
    assert patient.embed(["a"]).shape == (1, 2)
    halted = embedding.RetryingEmbedder(Shaky(99), wait=0)
    texts = spark.createDataFrame([("a",), ("b",)], "t string")
    assert embedding.embed_missing(texts, "t", None, halted).count() == 0 and halted.embed(["a"]) is None
    seen, counters = fetch.observed(spark.range(10).toDF("i"), "numbers", small="i < 3")
    seen.collect()
    assert counters.get == {"rows": 10, "small": 3}


def test_sweep_embeds_equal_texts_once(spark):
    texts = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "t string")
    rows = embedding.sweep(texts, "t", {"base": "", "same": "", "law": "Find law"}, embedding.FakeEmbedder(4)).collect()
    vectors = {(r["instruction"], r["t"]): tuple(r["embedding"]) for r in rows}
    assert len(rows) == 6 and vectors["base", "a"] == vectors["same", "a"] != vectors["law", "a"]
    assert len(evaluation.DOCUMENTS) == 11 and len(evaluation.QUERIES) == 9


def test_translation_variants(spark):
    class Told:
        name = "told"

        def complete(self, prompts):
            return [f"<{p[:16]}>" if p.startswith("Translate") else ("It is so [Doc 1].\nOr not [Doc 0, 9]." if "<Translate" not in p else "Asked in English [Doc 2].") for p in prompts]

    v = spark.createDataFrame([(i, [1.0, float(i)], f"text {i}") for i in range(1, 5)], "id long, embedding array<double>, text string")
    q = spark.createDataFrame([(1, "De ce?", [1.0, 1.0])], "id long, question string, embedding array<double>")
    got = {n: models.rag_experiment(f"doc_base_query_base_m_{n}", q, v, Told()).first()["sentences"] for n in ("none", "pre", "post")}
    assert [s["sentence"] for s in got["none"]] == ["It is so.", "Or not."] and got["none"][1]["citations"] == [] and len(got["none"][0]["citations"]) == 1
    assert [s["sentence"] for s in got["pre"]] == ["Asked in English."] and [s["sentence"] for s in got["post"]] == ["<Translate to ROM>"] * 2


def test_small_operators(spark):
    row = spark.createDataFrame([("One [1]. Two [3, 2]. Three [9].", ["a", "b", "c"], "[1, 2.5]", "x")], "answer string, cits array<string>, v string, bad string")
    facts = row.select(X.cited_facts(F.col("answer"), F.col("cits")).alias("f")).first()["f"]
    assert [(f["text"], f["citations"]) for f in facts] == [("One.", ["a"]), ("Two.", ["b", "c"]), ("Three.", [])]
    assert row.select(X.vector(F.col("v")), X.vector(F.col("bad")), X.shrunk(F.lit("w " * 1200), 1200, 1), X.shrunk(F.lit("w " * 900), 600, 9)).first()[:] == ([1.0, 2.5], None, "w " * 699 + "w", "w " * 499 + "w")
    c = spark.createDataFrame([('[[{"citation_url": "u", "multilingual": {"eng": {"id": "1"}, "deu": {"id": "3"}, "ron": {"id": "2"}}}, {"original_url": "v", "multilingual": {"ron": {"id": "2"}, "deu": {"id": "3"}, "eng": {"id": "1"}}}]]',)], "c string")
    cs = c.select(F.flatten(C.citation_lists(F.col("c"))).alias("cs"))
    assert cs.select(F.size(C.language_groups(F.col("cs")))).first()[0] == 1
    one = cs.select(F.explode("cs").alias("c")).select(C.citation_json(F.col("c")).alias("j"), F.map_keys(C.in_languages(F.col("c.multilingual"), "ron")).alias("k")).collect()
    assert [json.loads(r["j"])["original_url"] for r in one] == ["u", "v"] and all(sorted(r["k"]) == ["eng", "ron"] for r in one)
    runs = evaluation.registry(spark)
    assert {r["model"]: len(r["names"]) for r in evaluation.by_model(runs).collect()} == {m: 12 for m in evaluation.MODELS}
    scores = spark.createDataFrame([("r", "b", 1.0), ("r", "a", 2.0), ("r", "a", 4.0), ("p", "b", 0.5)], "metric string, model string, value double")
    assert {r["metric"]: (r["b"], r["a"]) for r in evaluation.metric_table(scores, ["b", "a"]).collect()} == {"r": (1.0, 3.0), "p": (0.5, None)}


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError, match="checkpoint"):
        scratch_dir(Session())
