"""Structural index against json, nested answers against a plain traversal."""

import json
import random

import pytest

from quillon.functions.jsonindex import Index
from quillon.operators.nested import SPAN, lowest_children, node_table, spans

KEY = "guide_id string, group_id int, question string, answer string, grouping_method string, model_name string, pos int, row int"


def answers(spark, texts):
    return spark.createDataFrame([("g", i, None, t, "m", "x", 9, 9) for i, t in enumerate(texts)], KEY)


def test_validity_is_that_of_json():
    rnd = random.Random(5)
    base = ['{"a": [1, 2, {"b": null}], "c": "x\\\\n\\"y"}', "[]", "{}", "[[],{}]", '"s"', "1.5e3", "[true,false]", '{"a":{"a":{"a":[]}}}', "[1,2", '{"k":"v",}', "", " "]
    for _ in range(4000):
        s = rnd.choice(base)
        for _ in range(rnd.randint(0, 3)):
            i = rnd.randint(0, len(s))
            s = s[:i] + rnd.choice('{}[],:"\\ \n1antué') + s[i + rnd.randint(0, 1) :]
        try:
            json.loads(s)
            ok = True
        except ValueError:
            ok = False
        assert bool(Index([b"[1]", s.encode(), b'{"z":"y"}']).valid[1]) == ok, s


def test_forms(spark):
    cite = {"original_url": "u", "multilingual": {"ENG": {"id": " 001-1 "}, "fre": "001-2", "ron": None, "deu": {"docname": "n"}}, "citation_paragraphs": [3, "5-7", "9, 11", None, "7-5"]}
    facts = [None, {"text": "a", "citations": [None, cite]}, {"text": "b", "citations": {"multilingual": [{"lang": "eng", "id": "001-3"}], "citation_paragraphs": 4}}, {"text": "c", "citations": None}]
    plain = json.dumps(facts)
    texts = [plain, json.dumps(plain), json.dumps({"facts": facts}), json.dumps(facts[2]), None, "", "null", "[]", "{}", '"[]"', plain[:-3], "free text", '[{"text": "' + "x" * 60_000 + '"}]']
    got = {(r["group_id"], r["fact_pos"], r["citation_pos"], r["child_kind"], r["child_lang"], r["child_key"]) for r in lowest_children(answers(spark, texts)).collect()}
    whole = {(1, 1, "language", "eng", "001-1"), (1, 1, "language", "fre", "001-2"), *((1, 1, "paragraph", "", str(k)) for k in (3, 5, 6, 7, 9, 11)), (2, 0, "language", "eng", "001-3"), (2, 0, "paragraph", "", "4")}
    assert got == {(i, *w) for i in (0, 1, 2) for w in whole} | {(3, 0, 0, "language", "eng", "001-3"), (3, 0, 0, "paragraph", "", "4")}


def test_repeats_nulls_and_empty(spark):
    one = '[{"citations": [{"citation_paragraphs": [1]}]}]'
    df = answers(spark, [one]).union(answers(spark, [one]))
    assert lowest_children(df).count() == 1
    assert lowest_children(df.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, 1, None, one, "m", "x", 1, 1)], KEY)
    assert lowest_children(nulls).count() == 0


def numbers(text):
    return [str(k) for low, high in spans(text) for k in range(low, high + 1)]


def test_numbers(spark):
    assert numbers("3, 5–7;9") == ["3", "5", "6", "7", "9"]
    assert numbers("7-5") == numbers("x") == numbers("") == numbers("9" * 5000) == []
    assert next(spans("1-999999999999999")) == (1, SPAN)  # wide ranges come piece by piece
    wide = json.dumps([{"citations": [{"citation_paragraphs": [f"1-{3 * SPAN + 5}", "7"]}]}])
    assert {int(r["child_key"]) for r in lowest_children(answers(spark, [wide])).collect()} == set(range(1, 3 * SPAN + 6))


def test_an_answer_wrapped_in_strings_any_number_of_times(spark):
    text = '[{"citations": [{"citation_paragraphs": [1]}]}]'
    for _ in range(9):
        text = json.dumps(text)
    assert lowest_children(answers(spark, [text])).count() == 1


def test_node_table_rebuilds_the_document(spark):
    doc = {"a": [1, {"b": "x\"\\y\n"}], "c": None, "d": {"e": [], "f": {}}}
    rows = node_table(spark.createDataFrame([(1, json.dumps(doc)), (2, "[1"), (3, None)], "id int, t string"), ["id"], "t").orderBy("node").collect()
    assert {r["id"] for r in rows} == {1}

    def build(node):
        kids = [r for r in rows if r["parent"] == node["node"]]
        if node["kind"] == "object":
            return {r["key"]: build(r) for r in kids}
        if node["kind"] == "array":
            return [build(r) for r in sorted(kids, key=lambda r: r["pos"])]
        return node["value"] if node["kind"] == "string" else json.loads(node["value"])

    assert build(rows[0]) == doc


@pytest.mark.parametrize("name", ["sf0.001"])
def test_whole_table_against_plain_traversal(spark, name):
    q = spark.read.parquet(f"/root/testdata/{name}/question_generations.parquet")
    want = set()
    for r in q.collect():
        value = r["answer"]
        try:
            while isinstance(value, str):
                value = json.loads(value)
        except ValueError:
            continue
        value = value.get("facts", value) if isinstance(value, dict) else value
        for i, f in enumerate([value] if isinstance(value, dict) else value or []):
            cited = (f or {}).get("citations") or []
            for j, c in enumerate([cited] if isinstance(cited, dict) else cited):
                c = c or {}
                m = c.get("multilingual") or {}
                found = [(v.get("lang"), v.get("id")) for v in m] if isinstance(m, list) else [(k, v if isinstance(v, str) else (v or {}).get("id")) for k, v in m.items()]
                p = c.get("citation_paragraphs")
                rows = [("language", k.lower(), v.strip()) for k, v in found if v and v.strip()] + [("paragraph", "", n) for x in (p if isinstance(p, list) else [p]) if x is not None for n in numbers(str(x))]
                want |= {(r["guide_id"], r["group_id"], r["grouping_method"], r["model_name"], i, j, *x) for x in rows}
    assert {tuple(r) for r in lowest_children(q).collect()} == want
