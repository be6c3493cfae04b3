"""Orphan references on a small fixture with each status."""

import datetime
import json

from quillon.operators import orphans

T = [datetime.datetime(2025, m, 1) for m in range(1, 6)]
U = "https://h.example/eng?i=001-"


def tables(spark, extra=()):
    cite = lambda n, *ids, **k: {"original_url": f"{U}{n}" if n is not None else None, "citation_year": 2001, "multilingual": {f"l{i}": {"id": x} for i, x in enumerate(ids)}, **k}
    ext = [
        ("g", "1", json.dumps([[cite(1, "001-1", "001-9"), cite(2)], []]), T[1]), ("g", "1", json.dumps([[cite(7)]]), T[0]),  # an older version
        ("g", "2", json.dumps([[cite(3, "", None), cite(None), cite(4, " 001-5 ")]]), T[1]), ("g", "3", "not json", T[1]), ("g", "4", None, T[1]), (None, "5", json.dumps([[cite(8)]]), T[1]),
    ]
    ans = [("g", 1, "m", "x", json.dumps([{"citations": [cite(2), {"citation_url": "https://h.example/eng#%7B%22itemid%22:[%22001-6%22]%7D"}]}])), ("g", 2, "m", "x", "broken ["), ("g", 3, "m", "x", None), *extra]
    return (
        spark.createDataFrame(ans, "guide_id string, group_id int, grouping_method string, model_name string, answer string"),
        spark.createDataFrame(ext, "guide_id string, paragraph_id string, citations string, updated_at timestamp"),
        spark.createDataFrame([(U + "1", T[0]), (U + "2", T[3]), (U + "2", T[4]), (U + "3", T[4]), (U + "3", None), (None, T[0])], "url string, created_at timestamp"),
        spark.createDataFrame([("001-1", "TRUE"), ("001-1", "true"), ("001-5", "true"), ("001-5", None)], "_id string, isplaceholder string"),
    )


WANT = {
    ("citation_extractions", "g", "1", "", "", "multilingual", "001-1", "deleted", "2025-02"), ("citation_extractions", "g", "1", "", "", "multilingual", "001-9", "missing", "2025-02"),
    ("citation_extractions", "g", "1", "", "", "original_url", U + "2", "late", "2025-02"), ("citation_extractions", "g", "2", "", "", "original_url", U + "4", "missing", "2025-02"), ("question_generations", "g", "1", "m", "x", "original_url", U + "6", "missing", ""),
}


def test_each_status(spark):
    assert {tuple(r) for r in orphans.orphan_references(*tables(spark)).collect()} == WANT


def test_salted_ranges_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(orphans, "PART", 2)
    assert {tuple(r) for r in orphans.orphan_references(*tables(spark)).collect()} == WANT


def test_a_key_cited_by_most_has_a_range_of_its_own(spark, monkeypatch):
    monkeypatch.setattr(orphans, "PART", 40)
    ids = ["001-5"] * 300 + [f"001-{i}" for i in range(100, 400)]
    ans = [("g", i, "m", "x", json.dumps([{"citations": [{"multilingual": {"eng": {"id": x}}}]}])) for i, x in enumerate(ids)]
    there = [(x, None) for x in sorted(set(ids)) if not x.endswith("7")]
    answers = spark.createDataFrame(ans, "guide_id string, group_id int, grouping_method string, model_name string, answer string")
    empty = tables(spark)
    found = orphans.orphan_references(answers, empty[1].limit(0), empty[2], spark.createDataFrame(there, "_id string, isplaceholder string")).collect()
    assert sorted(r["ref_key"] for r in found) == sorted(x for x in ids if x.endswith("7"))
    keys = spark.createDataFrame([(x, i) for i, x in enumerate(ids)], "ref_key string, h int")
    bounds = orphans._bounds(keys, len(ids))
    assert "001-5" in bounds and "001-5\0" in bounds and bounds == sorted(set(bounds))


def test_empty_tables(spark):
    t = tables(spark)
    assert orphans.orphan_references(*(x.limit(0) for x in t)).count() == 0
    alone = orphans.orphan_references(t[0], t[1], t[2].limit(0), t[3].limit(0)).collect()
    assert {r["status"] for r in alone} == {"missing"}
    assert orphans.orphans_by_period(orphans.orphan_references(*t)).count() == 5
