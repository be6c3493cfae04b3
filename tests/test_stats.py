"""Ranks, tests and their p-values."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from quillon.functions.ranking import with_average_rank, with_min_max
from quillon.operators import stats

RANKED = [([3.0, 2.0, 1.0], [1, 2, 3]), ([1.0, 2.0, 2.0], [3, 1.5, 1.5]), ([0.5, 0.33, 0.33], [1, 2.5, 2.5]), ([0.33, 0.33, 0.33], [2, 2, 2]), ([3.0, 2.0, 1.0], [1, 2, 3])]


@pytest.mark.parametrize(("scores", "want"), RANKED)
def test_ranks(spark, scores, want):
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(scores)], "g int, i int, s double")
    ranked = with_average_rank(with_min_max(df, "s", "v", "g"), "v", "r", "g", descending=True)
    assert [r["r"] for r in ranked.orderBy("i").collect()] == want


def test_t_p_values():
    assert stats.t_p_value(0.0, 5) == pytest.approx(1)
    assert stats.t_p_value(2.570582, 5) == pytest.approx(0.05, abs=1e-6)
    assert stats.t_p_value(12.706205, 1) == pytest.approx(0.05, abs=1e-6)


def test_wilcoxon_exact_p_by_enumeration():
    n = 7
    sums = [sum(c) for k in range(n + 1) for c in itertools.combinations(range(1, n + 1), k)]
    for w in range(0, n * (n + 1) // 4 + 1):
        assert stats.wilcoxon_p_value(w, n, 0) == pytest.approx(min(1, 2 * sum(s <= w for s in sums) / 2**n))


def test_wilcoxon_and_t(spark):
    rows = [("x", 1.0, 2.0), ("x", 2.0, 2.0), ("x", 3.0, 1.0), ("x", 4.0, 7.0), ("x", None, 1.0), ("y", 1.0, 1.0), ("y", 2.0, 2.0)]
    df = spark.createDataFrame(rows, "g string, a double, b double")
    w = {r["g"]: r for r in stats.wilcoxon(df, "g").collect()}
    assert (w["x"]["n_pairs"], w["x"]["n"], w["x"]["statistic"]) == (4, 3, 2.0)
    assert (w["y"]["n"], w["y"]["statistic"], w["y"]["p"]) == (0, 0.0, 1.0)
    t = {r["g"]: r for r in stats.paired_t(df, "g").collect()}
    assert t["x"]["t"] == pytest.approx(0.5 / (math.sqrt(sum((d - 0.5) ** 2 for d in (1, 0, -2, 3)) / 3) / 2))
    assert t["y"]["cohens_d"] == 0
    assert stats.wilcoxon(df.limit(0), "g").count() == 0


def test_bh(spark):
    p = [0.01, 0.04, 0.03, 0.005, 0.5]
    got = [r["p_adjusted"] for r in stats.benjamini_hochberg(spark.createDataFrame(list(enumerate(p)), "i int, p double"), "p", "i").orderBy("p").collect()]
    assert got == pytest.approx([0.025, 0.025, 0.05, 0.05, 0.5])
    assert all(a >= b for a, b in zip(got, sorted(p)))


def test_spearman(spark):
    df = spark.createDataFrame([("g", float(i), float(i * i)) for i in range(6)], "g string, a double, b double")
    r = stats.spearman(df, "g").first()
    assert r["rho"] == pytest.approx(1) and r["n"] == 6
    assert df.where(F.lit(False)).count() == 0


def average_ranks(values):
    return [sum(v < x for v in values) + (sum(v == x for v in values) + 1) / 2 for x in values]


def test_ranks_over_many_partitions(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice(["a", "a", "a", None, "b"]), i, rnd.choice([None, 1.0, 2.5, float(rnd.randint(0, 300))])) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, i int, v double").repartition(5)
    got = {r["i"]: r["r"] for r in with_average_rank(df, "v", "r", "g").collect()}
    for g in ("a", "b", None):
        own = [(i, v) for h, i, v in rows if h == g and v is not None]
        assert {i: got[i] for i, _ in own} == dict(zip([i for i, _ in own], average_ranks([v for _, v in own])))
    assert len(got) == 900 and all(got[i] is None for _, i, v in rows if v is None)
    assert with_average_rank(df.limit(0), "v", "r", "g").count() == 0


def test_adjusted_p_over_many_partitions(spark):
    rnd = random.Random(6)
    p = [(i, rnd.choice([None, rnd.random(), rnd.random() / 100, 0.25])) for i in range(400)]
    known = sorted((x, i) for i, x in p if x is not None)
    want, least = {}, 1.0
    for k in range(len(known), 0, -1):
        least = min(least, known[k - 1][0] * len(known) / k)
        want[known[k - 1][1]] = least
    got = {r["i"]: r["p_adjusted"] for r in stats.benjamini_hochberg(spark.createDataFrame(p, "i int, p double"), "p", "i").collect()}
    assert {i: got[i] for i in want} == pytest.approx(want) and all(got[i] is None for i, x in p if x is None)


def test_wilcoxon_variants(spark):
    rows = [(1.0, 1.0), (2.0, 2.0), (1.0, 2.0), (1.0, 3.0), (5.0, 2.0)]
    df = spark.createDataFrame(rows, "a double, b double")
    r = stats.wilcoxon(df, zeros="pratt").first()
    # ranks of |d| = 0, 0, 1, 2, 3 with the zeros: 1.5, 1.5, 3, 4, 5
    assert (r["n"], r["n_ties"], r["statistic"], r["ties_pct"]) == (3, 2, 5.0, 0.4)
    assert stats.wilcoxon(df, least=6).count() == 0 and stats.wilcoxon(df).first()["statistic"] == 3.0


def test_pairs_of_configurations(spark):
    scores = {("base", "x"): [1, 0, 1, 1, 0, 1], ("base", "y"): [0, 0, 1, 1, 1, 1], ("legal", "x"): [1, 1, 1, 0, 0, None]}
    rows = [(*c, i, None if v is None else float(v)) for c, vs in scores.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "doc string, query string, id int, score double")
    every = stats.wilcoxon_of_configurations(df, ["doc", "query"], "id", "score").collect()
    assert {(r["a_doc"], r["a_query"], r["b_doc"], r["b_query"], r["n_pairs"]) for r in every} == {("base", "x", "base", "y", 6), ("base", "x", "legal", "x", 5), ("base", "y", "legal", "x", 5)}
    assert len(stats.wilcoxon_of_configurations(df, ["doc", "query"], "id", "score", {"doc": "base", "query": "x"}, least=6).collect()) == 1
    a, b = df.where("doc = 'base' AND query = 'x'"), df.where("doc = 'base' AND query = 'y'")
    assert [(r["a"], r["b"]) for r in stats.by_position(a, b, "id", "score").orderBy("position").collect()] == list(zip(scores["base", "x"], scores["base", "y"]))
    with pytest.raises(ValueError, match="by position"):
        stats.by_position(a, b.limit(2), "id", "score")


def test_pooled_spearman(spark):
    groups = [[("a", 3.0), ("b", 2.0), ("c", 1.0)], [("a", 1.0), ("b", 2.0), ("c", 2.0)]]
    rows = [(g, s, i + 1) for g, items in enumerate(groups) for i, (_, s) in enumerate(items)]
    r = stats.pooled_spearman(spark.createDataFrame(rows, "g int, score double, position int"), "g").first()
    auto, expert = [1, 2, 3, 3, 1.5, 1.5], [1, 2, 3, 1, 2, 3]
    x, y = average_ranks(auto), average_ranks(expert)
    mx, my = sum(x) / 6, sum(y) / 6
    want = sum((p - mx) * (q - my) for p, q in zip(x, y)) / math.sqrt(sum((p - mx) ** 2 for p in x) * sum((q - my) ** 2 for q in y))
    assert r["n"] == 6 and r["rho"] == pytest.approx(want)
