"""Recall of the index against brute force, and odd rows."""

import numpy as np

from quillon.llm import knn


def brute(rows, k=5):
    ids = [r[0] for r in rows]
    x = np.array([r[1] for r in rows], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -9)
    return {tuple(sorted((ids[i], ids[j]))) for i in range(len(ids)) for j in np.argsort(-s[i])[:k] if i != j}


def vectors(n, seed=0):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(max(1, n // 20), 96))
    x = centers[rng.integers(len(centers), size=n)] + 0.3 * rng.normal(size=(n, 96))
    return [(f"q{i}", (x[i] * rng.uniform(0.5, 3)).astype(np.float32).tolist()) for i in range(n)]


def test_recall(spark):
    rows = vectors(3000)
    want = brute(rows)
    got = {(r["a"], r["b"]) for r in knn.neighbours(spark.createDataFrame(rows, "query string, embedding array<float>").repartition(3)).collect()}
    assert len(got & want) >= 0.97 * len(want) and len(got & want) >= 0.97 * len(got)


def test_blocks_and_chunks_give_the_same(spark, monkeypatch):
    df = spark.createDataFrame(vectors(600), "query string, embedding array<float>")
    want = {tuple(r) for r in knn.neighbours(df).collect()}
    monkeypatch.setattr(knn, "BLOCK", 7)
    monkeypatch.setattr(knn, "CHUNK", 90)
    got = {tuple(r) for r in knn.neighbours(df).collect()}
    assert len(got & want) >= 0.98 * len(want)


def test_odd_rows(spark):
    rows = vectors(30)
    nan, inf = float("nan"), float("inf")
    bad = [("n1", None), (None, rows[0][1]), ("n2", rows[0][1][:95]), ("n3", [0.0] * 96), ("n4", [nan] + rows[0][1][1:]), ("n5", [inf] + rows[0][1][1:]), ("n6", [None] + rows[0][1][1:]), rows[3], rows[3]]
    df = spark.createDataFrame(rows + bad, "query string, embedding array<float>").selectExpr("*", "1 AS id", "2 AS vid", "3 AS cell")
    assert {tuple(r) for r in knn.neighbours(df).collect()} == brute(rows)
    assert knn.similar_queries(df.limit(0)).count() == 0
    assert {tuple(r) for r in knn.neighbours(df.where("query IN ('q1', 'q2', 'q3')")).collect()} == {("q1", "q2"), ("q1", "q3"), ("q2", "q3")}
    assert knn.neighbours(df.where("query = 'q1'")).count() == 0
