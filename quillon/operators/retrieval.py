"""Exact retrieval over vectors and its metrics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries that are sent to all tasks at most; more are joined in blocks of so many queries and vectors.
QUERY_BLOCK, QUERIES, VECTORS = 4096, 65_536, 50_000
#: Queries scored at once.
TILE = 1024


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a vector is zero."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, F.lit(0.0)).otherwise(dot(a, b) / norms)


def _best(qid: np.ndarray, q: np.ndarray, vid: np.ndarray, v: np.ndarray, k: int, metric: str) -> pd.DataFrame:
    """The k least scores of each query among the vectors; ties go to the lower id."""
    norm = np.linalg.norm(v, axis=1)
    out = []
    for at in range(0, len(q), TILE):
        own, asked = qid[at : at + TILE], q[at : at + TILE]
        product = asked @ v.T
        if metric == "cosine":
            norms = np.linalg.norm(asked, axis=1)[:, None] * norm[None]
            score = -np.divide(product, norms, out=np.zeros_like(product), where=norms > 0)
        else:
            score = (asked**2).sum(axis=1)[:, None] + (v**2).sum(axis=1)[None] - 2 * product
        score[own[:, None] == vid[None]] = np.inf
        worst = np.partition(score, k - 1, axis=1)[:, k - 1] if score.shape[1] > k else np.full(len(own), np.inf)
        row, column = np.nonzero((score <= worst[:, None]) & np.isfinite(score))
        order = np.lexsort((vid[column], score[row, column], row))
        row, column = row[order], column[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        row, column = row[place < k], column[place < k]
        out.append(pd.DataFrame({"query_id": own[row], "vec_id": vid[column], "score": score[row, column]}))
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})


def top_k(queries: DataFrame, vectors: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
    """The k best vectors of each query: (query_id, vec_id, rank int, score double); exact.

    queries and vectors have (id, embedding). score is the cosine (best: greatest) or the squared distance (best: least);
    ties go to the lower id; a query is not its own answer. A zero vector has cosine 0; vectors that are null, of another
    dimension than the queries or hold nulls or NaN take no part.
    Up to QUERY_BLOCK queries, which are counted first, are sent to each partition of the vectors. More are cut into
    blocks of QUERIES, vectors into blocks of VECTORS, and each two blocks meet in one group: queries are copied for each
    block of vectors, vectors for each block of queries. Either way each gives its own k best, of which the best k are
    kept, and nothing but the queries of the first way passes through the driver.
    """
    spark = vectors.sparkSession
    sound = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x))
    asked = queries.where(sound).select(F.col("id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("q"))
    n, least, most = asked.agg(F.count("*"), F.min(F.size("q")), F.max(F.size("q"))).first()
    if n and least != most:
        raise ValueError("queries of different dimensions")
    whole = vectors.where(sound & (F.size("embedding") == (most or 0))).select(F.col("id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    out = "query_id long, vec_id long, score double"
    matrix = lambda column: np.array(column.tolist(), dtype=np.float64)
    if n <= QUERY_BLOCK:
        rows = asked.collect()
        shared = spark.sparkContext.broadcast((np.array([r[0] for r in rows], dtype=np.int64), np.array([r[1] for r in rows], dtype=np.float64)))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            qid, q = shared.value
            for pdf in batches:
                if len(pdf) and len(qid):
                    yield _best(qid, q, pdf["vec_id"].to_numpy(np.int64), matrix(pdf["v"]), k, metric)

        best = whole.mapInPandas(run, out)
    else:
        q_blocks, v_blocks = -(-n // QUERIES), max(1, -(-whole.count() // VECTORS))
        block = lambda name, number: F.pmod(F.xxhash64(name), F.lit(number)).cast("int")
        every = lambda number: F.explode(F.sequence(F.lit(0), F.lit(number - 1)))
        left = asked.select(block("query_id", q_blocks).alias("i"), every(v_blocks).alias("j"), "query_id", "q").groupBy("i", "j")
        right = whole.select(every(q_blocks).alias("i"), block("vec_id", v_blocks).alias("j"), "vec_id", "v").groupBy("i", "j")

        def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if not len(a) or not len(b):
                return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
            return _best(a["query_id"].to_numpy(np.int64), matrix(a["q"]), b["vec_id"].to_numpy(np.int64), matrix(b["v"]), k, metric)

        best = left.cogroup(right).applyInPandas(meet, out)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "vec_id", F.col("rank").cast("int").alias("rank"), (-F.col("score") if metric == "cosine" else F.greatest(F.col("score"), F.lit(0.0))).alias("score"))


def precision(found: Column, gold: Column) -> Column:
    return F.when(F.size(F.array_distinct(found)) == 0, 0.0).otherwise(F.size(F.array_intersect(found, gold)) / F.size(F.array_distinct(found)))


def recall(found: Column, gold: Column) -> Column:
    """With no gold: 1 if nothing was found, else 0."""
    return F.when(F.size(gold) == 0, F.when(F.size(found) == 0, 1.0).otherwise(0.0)).otherwise(F.size(F.array_intersect(found, gold)) / F.size(F.array_distinct(gold)))


def recall_or_null(found: Column, gold: Column, k: int) -> Column:
    """Recall of the first k; null where there is no gold."""
    return F.when(F.size(gold) > 0, F.size(F.array_intersect(F.slice(found, 1, k), gold)) / F.size(F.array_distinct(gold)))


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r))


def reciprocal_rank(found: Column, gold: Column) -> Column:
    hit = F.array_min(F.filter(F.transform(found, lambda x, i: F.when(F.array_contains(gold, x), i + 1)), lambda x: x.isNotNull()))
    return F.coalesce(1.0 / hit, F.lit(0.0))


def ndcg(found: Column, gold: Column, k: int) -> Column:
    """Binary gain; a repeated hit counts each time."""
    gains = F.transform(F.slice(found, 1, k), lambda x, i: F.when(F.array_contains(gold, x), 1.0 / F.log2(i + F.lit(2.0))).otherwise(0.0))
    got = F.aggregate(gains, F.lit(0.0), lambda s, x: s + x)
    ideal = F.aggregate(F.transform(F.sequence(F.lit(1), F.greatest(F.least(F.size(gold), F.lit(k)), F.lit(1))), lambda i: 1.0 / F.log2(i + F.lit(1.0))), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(gold) == 0, 0.0).otherwise(got / ideal)


def evaluation(found: Column, gold: Column, k: int) -> dict[str, Column]:
    """The five metrics of the first k found, by name."""
    first = F.slice(found, 1, k)
    p, r = precision(first, gold), recall(first, gold)
    return {f"precision@{k}": p, f"recall@{k}": r, f"f1@{k}": f1(p, r), f"mrr@{k}": reciprocal_rank(first, gold), f"ndcg@{k}": ndcg(found, gold, k)}


def evaluate(runs: DataFrame, config: list[str], ks: tuple[int, ...] = (10, 20)) -> DataFrame:
    """Means of the five metrics at each k by configuration: config, n_questions, n_recall (questions with some gold), the metrics.

    runs: config, found array, gold array, one row a question; a null list is an empty one.
    """
    found, gold = (F.coalesce(F.col(c), F.array().cast(runs.schema[c].dataType)) for c in ("found", "gold"))
    metrics = {name: c for k in ks for name, c in evaluation(found, gold, k).items()}
    rows = runs.select(*config, recall_or_null(found, gold, ks[0]).alias("_r"), *[c.alias(name) for name, c in metrics.items()])
    return rows.groupBy(*config).agg(F.count("*").alias("n_questions"), F.count("_r").alias("n_recall"), *[F.avg(name).alias(name) for name in metrics])
