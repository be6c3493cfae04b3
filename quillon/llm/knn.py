"""Problem 5: the k most similar vectors of every vector.

An inverted file: coarse centroids cut the vectors into cells, a product quantiser codes what is left of each vector in
a few bytes. A cell's vectors search their own cell and the nearest others together, so what travels to a cell are
codes, never whole vectors: the search adds up asymmetric distance tables (whole query, coded candidate) and keeps the
best few. These are ranked exactly where they live: the query goes to their cells, which are seldom more than two.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import spread, stored

DIM = 96
#: Vectors the index is fitted on at most (those of least hash of their id): this many, or so many for each cell; every vector is indexed.
SAMPLE, SAMPLED_PER_CELL = 30_000, 8
#: Cells searched for each vector at least, candidates that must lie in them at least, candidates ranked exactly.
PROBES, REACH, RERANKED = 10, 512, 48
#: Bytes of a code.
CODE = 48
#: Vectors of a cell and coded candidates in one group at most, about.
BLOCK, CHUNK = 16_384, 200_000
#: Centroids up to which they are fitted at once.
AT_ONCE = 1024


def usable(embedding: Column, dim: int = DIM) -> Column:
    """Whether the vector has dim finite numbers, not all zero; false for null."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(embedding) == dim) & finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def _kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7, spherical: bool = False) -> np.ndarray:
    k = min(k, len(x))
    rng = np.random.default_rng(seed)
    centers = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        home = _nearest(x, centers)
        order = np.argsort(home, kind="stable")
        cells, begin = np.unique(home[order], return_index=True)
        centers[cells] = np.add.reduceat(x[order], begin, axis=0) / np.diff([*begin, len(x)])[:, None].astype(np.float32)
        if empty := k - len(cells):
            centers[np.setdiff1d(np.arange(k), cells)] = x[rng.choice(len(x), empty)]
        if spherical:
            centers /= np.maximum(np.linalg.norm(centers, axis=1, keepdims=True), 1e-12)
    return centers


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Index of the nearest center of each row, in blocks."""
    half = (centers**2).sum(axis=1) / 2
    return np.concatenate([(x[i : i + 4096] @ centers.T - half).argmax(axis=1) for i in range(0, len(x), 4096)] or [np.zeros(0, dtype=np.int64)])


def _centroids(x: np.ndarray, k: int) -> np.ndarray:
    """k centroids of unit length, about; many are fitted in two levels, each part getting its share."""
    if k <= AT_ONCE:
        return _kmeans(x, k, spherical=True)
    home = _nearest(x, _kmeans(x, round(math.sqrt(k)), spherical=True))
    return np.concatenate([_kmeans(part, max(1, round(k * len(part) / len(x))), spherical=True) for c in np.unique(home) for part in [x[home == c]]])


class Index(NamedTuple):
    """Fitted centroids (cells x dim) and codebooks (CODE x 256 x dim/CODE)."""

    coarse: np.ndarray
    books: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, cells: int) -> Index:
        coarse = _centroids(x, cells)
        rest = x - coarse[_nearest(x, coarse)]
        part = rest.shape[1] // CODE
        books = [_kmeans(np.ascontiguousarray(rest[:, i * part : (i + 1) * part]), 256, rounds=6) for i in range(CODE)]
        full = np.zeros((CODE, 256, part), dtype=np.float32)
        for i, b in enumerate(books):
            full[i, : len(b)] = b
            full[i, len(b) :] = b[0]
        return cls(coarse, full)

    def code(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell and code of each row."""
        cell = _nearest(x, self.coarse)
        rest = x - self.coarse[cell]
        part = rest.shape[1] // CODE
        codes = [_nearest(np.ascontiguousarray(rest[:, i * part : (i + 1) * part]), self.books[i]) for i in range(CODE)]
        return cell.astype(np.int32), np.stack(codes, axis=1).astype(np.uint8)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Asymmetric distance tables: the product of each query's part with each entry of that part's codebook (CODE x 256 x queries)."""
        part = q.shape[1] // CODE
        return np.stack([self.books[i] @ q[:, i * part : (i + 1) * part].T for i in range(CODE)])

    def rounded(self, tables: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tables in 16 bits, and the scale of each query by which no sum over them can overflow."""
        scale = 32_000 / (1.01 + np.abs(tables).max(axis=1).sum(axis=0))
        return np.rint(tables * scale).astype(np.int16), scale

    def scores(self, q: np.ndarray, tables: np.ndarray, scale: np.ndarray, cell: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Similarity, to scale, (candidates x queries) of coded candidates, summed over the tables."""
        near, which = np.unique(cell, return_inverse=True)
        out = np.rint((self.coarse[near] @ q.T) * scale).astype(np.int16)[which]
        step = np.empty_like(out)
        for table, entry in zip(tables, codes.T.astype(np.intp)):
            np.take(table, entry, axis=0, out=step, mode="clip")
            out += step
        return out


def _unit(column: pa.Array, dim: int) -> np.ndarray:
    """The vectors of a column of lists, at length 1."""
    v = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    v /= np.abs(v).max(axis=1, keepdims=True)  # against overflow
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def _binary(x: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(x.shape[1] * x.itemsize), len(x), [None, pa.py_buffer(np.ascontiguousarray(x))]).cast(pa.binary())


def _floats(column: pd.Series, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.float32).reshape(-1, dim)


def _within(times: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each number of times."""
    return np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)


def _top(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k greatest of each row, unordered."""
    return np.broadcast_to(np.arange(scores.shape[1]), scores.shape) if scores.shape[1] <= k else np.argpartition(-scores, k - 1, axis=1)[:, :k]


class _Plan(NamedTuple):
    """Which cells search which: for each cell the (home, chunks) that want its codes, flattened with their number; parts of each cell."""

    homes: np.ndarray
    chunks: np.ndarray
    times: np.ndarray
    blocks: np.ndarray
    split: np.ndarray

    @classmethod
    def of(cls, coarse: np.ndarray, sizes: np.ndarray, probes: int) -> _Plan:
        cells = len(coarse)
        wanted_by: list[list[tuple[int, int]]] = [[] for _ in range(cells)]
        blocks, split = np.maximum(-(-sizes // BLOCK), 1), np.ones(cells, dtype=np.int64)
        for home in np.flatnonzero(sizes).tolist():
            near = np.argsort(-(coarse @ coarse[home]), kind="stable")
            near = np.concatenate([[home], near[near != home]])
            near = near[: max(probes, int(np.searchsorted(np.cumsum(sizes[near]), REACH)) + 1)]
            split[home] = -(-int(sizes[near].sum()) // CHUNK)
            for c in near.tolist():
                if sizes[c]:
                    wanted_by[c].append((home, int(split[home])))
        flat = np.array([w for ws in wanted_by for w in ws], dtype=np.int64).reshape(-1, 2)
        return cls(flat[:, 0], flat[:, 1], np.array([len(w) for w in wanted_by], dtype=np.int64), blocks.astype(np.int64), split)

    def block(self, vid: np.ndarray, cell: np.ndarray) -> np.ndarray:
        return (vid // 7) % self.blocks[cell]


def neighbours(vectors: DataFrame, k: int = 5, id_col: str = "query", vector_col: str = "embedding", dim: int = DIM, probes: int = PROBES, reranked: int = RERANKED) -> DataFrame:
    """Rows (a, b) of ids, a < b: pairs of which at least one is among the k most similar (by cosine) of the other.

    Rows with a null id or an unusable vector take no part; of rows that share an id one counts, that of the least
    usable vector. Ties at the k-th place go to the vector of lower internal number. With fewer than k + 1 vectors each
    has all others; an empty table gives no rows. Other columns don't take part. There are as many cells as the root of
    the number of vectors, so that a cell, what it searches and how often a code is copied (once for each cell that
    searches its own) stay in proportion; a cell of more than BLOCK vectors is split. The index is fitted on at most
    SAMPLE vectors or SAMPLED_PER_CELL for each cell; all are indexed and searched. The driver gets the sample and a
    number for each cell.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType.simpleString()
    pairs = f"a {kind}, b {kind}"
    base = stored(
        spread(vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<float>").alias("v")))
        .where(F.col("id").isNotNull() & usable(F.col("v"), dim)).groupBy("id").agg(F.min("v").alias("v"))
        .withColumn("vid", F.monotonically_increasing_id())
    )
    n = base.count()
    if n < 2:
        return spark.createDataFrame([], pairs)
    cells = max(1, round(math.sqrt(n)))
    some = base.select(F.xxhash64("id").alias("h"), "vid", "v").orderBy("h", "vid").limit(max(SAMPLE, SAMPLED_PER_CELL * cells)).select("v").toArrow()
    fitted = Index.fit(_unit(some.column("v").combine_chunks(), dim), cells)
    del some
    index = spark.sparkContext.broadcast(fitted)

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, times = np.unique(_nearest(_unit(batch.column("v"), dim), index.value.coarse), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(times, pa.int64())], names=["cell", "n"])

    sizes = np.zeros(len(fitted.coarse), dtype=np.int64)
    for r in base.select("v").mapInArrow(home, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        sizes[r["cell"]] = r["n"]
    plan = spark.sparkContext.broadcast(_Plan.of(fitted.coarse, sizes, probes))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Codes to every group that searches them."""
        p = plan.value
        begin = np.cumsum(p.times) - p.times
        for batch in batches:
            cell, codes = index.value.code(_unit(batch.column("v"), dim))
            vid = batch.column("vid").to_numpy()
            row = np.repeat(np.arange(len(cell)), p.times[cell])
            way = begin[cell[row]] + _within(p.times[cell])
            blocks = p.blocks[p.homes[way]]
            block = _within(blocks)
            row, way = np.repeat(row, blocks), np.repeat(way, blocks)
            yield pa.RecordBatch.from_arrays(
                [pa.array(p.homes[way].astype(np.int32)), pa.array(block.astype(np.int32)), pa.array((vid[row] % p.chunks[way]).astype(np.int32)), pa.array(vid[row]), pa.array(cell[row]), _binary(codes[row])],
                names=["home", "block", "chunk", "vid", "cell", "code"],
            )

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries to every chunk of their own cell's search; chunk 0 is also where the cell's vectors lie."""
        p = plan.value
        for batch in batches:
            v, vid = _unit(batch.column("v"), dim), batch.column("vid").to_numpy()
            cell = _nearest(v, index.value.coarse)
            row = np.repeat(np.arange(len(cell)), p.split[cell])
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell[row].astype(np.int32)), pa.array(p.block(vid, cell)[row].astype(np.int32)), pa.array(_within(p.split[cell]).astype(np.int32)), pa.array(vid[row]), _binary(v[row])],
                names=["home", "block", "chunk", "vid", "v"],
            )

    def search(queries: pd.DataFrame, codes: pd.DataFrame) -> pd.DataFrame:
        """The best candidates of each query by asymmetric distance, by the cell and block where they lie; v only where that isn't the query's own."""
        if not len(queries) or not len(codes):
            return pd.DataFrame({"cell": [], "block": [], "vid": [], "v": [], "found": []})
        ix, p = index.value, plan.value
        codes = codes.sort_values("vid", ignore_index=True)
        vid, cell = codes["vid"].to_numpy(np.int64), codes["cell"].to_numpy(np.int64)
        code = np.frombuffer(b"".join(codes["code"]), dtype=np.uint8).reshape(-1, CODE)
        whole, asked = _floats(queries["v"], dim), queries["vid"].to_numpy(np.int64)
        place = cell << 32 | p.block(vid, cell)
        own_place = int(queries["home"].iloc[0]) << 32 | int(queries["block"].iloc[0])
        out: list[pd.DataFrame] = []
        for first in range(0, len(whole), 256):  # with 512 candidates at once, what the sums touch stays in the cache
            q, own = whole[first : first + 256], asked[first : first + 256]
            tables, scale = ix.rounded(ix.tables(q))
            best_s, best_i = np.zeros((len(q), 0), dtype=np.int16), np.zeros((len(q), 0), dtype=np.int64)
            for at in range(0, len(vid), 4096):
                end = min(at + 4096, len(vid))
                scores = np.concatenate([ix.scores(q, tables, scale, cell[i : min(i + 512, end)], code[i : min(i + 512, end)]) for i in range(at, end, 512)]).T
                self_ = np.searchsorted(vid[at:end], own)
                hit = np.flatnonzero((self_ < end - at) & (vid[at:end][np.minimum(self_, end - at - 1)] == own))
                scores[hit, self_[hit]] = -32_767
                top = _top(scores, reranked)
                best_s = np.concatenate([best_s, np.take_along_axis(scores, top, 1)], axis=1)
                best_i = np.concatenate([best_i, at + top], axis=1)
                keep = _top(best_s, reranked)
                best_s, best_i = np.take_along_axis(best_s, keep, 1), np.take_along_axis(best_i, keep, 1)
            asker, found = np.repeat(np.arange(len(q)), best_i.shape[1]), best_i.ravel()
            other = vid[found] != own[asker]
            asker, found = asker[other], found[other]
            order = np.lexsort((place[found], asker))
            asker, found = asker[order], found[order]
            where = place[found]
            begin = np.flatnonzero(np.r_[True, (asker[1:] != asker[:-1]) | (where[1:] != where[:-1])]) if len(found) else np.zeros(0, dtype=np.int64)
            at, to = where[begin], asker[begin]
            out.append(pd.DataFrame({"cell": at >> 32, "block": at & 0xFFFFFFFF, "vid": own[to], "v": [None if a == own_place else q[i].tobytes() for a, i in zip(at.tolist(), to.tolist())], "found": np.split(vid[found], begin[1:]) if len(begin) else []}))
        return pd.concat(out, ignore_index=True)

    group = ["home", "block", "chunk"]
    queries = base.select("vid", "v").mapInArrow(ask, "home int, block int, chunk int, vid long, v binary")
    codes = base.select("vid", "v").mapInArrow(send, "home int, block int, chunk int, vid long, cell int, code binary").groupBy(*group)
    visits = queries.groupBy(*group).cogroup(codes).applyInPandas(search, "cell int, block int, vid long, v binary, found array<long>")

    def rank(asked: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        """The k best, by whole vectors, of what each visiting query wants from a cell."""
        if not len(asked) or not len(there):
            return pd.DataFrame({"vid": [], "y": [], "s": []})
        there = there.sort_values("vid")
        ids, whole = there["vid"].to_numpy(np.int64), _floats(there["v"], dim)
        out = []
        for first in range(0, len(asked), 4096):
            part = asked.iloc[first : first + 4096]
            vid = part["vid"].to_numpy(np.int64)
            own = part["v"].isna().to_numpy()
            query = np.empty((len(part), dim), dtype=np.float32)
            query[own] = whole[np.searchsorted(ids, vid[own])]
            if not own.all():
                query[~own] = _floats(part["v"][~own], dim)
            asker = np.repeat(np.arange(len(part)), part["found"].str.len().to_numpy(np.int64))
            at = np.searchsorted(ids, np.concatenate(part["found"].to_numpy()))
            scores = np.einsum("ij,ij->i", whole[at].astype(np.float64), query[asker].astype(np.float64))
            order = np.lexsort((ids[at], -scores, asker))
            asker, at, scores = asker[order], at[order], scores[order]
            best = np.arange(len(asker)) - np.searchsorted(asker, asker) < k
            out.append(pd.DataFrame({"vid": vid[asker[best]], "y": ids[at[best]], "s": -scores[best]}))
        return pd.concat(out, ignore_index=True)

    there = queries.where("chunk = 0").select(F.col("home").alias("cell"), "block", "vid", "v").groupBy("cell", "block")
    ranked = visits.groupBy("cell", "block").cogroup(there).applyInPandas(rank, "vid long, y long, s double")
    # what a query found in several cells or chunks comes together here: k times their number at most
    edges = ranked.groupBy(F.col("vid").alias("x")).agg(F.slice(F.array_sort(F.collect_list(F.struct("s", "y"))), 1, k).alias("best")).select("x", F.explode("best.y").alias("y"))
    edges = edges.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    names = base.select("vid", "id")
    named = edges.join(names.withColumnRenamed("vid", "x").withColumnRenamed("id", "p"), "x").join(names.withColumnRenamed("vid", "y").withColumnRenamed("id", "q"), "y")
    return named.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))


def similar_queries(query_embeddings: DataFrame) -> DataFrame:
    """neighbours() of query_embeddings, as (query_a, query_b)."""
    return neighbours(query_embeddings).select(F.col("a").alias("query_a"), F.col("b").alias("query_b"))
