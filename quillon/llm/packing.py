"""Problem 8: texts packed into containers of a fixed number of tokens.

Sizes are whole numbers up to the capacity, so the items are fully described by how many there are of each size: at
most `capacity` numbers, however large the corpus. The packer works on these numbers and on patterns (the sizes in one
container, with how often it is used), so its work doesn't grow with the corpus either. The items are then ordered by
size, so that a partition holds few sizes, and take their places by their rank among those of their size, which every
partition works out alone from its offset.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed, stored
from .bpe import NAME, TOKENIZERS
from .encode import count_tokens

#: Tokens in a container.
CAPACITY = 2048


class _Stock:
    """The sizes still unpacked, with their numbers."""

    def __init__(self, counts: dict[int, int]) -> None:
        self.counts = {s: n for s, n in counts.items() if n > 0 and s > 0}
        self.sizes = sorted(self.counts)

    def most(self, limit: int) -> int:
        """The greatest size up to the limit; 0 if there is none."""
        i = bisect_right(self.sizes, limit)
        return self.sizes[i - 1] if i else 0

    def take(self, size: int, n: int = 1) -> None:
        self.counts[size] -= n
        if not self.counts[size]:
            del self.counts[size]
            self.sizes.remove(size)

    def put(self, size: int) -> None:
        if size not in self.counts:
            self.sizes.insert(bisect_right(self.sizes, size), size)
            self.counts[size] = 0
        self.counts[size] += 1

    def two(self, gap: int, more_than: int) -> tuple[int, int] | None:
        """The two items that fill the gap best, if they fill more of it than more_than."""
        best, found = more_than, None
        i, j = 0, bisect_right(self.sizes, gap) - 1
        while i <= j:
            a, b = self.sizes[i], self.sizes[j]
            if a + b > gap or (i == j and self.counts[a] < 2):
                j -= 1
            else:
                if a + b > best:
                    best, found = a + b, (a, b)
                    if best == gap:
                        break
                i += 1
        return found


def best_two_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Patterns and how often each is used; together they hold exactly the given numbers of items of each size.

    A container begins with the greatest size left and takes the greatest that fits until none does. Then its smallest
    item (not the first) gives way to the two unpacked items that fill the gap it leaves more tightly, if there are
    such, for as long as that helps. The pattern is then used as often as the numbers left allow.
    """
    stock, patterns = _Stock(counts), []
    while stock.sizes:
        pattern: list[int] = []
        gap = capacity
        while size := stock.most(gap):
            stock.take(size)
            pattern.append(size)
            gap -= size
        while gap and len(pattern) > 1:
            small = pattern[-1]
            if not (pair := stock.two(gap + small, small)):
                break
            pattern.pop()
            stock.put(small)
            for size in pair:
                stock.take(size)
            pattern = sorted([*pattern, *pair], reverse=True)
            gap = capacity - sum(pattern)
        need = Counter(pattern)
        times = 1 + min(stock.counts.get(s, 0) // n for s, n in need.items())
        for size, n in need.items():
            if times > 1:
                stock.take(size, n * (times - 1))
        patterns.append((pattern, times))
    return patterns


def _places(patterns: list[tuple[list[int], int]], first: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]:
    """By size, in order of rank: where each run of ranks begins, its first container, its items per container, its first offset; then the next free container."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: Counter = Counter()
    container = first
    for pattern, times in patterns:
        at = 0
        for size, n in sorted(Counter(pattern).items(), reverse=True):
            runs.setdefault(size, []).append((ranks[size], container, n, at))
            ranks[size] += n * times
            at += n * size
        container += times
    return {s: tuple(np.array(c, dtype=np.int64) for c in zip(*r)) for s, r in runs.items()}, container  # type: ignore[return-value]


def pack(sized: DataFrame, id_col: str = "doc_id", size_col: str = "n_tokens", capacity: int = CAPACITY) -> DataFrame:
    """The container of each item: (id_col, piece int, tok_start long, n_tokens long, container long, at long).

    sized has a row for each item; rows with a null size are left out, repeated rows are items of their own. An item
    longer than the capacity is cut into full containers and a rest that is packed as any other; no other is cut.
    tok_start is where the piece begins in its item, `at` where it lies in its container. Items of no tokens take no
    room and are spread over the containers in turn. Ties between equal sizes are broken by the position of the row in
    the input. An empty table gives no rows. Other columns don't take part.

    The sizes are taken where the items are, in as many tasks as there are; ids and sizes are then range-partitioned by
    size and checkpointed, since ranks rest on the rows staying in their partitions. A partition holds a run of sizes,
    so that the driver gets and sends at most 2 x partitions + `capacity` numbers, whatever the corpus.
    """
    spark = sized.sparkSession
    kind = sized.schema[id_col].dataType.simpleString()
    last = F.when(F.col("size") <= capacity, F.col("size")).otherwise(F.col("size") % capacity)
    taken = stored(sized.where(F.col(size_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(size_col).cast("long").alias("size"), F.monotonically_increasing_id().alias("pos")))
    items = checkpointed(taken.withColumn("rest", last).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "rest", "pos").select("id", "size", "rest"))
    full = F.when(F.col("size") > capacity, F.floor(F.col("size") / capacity)).otherwise(0)
    # full containers of items count under -1
    counts = items.groupBy(F.spark_partition_id().alias("part"), "rest").agg(F.count("*").alias("n"), F.sum(full).alias("full")).collect()
    totals: Counter = Counter()
    starts: dict[int, dict[int, int]] = {}  # of each partition: how many of a size stand before it
    for r in sorted(counts):
        mine = starts.setdefault(r["part"], {-1: totals[-1]})
        mine[r["rest"]] = totals[r["rest"]]
        totals[r["rest"]] += r["n"]
        totals[-1] += r["full"]
    full_ones, nothing = totals.pop(-1, 0), totals.pop(0, 0)
    places, containers = _places(best_two_fit(totals, capacity), full_ones)
    if nothing and not containers:
        containers = 1
    shared = spark.sparkContext.broadcast(places)
    starts_shared = spark.sparkContext.broadcast(starts)
    local = items.withColumn("part", F.spark_partition_id())
    out = f"id {kind}, piece int, tok_start long, n_tokens long, container long, at long"

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for pdf in batches:
            if not len(pdf):
                continue
            mine = starts_shared.value[int(pdf["part"].iloc[0])]
            size = pdf["size"].to_numpy(np.int64)
            big = size > capacity
            last = np.where(big, size % capacity, size)
            n_full = np.where(big, size // capacity, 0)
            container = np.zeros(len(pdf), dtype=np.int64)
            at = np.zeros(len(pdf), dtype=np.int64)
            order = np.argsort(last, kind="stable")
            values, begin = np.unique(last[order], return_index=True)
            for value, rows in zip(values.tolist(), np.split(order, begin[1:])):
                rank = mine[value] + seen[value] + np.arange(len(rows))
                seen[value] += len(rows)
                if value == 0:
                    container[rows] = rank % containers
                    continue
                first_rank, first, per, offset = shared.value[value]
                run = np.searchsorted(first_rank, rank, side="right") - 1
                within = rank - first_rank[run]
                container[rows] = first[run] + within // per[run]
                at[rows] = offset[run] + within % per[run] * value
            keep = ~(big & (last == 0))
            whole = pd.DataFrame({"id": pdf["id"], "piece": n_full.astype(np.int32), "tok_start": n_full * capacity, "n_tokens": last, "container": container, "at": at})[keep]
            if big.any():
                where = np.repeat(np.arange(len(pdf)), n_full)
                piece = np.arange(len(where)) - np.repeat(np.cumsum(n_full) - n_full, n_full)
                number = mine[-1] + seen[-1] + np.arange(len(where))
                seen[-1] += len(where)
                cut = pd.DataFrame({"id": pdf["id"].to_numpy()[where], "piece": piece.astype(np.int32), "tok_start": piece * capacity, "n_tokens": capacity, "container": number, "at": 0})
                whole = pd.concat([whole, cut], ignore_index=True)
            yield whole

    return local.mapInPandas(assign, out).withColumnRenamed("id", id_col)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, folder: str = TOKENIZERS, tokenizer: str = NAME) -> DataFrame:
    """pack() over the whole texts of docs (doc_id, text) as tokens; null texts are left out."""
    return pack(count_tokens(docs.where(F.col("text").isNotNull()), folder=folder, tokenizer=tokenizer), capacity=capacity)
