"""Ranks within groups of any size: no group is ever ordered by one task.

Rows are range-partitioned by group and value; each partition counts its own, and only the totals of partitions (one
number for each partition and group in it) are summed across them.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored


def joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """left with the other columns of right where all keys are the same, null being the same as null; without keys right has one row."""
    renamed = right.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    if not keys:
        return left.crossJoin(F.broadcast(renamed))
    on = functools.reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)))
    return left.join(renamed, on, how).drop(*[f"_k{i}" for i in range(len(keys))])


def counted_before(rows: DataFrame, n: str, group: list[str], order: list[str], out: str = "before") -> DataFrame:
    """rows with the sum of n (a whole number) over the rows of their group that come before them in ascending order (nulls first).

    Rows of a group must differ in order. Stored once, so that the partitions stay as they are.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = stored(rows.repartitionByRange(parts, *group, *order).withColumn("_part", F.spark_partition_id()))
    totals = spread.groupBy("_part", *group).agg(F.sum(n).alias("_n"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_offset", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    within = Window.partitionBy("_part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = spread.withColumn("_within", F.coalesce(F.sum(n).over(within), F.lit(0)))
    return joined(ranked, offsets, ["_part", *group]).select(*rows.columns, (F.col("_offset") + F.col("_within")).alias(out))


def with_average_rank(rows: DataFrame, value: str, out: str, *group: str, descending: bool = False) -> DataFrame:
    """rows with the rank of value within the group from 1, ties sharing their mean; null values have none."""
    v = -F.col(value) if descending else F.col(value)
    counts = rows.where(F.col(value).isNotNull()).groupBy(*group, v.alias("_v")).agg(F.count("*").alias("_n"))
    ranks = counted_before(counts, "_n", list(group), ["_v"], "_before").select(*group, "_v", (F.col("_before") + (F.col("_n") + 1) / 2.0).alias(out))
    return joined(rows.withColumn("_v", v), ranks, [*group, "_v"], "left").drop("_v")


def with_min_max(rows: DataFrame, value: str, out: str, *group: str) -> DataFrame:
    """rows with value scaled to 0..1 within the group; unchanged where all are equal."""
    ends = rows.groupBy(*group).agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    scaled = F.when(F.col("_high") > F.col("_low"), (F.col(value) - F.col("_low")) / (F.col("_high") - F.col("_low"))).otherwise(F.col(value))
    return joined(rows, ends, list(group)).withColumn(out, scaled).drop("_low", "_high")


def adjusted_p(tests: DataFrame, p: str, *order: str, out: str = "p_adjusted", tests_in_all: int | None = None) -> DataFrame:
    """tests with p adjusted by Benjamini and Hochberg, over all rows; order makes the ranks of equal p definite. Null p has none and doesn't count.

    tests_in_all: how many tests were made, if tests holds only the smaller p of them.

    The least of the later partitions, one number for each, is all that passes between them.
    """
    known = counted_before(tests.where(F.col(p).isNotNull()).withColumn("_one", F.lit(1)), "_one", [], [p, *order], "_before").drop("_one")
    m = tests.where(F.col(p).isNotNull()).count() if tests_in_all is None else tests_in_all
    parts = int(tests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    raw = stored(known.withColumn("_raw", F.col(p) * m / (F.col("_before") + 1)).repartitionByRange(parts, "_before").withColumn("_part", F.spark_partition_id()))
    least = raw.groupBy("_part").agg(F.min("_raw").alias("_least"))
    later = Window.orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    later_least = least.withColumn("_later", F.min("_least").over(later)).drop("_least")
    own = F.min("_raw").over(Window.partitionBy("_part").orderBy(F.desc("_before")).rowsBetween(Window.unboundedPreceding, 0))
    done = raw.withColumn("_own", own).join(later_least, "_part")
    kept = done.select(*tests.columns, F.least(F.lit(1.0), "_own", "_later").alias(out))
    return kept.unionByName(tests.where(F.col(p).isNull()).withColumn(out, F.lit(None).cast("double")))
