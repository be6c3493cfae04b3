"""Sinks: upserts, first-write-wins, versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """One row for each key: the last by the order columns (nulls first), so that the last write wins."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc_nulls_last(c) for c in order])
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """existing with the rows of new in place of those with their keys; of several, the last by order."""
    fresh = latest(new, keys, *order)
    return existing.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh, allowMissingColumns=True)


def insert_if_absent(existing: DataFrame, new: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """existing with those rows of new whose key it lacks, the first by order."""
    w = Window.partitionBy(*keys).orderBy(*[F.asc_nulls_last(c) for c in order])
    first = new.join(existing.select(*keys).distinct(), keys, "left_anti").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return existing.unionByName(first, allowMissingColumns=True)


def append_versions(existing: DataFrame, new: DataFrame, version: str) -> DataFrame:
    """existing with the rows of new whose version it doesn't have."""
    return existing.unionByName(new.join(existing.select(version).distinct(), version, "left_anti"), allowMissingColumns=True)


def next_versions(history: DataFrame, texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, version, text) to append: one more than the greatest version of the key where the text differs from that version's; 0 for new keys."""
    last = history.groupBy(key).agg(F.max("version").alias("last"), F.max_by(F.sha2(F.col(text), 256), "version").alias("hash"))
    joined = texts.join(last, key, "left").where(F.col("hash").isNull() | (F.sha2(F.col(text), 256) != F.col("hash")))
    return joined.select(key, (F.coalesce("last", F.lit(-1)) + 1).alias("version"), text)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV that read_csv reads back: quotes doubled, line breaks kept."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
