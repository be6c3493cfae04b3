"""Documents from several tiers: cache, store, fetcher."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..operators.judgments import html_paragraphs
from ..session import stored

MISSING = "Paragraph missing"


class Fetcher(Protocol):
    def get(self, case_id: str) -> str | None: ...


class NoFetcher:
    """Offline: nothing is found."""

    def get(self, case_id: str) -> str | None:
        return None


def with_retry(call: Callable, *args: object, retries: int = 3, delay: float = 1.0) -> object:
    """call(*args), tried again where it fails: `retries` times at most, waiting twice as long each time; the last error is raised."""
    for attempt in range(retries):
        try:
            return call(*args)
        except Exception:
            if attempt + 1 == retries:
                raise
            time.sleep(delay * 2**attempt)
    return None


class RetryingFetcher:
    """A fetcher that tries again, and gives None where it fails for good."""

    def __init__(self, fetcher: Fetcher, retries: int = 3, delay: float = 1.0) -> None:
        self.fetcher, self.retries, self.delay = fetcher, retries, delay

    def get(self, case_id: str) -> str | None:
        try:
            return with_retry(self.fetcher.get, case_id, retries=self.retries, delay=self.delay)
        except Exception:  # noqa: BLE001
            return None


def observed(df: DataFrame, name: str, **conditions: str) -> tuple[DataFrame, Observation]:
    """df and its counters, filled when df is run: `rows` and, for each name, the rows that meet its condition."""
    counters = Observation(name)
    return df.observe(counters, F.count(F.lit(1)).alias("rows"), *[F.count_if(F.expr(c)).alias(n) for n, c in conditions.items()]), counters


def fetch_judgments(wanted: DataFrame, cache: DataFrame, store: DataFrame, fetcher: Fetcher) -> tuple[DataFrame, DataFrame]:
    """Texts of wanted (case_id, paragraph_number): (rows with paragraph_text and tier, new cache rows).

    A case is read from the cache, else parsed from the store's HTML (not of placeholders, not an error in JSON), else
    from what the fetcher gives. A known case without the paragraph has the text MISSING; an unknown case has null.
    """
    cached = cache.where("case_id IS NOT NULL").groupBy("case_id", "paragraph_number").agg(F.min("paragraph_text").alias("paragraph_text"))
    cases = wanted.select("case_id").distinct().join(cached.select("case_id").distinct(), "case_id", "left_anti")
    good = store.where("coalesce(lower(isplaceholder), 'false') <> 'true' AND html <> '' AND NOT startswith(ltrim(html), '{')").groupBy(F.col("_id").alias("case_id")).agg(F.max("html").alias("html"))
    kept = cases.join(good, "case_id")

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pdf.assign(html=[fetcher.get(c) for c in pdf["case_id"]])
            yield out[out["html"].notna()]

    web = cases.join(good.select("case_id"), "case_id", "left_anti").mapInPandas(ask, "case_id string, html string")
    pages = stored(kept.withColumn("tier", F.lit("store")).unionByName(web.withColumn("tier", F.lit("web"))))
    fresh = stored(html_paragraphs(pages.select(F.col("case_id").alias("_id"), "html")).withColumnRenamed("_id", "case_id"))
    tiers = cached.select("case_id").distinct().withColumn("tier", F.lit("cache")).unionByName(pages.select("case_id", "tier"))
    every = cached.unionByName(fresh)
    out = wanted.join(every, ["case_id", "paragraph_number"], "left").join(tiers, "case_id", "left")
    return out.withColumn("paragraph_text", F.coalesce("paragraph_text", F.when(F.col("tier").isNotNull(), MISSING))), fresh


def download_report(results: DataFrame) -> DataFrame:
    """Numbers of files by status (success, unavailable, error)."""
    return results.groupBy("status").agg(F.count("*").alias("n"))
