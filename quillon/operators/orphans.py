"""Problem 3: references to records that do not exist.

Parents' keys are range-partitioned and lie in each range as one sorted array; references come to their range in
batches and are found by binary search. Ranges are cut by the keys of references and parents alike, so that each holds
about as many rows; a key with very many references (a case cited by a third of all records) is a range of its own,
whose references are split by salt and whose one parent is repeated for each part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.jsonindex import SCALAR, STRING
from ..functions.urls import normalise_url
from ..session import spread, stored
from .nested import Citations, _lookup, answer_citations, blocks, languages, list_citations

#: References and parents in a range or part of one, about; ranges at most; keys sampled for the bounds of each range.
PART, RANGES, SAMPLED = 150_000, 65_536, 16
REFERENCE = "src_table string, guide_id string, unit_id string, grouping_method string, model_name string, ref_field string, ref_key string, cited_at timestamp_ntz, period string"


def _urls(c: Citations) -> tuple[list[tuple[int, str]], dict[int, str]]:
    """(position in c, normalised URL) of the citations that have one, and their years."""
    index = c.index
    nth = _lookup(c.token, np.arange(len(c.token)), len(index.kind))
    fields = index.inside(c.token)
    url: dict[int, str] = {}
    for name in ("citation_url", "original_url"):  # the second goes before the first
        for t in index.named(fields, name).tolist():
            if index.kind[t] == STRING and (text := index.text(t)).strip():
                url[int(nth[index.parent[t]])] = text
    years = {int(nth[index.parent[t]]): index.text(t) for t in index.named(fields, "citation_year").tolist() if index.kind[t] in (STRING, SCALAR)}
    return [(i, normalise_url(u)) for i, u in url.items()], years


def _bounds(keys: DataFrame, rows: int) -> list[str]:
    """Least keys of the ranges but the first, from a sample of ref_key by hash of the row; a key that is several bounds gets a range of its own."""
    ranges = max(1, min(RANGES, -(-rows // PART)))
    if ranges == 1:
        return []
    sample = sorted(r["ref_key"] for r in keys.select("ref_key", "h").orderBy("h", "ref_key").limit(SAMPLED * ranges).collect())
    cut = [sample[len(sample) * i // ranges] for i in range(1, ranges)]
    often = {a for a, b in zip(cut, cut[1:]) if a == b}
    return sorted({*cut, *(k + "\0" for k in often)})


def _placed(rows: DataFrame, bounds: list[str]) -> DataFrame:
    """rows with the number of the range of their ref_key."""
    shared = rows.sparkSession.sparkContext.broadcast(np.array(bounds, dtype=object))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = np.searchsorted(shared.value, batch.column("ref_key").to_numpy(zero_copy_only=False), side="right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place)], names=[*batch.schema.names, "range"])

    return rows.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", range int")


def _references(rows: DataFrame, kind: str) -> DataFrame:
    """References in rows (k0..k3, cited_at, text) of kind `answers` or `lists`, distinct within batches."""
    cited = answer_citations if kind == "answers" else list_citations
    table = "question_generations" if kind == "answers" else "citation_extractions"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [batch.column(f"k{i}").to_pylist() for i in range(4)]
            when = batch.column("cited_at").to_pylist()
            for numbers, index in blocks(batch.column("text").to_pylist()):
                c = cited(numbers, index)
                urls, years = _urls(c)
                found = {(int(c.row[i]), "original_url", u, years.get(i, "") if kind == "answers" else "") for i, u in urls}
                found |= {(int(c.row[i]), "multilingual", key, years.get(i, "") if kind == "answers" else "") for i, _, key in languages(c)}
                ordered = sorted(found)
                at = [f[0] for f in ordered]
                periods = [f[3] for f in ordered] if kind == "answers" else [when[i].strftime("%Y-%m") if when[i] else "" for i in at]
                ref = [f[2] for f in ordered]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([table] * len(at), pa.string()), *(pa.array([keys[k][i] for i in at], pa.string()) for k in range(4)), pa.array([f[1] for f in ordered], pa.string()), pa.array(ref, pa.string()),
                        pa.array([when[i] for i in at], pa.timestamp("us")), pa.array(["" if p in ("null", "true", "false") else p for p in periods], pa.string()),
                    ],
                    names=[f.split()[0] for f in REFERENCE.split(", ")],
                )

    return rows.mapInArrow(run, REFERENCE)


def _parents(meta_cache: DataFrame, catalogue: DataFrame) -> DataFrame:
    """One row for each key: ref_field, ref_key, first_at (null: never late), gone (each of its rows is a placeholder)."""
    urls = meta_cache.where("url IS NOT NULL").groupBy(F.col("url").alias("ref_key")).agg(
        F.when(F.count_if(F.col("created_at").isNull()) == 0, F.min("created_at").cast("timestamp_ntz")).alias("first_at"), F.lit(False).alias("gone"),
    )
    held = F.coalesce(F.lower(F.trim("isplaceholder")) == "true", F.lit(False))
    ids = catalogue.where("_id IS NOT NULL").groupBy(F.trim("_id").alias("ref_key")).agg(F.lit(None).cast("timestamp_ntz").alias("first_at"), F.every(held).alias("gone"))
    return urls.select(F.lit("original_url").alias("ref_field"), "ref_key", "first_at", "gone").unionByName(ids.select(F.lit("multilingual").alias("ref_field"), "ref_key", "first_at", "gone"))


def orphan_references(answers: DataFrame, extractions: DataFrame, meta_cache: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Distinct references without their target, with the period of the citing record.

    Columns: src_table, guide_id, unit_id, grouping_method, model_name, ref_field, ref_key, status (`missing`, `deleted`,
    `late`), period (citation_year for answers, year and month of updated_at for extractions, '' if there is none).
    Null and empty references, unreadable JSON and records with a null in their key don't count; of several versions of
    an extraction the one of greatest updated_at counts (ties: the greatest citations). Empty parents make every
    reference missing. Other columns don't take part. The driver gets SAMPLED keys
    and a number for each range; a range has about PART rows.
    """
    spark = answers.sparkSession
    key = ["guide_id", "group_id", "grouping_method", "model_name"]
    a = spread(answers.where(" AND ".join(f"{k} IS NOT NULL" for k in key) + " AND answer IS NOT NULL").select(
        F.col("guide_id").alias("k0"), F.col("group_id").cast("string").alias("k1"), F.col("grouping_method").alias("k2"), F.col("model_name").alias("k3"), F.lit(None).cast("timestamp_ntz").alias("cited_at"), F.col("answer").alias("text"),
    ))
    e = extractions.where("guide_id IS NOT NULL AND paragraph_id IS NOT NULL").groupBy("guide_id", "paragraph_id").agg(F.max(F.struct(F.col("updated_at").cast("timestamp_ntz").alias("cited_at"), F.col("citations").alias("text"))).alias("m"))
    e = e.select(F.col("guide_id").alias("k0"), F.col("paragraph_id").alias("k1"), F.lit("").alias("k2"), F.lit("").alias("k3"), "m.cited_at", "m.text").where("text IS NOT NULL")
    parents = stored(_parents(meta_cache, catalogue))
    refs = stored(_references(a, "answers").unionByName(_references(e, "lists")))
    keys = refs.select("ref_key", F.xxhash64(*refs.columns).alias("h")).unionByName(parents.select("ref_key", F.xxhash64("ref_field", "ref_key").alias("h")))
    bounds = _bounds(keys, refs.count() + parents.count())
    refs = _placed(refs, bounds) if bounds else refs.withColumn("range", F.lit(0))
    load = {r["range"]: r["count"] for r in refs.groupBy("range").count().collect()}
    parts = {r: -(-n // (2 * PART)) for r, n in load.items()}

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Parents to every part of their range that has references."""
        for pdf in batches:
            times = pdf["range"].map(lambda r: parts.get(r, 0)).to_numpy(dtype=np.int64)
            out = pdf.loc[pdf.index.repeat(times)]
            yield out.assign(part=(np.arange(len(out)) - np.repeat(np.cumsum(times) - times, times)).astype(np.int32))

    ranged = _placed(parents, bounds) if bounds else parents.withColumn("range", F.lit(0))
    placed = ranged.mapInPandas(place, "ref_field string, ref_key string, first_at timestamp_ntz, gone boolean, range int, part int")
    salts = F.create_map(*[F.lit(x) for r, n in sorted(parts.items()) if n > 1 for x in (r, n)]) if any(n > 1 for n in parts.values()) else None
    many = F.coalesce(F.try_element_at(salts, F.col("range")), F.lit(1)) if salts is not None else F.lit(1)
    probes = refs.withColumn("part", F.pmod(F.xxhash64("guide_id", "unit_id", "grouping_method", "model_name", "ref_key"), many).cast("int"))

    def probe(batch: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        status = np.full(len(batch), "missing", dtype=object)
        for field in ("original_url", "multilingual"):
            own = np.flatnonzero((batch["ref_field"] == field).to_numpy())
            known = there[there["ref_field"] == field].sort_values("ref_key")
            if not len(own) or not len(known):
                continue
            keys = known["ref_key"].to_numpy(dtype=object)
            wanted = batch["ref_key"].to_numpy(dtype=object)[own]
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            hit = keys[at] == wanted
            gone = known["gone"].to_numpy(dtype=bool)[at]
            late = (known["first_at"].to_numpy(dtype="datetime64[us]")[at] > batch["cited_at"].to_numpy(dtype="datetime64[us]")[own])  # not so if either is none
            status[own[hit]] = np.where(gone, "deleted", np.where(late, "late", ""))[hit]
        keep = status != ""
        return batch[keep].assign(status=status[keep])[["src_table", "guide_id", "unit_id", "grouping_method", "model_name", "ref_field", "ref_key", "status", "period"]]

    out = "src_table string, guide_id string, unit_id string, grouping_method string, model_name string, ref_field string, ref_key string, status string, period string"
    return probes.groupBy("range", "part").cogroup(placed.groupBy("range", "part")).applyInPandas(probe, out).distinct()


def orphans_by_period(found: DataFrame) -> DataFrame:
    """Numbers of orphan references: (src_table, period, ref_field, status, n)."""
    return found.groupBy("src_table", "period", "ref_field", "status").agg(F.count("*").alias("n"))
