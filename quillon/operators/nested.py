"""Problem 4: nested answers as flat tables with links to their parents."""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.jsonindex import OPEN_ARRAY, OPEN_OBJECT, SCALAR, STRING, Index
from ..session import spread

#: Bytes of JSON indexed at once, about.
BLOCK = 2_000_000
#: Numbers of a range that travel in one row; longer ranges are several.
SPAN = 4096


class Citations(NamedTuple):
    """Citations of a block of texts: index, token, row of the text, places of fact and citation."""

    index: Index
    token: np.ndarray
    row: np.ndarray
    fact: np.ndarray
    place: np.ndarray


def _unwrapped(text: str) -> bytes:
    """The text, or, if it is a JSON string, what that string holds."""
    while text.lstrip()[:1] == '"':
        try:
            inner = json.loads(text)
        except ValueError:
            break
        if not isinstance(inner, str):
            break
        text = inner
    return text.encode("utf-8", "replace")


def blocks(texts: list[str | None]) -> Iterator[tuple[list[int], Index]]:
    """The texts that aren't null, indexed in blocks, with their rows."""
    rows: list[int] = []
    held: list[bytes] = []
    size = 0
    for i, t in enumerate(texts):
        if t is not None:
            rows.append(i)
            held.append(_unwrapped(t))
            size += len(held[-1])
            if size > BLOCK:
                yield rows, Index(held)
                rows, held, size = [], [], 0
    if rows:
        yield rows, Index(held)


def _elements(index: Index, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The elements of arrays, objects as arrays of one: (element, place, the token it came from)."""
    arrays, single = tokens[index.kind[tokens] == OPEN_ARRAY], tokens[index.kind[tokens] == OPEN_OBJECT]
    inner = index.inside(arrays)
    element = np.r_[inner, single]
    return element, np.r_[index.pos[inner], np.zeros(len(single), dtype=np.int64)], np.r_[index.parent[inner], single]


def _lookup(keys: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    table = np.full(size, -1, dtype=np.int64)
    table[keys] = values
    return table


def answer_citations(rows: list[int], index: Index) -> Citations:
    """Citations of answers: of the facts of each, a fact or citation that stands alone being an array of one."""
    n = len(index.kind)
    roots = index.roots()
    objects = roots[index.kind[roots] == OPEN_OBJECT]
    facts_of = index.named(index.inside(objects), "facts")
    wrapped = index.parent[facts_of]
    fact, place, _ = _elements(index, np.r_[roots[~np.isin(roots, wrapped)], facts_of])
    fact, place = fact[index.kind[fact] == OPEN_OBJECT], place[index.kind[fact] == OPEN_OBJECT]
    place_of = _lookup(fact, place, n)
    holder = index.named(index.inside(fact), "citations")
    citation, at, source = _elements(index, holder)
    keep = index.kind[citation] == OPEN_OBJECT
    citation, at, source = citation[keep], at[keep], source[keep]
    return Citations(index, citation, np.array(rows, dtype=np.int64)[index.doc[citation]], place_of[index.parent[source]], at)


def list_citations(rows: list[int], index: Index) -> Citations:
    """Citations in arrays of arrays: every object of them, one level or two down, or alone."""
    outer, place, _ = _elements(index, index.roots())
    inner, at, source = _elements(index, outer)
    place_of = _lookup(outer, place, len(index.kind))
    keep = index.kind[inner] == OPEN_OBJECT
    inner, at, source = inner[keep], at[keep], source[keep]
    return Citations(index, inner, np.array(rows, dtype=np.int64)[index.doc[inner]], place_of[source], at)


def languages(c: Citations) -> list[tuple[int, str, str]]:
    """(position in c, language in small letters, id without outer blanks) of each language version that has an id."""
    index = c.index
    nth = _lookup(c.token, np.arange(len(c.token)), len(index.kind))
    holder = index.named(index.inside(c.token), "multilingual")
    maps, arrays = holder[index.kind[holder] == OPEN_OBJECT], holder[index.kind[holder] == OPEN_ARRAY]
    entries = index.inside(maps)
    out: list[tuple[int, str, str]] = []
    for t in entries[index.kind[entries] == STRING].tolist():
        out.append((int(nth[index.parent[index.parent[t]]]), index.text(index.key[t]), index.text(t)))
    deep = entries[index.kind[entries] == OPEN_OBJECT]
    ids = index.named(index.inside(deep), "id")
    for t in ids[np.isin(index.kind[ids], (STRING, SCALAR))].tolist():
        entry = index.parent[t]
        out.append((int(nth[index.parent[index.parent[entry]]]), index.text(index.key[entry]), index.text(t) if index.kind[t] == STRING else _plain(index.text(t))))
    listed = index.inside(arrays)
    listed = listed[index.kind[listed] == OPEN_OBJECT]
    fields = index.inside(listed)
    lang_of = {int(index.parent[t]): index.text(t) for t in index.named(fields, "lang").tolist() if index.kind[t] == STRING}
    ids = index.named(fields, "id")
    for t in ids[np.isin(index.kind[ids], (STRING, SCALAR))].tolist():
        entry = int(index.parent[t])
        if entry in lang_of:
            out.append((int(nth[index.parent[index.parent[entry]]]), lang_of[entry], index.text(t) if index.kind[t] == STRING else _plain(index.text(t))))
    return [(i, lang.strip().lower(), key.strip()) for i, lang, key in out if key.strip()]


def _plain(scalar: str) -> str:
    return "" if scalar in ("null", "true", "false") else scalar


def spans(text: str) -> Iterator[tuple[int, int]]:
    """First and last of the runs of numbers in a list of numbers and ranges such as `3, 5-7`; none for a reversed range.

    A run has SPAN numbers at most; runs are given one by one, however wide a range is. Numbers of more than 18 digits
    number no paragraph.
    """
    for part in text.replace(";", ",").split(","):
        ends = [x.strip() for x in part.replace("–", "-").replace("—", "-").split("-")]
        if len(ends) <= 2 and all(e.isdecimal() and len(e.lstrip("0")) <= 18 for e in ends):
            first, last = int(ends[0]), int(ends[-1])
            for low in range(first, last + 1, SPAN):
                yield low, min(low + SPAN - 1, last)


def paragraphs(c: Citations) -> Iterator[tuple[int, int, int]]:
    """(position in c, first, last) of each run of paragraph numbers of the citations."""
    index = c.index
    nth = _lookup(c.token, np.arange(len(c.token)), len(index.kind))
    holder = index.named(index.inside(c.token), "citation_paragraphs")
    single = holder[np.isin(index.kind[holder], (STRING, SCALAR))]
    inner = index.inside(holder[index.kind[holder] == OPEN_ARRAY])
    inner = inner[np.isin(index.kind[inner], (STRING, SCALAR))]
    owner = np.r_[nth[index.parent[single]], nth[index.parent[index.parent[inner]]]]
    for t, o in zip(np.r_[single, inner].tolist(), owner.tolist()):
        raw = index.text(t)
        if index.kind[t] == SCALAR and raw.endswith(".0"):
            raw = raw[:-2]
        for low, high in spans(raw):
            yield o, low, high


def lowest_children(pairs: DataFrame) -> DataFrame:
    """Distinct lowest children of the answers of question_generations, linked to fact and citation by place.

    Columns: guide_id, group_id, grouping_method, model_name, fact_pos int, citation_pos int, child_kind, child_lang,
    child_key. Places count from 0 and count nulls; see answer_citations, languages, paragraphs for the forms taken.
    Null, blank and unreadable answers give no rows, nor do rows with a null in the key. Repeated rows give one. Other
    columns don't take part. Ranges of numbers leave Python as their ends, SPAN numbers in each, and are laid out row by
    row after that. One shuffle, of the distinct rows.
    """
    key = ["guide_id", "group_id", "grouping_method", "model_name"]
    rows = spread(pairs.where(" AND ".join(f"{k} IS NOT NULL" for k in key) + " AND answer IS NOT NULL").select(*key, "answer"))
    schema = ", ".join(f"{k} {pairs.schema[k].dataType.simpleString()}" for k in key) + ", fact_pos int, citation_pos int, child_lang string, child_key string, low long, high long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for numbers_, index in blocks(batch.column("answer").to_pylist()):
                c = answer_citations(numbers_, index)
                told = ((i, lang, key_, 0, 0) for i, lang, key_ in languages(c))
                told = itertools.chain(told, ((i, "", None, low, high) for i, low, high in paragraphs(c)))
                while found := list(itertools.islice(told, 200_000)):
                    nth = np.array([f[0] for f in found], dtype=np.int64)
                    at = pa.array(c.row[nth])
                    yield pa.RecordBatch.from_arrays(
                        [*(batch.column(k).take(at) for k in key), pa.array(c.fact[nth].astype(np.int32)), pa.array(c.place[nth].astype(np.int32)), *(pa.array([f[i] for f in found], kind) for i, kind in ((1, pa.string()), (2, pa.string()), (3, pa.int64()), (4, pa.int64())))],
                        names=[*key, "fact_pos", "citation_pos", "child_lang", "child_key", "low", "high"],
                    )

    flat = rows.mapInArrow(run, schema).withColumn("n", F.explode(F.sequence("low", "high")))
    kind = F.when(F.col("child_key").isNull(), "paragraph").otherwise("language").alias("child_kind")
    return flat.select(*key, "fact_pos", "citation_pos", kind, "child_lang", F.coalesce("child_key", F.col("n").cast("string")).alias("child_key")).distinct()


def node_table(texts: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """Every value of every readable JSON text as a row: keys, node long, parent long (null at the root), key, pos, kind, value.

    node numbers a text's values in order of their beginning; kind is object, array, string or scalar; value is the text
    of a string or scalar, else null. Null and unreadable texts give no rows; repeated rows give repeated nodes.
    """
    rows = spread(texts.where(F.col(text_col).isNotNull()).select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(text_col).alias("text")))
    ks = [f"k{i}" for i in range(len(keys))]
    schema = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in ks) + ", node long, parent long, key string, pos int, kind string, value string"
    names = {OPEN_OBJECT: "object", OPEN_ARRAY: "array", STRING: "string", SCALAR: "scalar"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for numbers_, x in blocks(batch.column("text").to_pylist()):
                t = np.flatnonzero(x.value)
                first = np.searchsorted(x.doc[t], np.arange(len(numbers_)))
                node = np.arange(len(t)) - first[x.doc[t]]
                number = _lookup(t, node, len(x.kind) + 1)
                up = [None if p < 0 else int(number[p]) for p in x.parent[t].tolist()]
                at = pa.array(np.array(numbers_, dtype=np.int64)[x.doc[t]])
                leaf = np.isin(x.kind[t], (STRING, SCALAR)).tolist()
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).take(at) for k in ks), pa.array(node), pa.array(up, pa.int64()), pa.array([x.text(k) if k >= 0 else None for k in x.key[t].tolist()], pa.string()), pa.array(x.pos[t].astype(np.int32)), pa.array([names[k] for k in x.kind[t].tolist()], pa.string()), pa.array([x.text(i) if is_leaf else None for i, is_leaf in zip(t.tolist(), leaf)], pa.string())],
                    names=[*ks, "node", "parent", "key", "pos", "kind", "value"],
                )

    return rows.mapInArrow(run, schema).select(*[F.col(k).alias(name) for k, name in zip(ks, keys)], "node", "parent", "key", "pos", "kind", "value")
