"""Problem 7: the corpus as token ids of a public tokenizer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread
from .bpe import NAME, TOKENIZERS, vocabulary


def encode_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = TOKENIZERS, tokenizer: str = NAME) -> DataFrame:
    """One row (id_col, ids) for each row of docs, repeats included: the ids of the whole text, without special tokens.

    A null text and an empty text have the empty list; strings that look like special tokens are ordinary text. Other
    columns of docs, whatever their names, don't take part. An empty table gives an empty table. No shuffle, unless the
    scan has fewer partitions than there are cores.
    """
    rows = spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = vocabulary(folder, tokenizer).encode
        for batch in batches:
            lists = [encode(t) for t in batch.column("text").to_pylist()]
            ends = np.zeros(len(lists) + 1, dtype=np.int32)
            np.cumsum([len(x) for x in lists], out=ends[1:])
            flat = np.fromiter((i for x in lists for i in x), dtype=np.int32, count=int(ends[-1]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["id", "ids"])

    return rows.mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = TOKENIZERS, tokenizer: str = NAME) -> DataFrame:
    """One row (id_col, n_tokens long) for each row of docs: the length of the list of encode_corpus."""
    rows = spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = vocabulary(folder, tokenizer).count
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([count(t) for t in batch.column("text").to_pylist()], pa.int64())], names=["id", "n_tokens"])

    return rows.mapInArrow(run, f"id {kind}, n_tokens long").withColumnRenamed("id", id_col)
