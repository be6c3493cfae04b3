"""Problem 2: the token budget of each source, language and topic.

Text is cut into pieces as the tokenizer cuts it; a piece's number of tokens doesn't depend on where it stands. So each
distinct piece is encoded once, and its count is joined to the texts that hold it. Distinct pieces are
range-partitioned, so that a partition holds neighbours in byte order: walked in that order they form a prefix trie, of
which only the path to the current piece is kept. Each node of the path carries the state of the encoding of its
prefix (its last token and how many there are), which the pieces below it share. The counts of the most frequent pieces,
as many as HOT, are sent to all tasks and joined there; the others are joined by a shuffle, in which none is frequent.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import spread, stored
from .bpe import NAME, TOKENIZERS, Vocabulary, vocabulary

#: Distinct pieces a task holds before it passes their counts on.
HELD = 300_000
#: Pieces whose counts are sent to all tasks, at most, and bytes of each: 7 MB in all.
HOT, HOT_BYTES = 100_000, 64
# Language codes and their other spellings.
LANGUAGES = {
    "eng": ("eng", "en"), "fre": ("fre", "fra", "fr"), "ron": ("ron", "rum", "ro"), "deu": ("deu", "ger", "de"), "rus": ("rus", "ru"),
    "ara": ("ara", "ar"), "zho": ("zho", "chi", "zh"), "jpn": ("jpn", "ja", "jp"), "tha": ("tha", "th"), "hin": ("hin", "hi"),
}


def language(code: Column) -> Column:
    """The three-letter code in lower case; null for null and blank; an unknown spelling in lower case as it is."""
    plain = F.nullif(F.regexp_extract(F.lower(F.trim(code)), "^([a-z]*)", 1), F.lit(""))
    known = F.create_map(*[F.lit(x) for code3, spellings in LANGUAGES.items() for s in spellings for x in (s, code3)])
    return F.coalesce(F.try_element_at(known, plain), plain, F.nullif(F.lower(F.trim(code)), F.lit("")))


class PrefixTrie:
    """Token counts of pieces that come in byte order, by states carried along their shared prefixes.

    The state after a prefix is its last token and its number of tokens. The last token of a longer prefix is the one
    suffix of it, among the vocabulary, that goes with the last token of what stands before.
    """

    def __init__(self, vocab: Vocabulary) -> None:
        self.vocab = vocab
        self.longest = max(map(len, vocab.ranks))
        self.path = b""
        self.last: list[int] = [-1]
        self.count: list[int] = [0]

    def __call__(self, piece: bytes) -> int:
        old, n = self.path, len(piece)
        keep, most = 0, min(len(old), n)
        while keep < most and old[keep] == piece[keep]:
            keep += 1
        last, count = self.last, self.count
        del last[keep + 1 :], count[keep + 1 :]
        ranks, goes = self.vocab.ranks, self.vocab.goes
        for end in range(keep + 1, n + 1):
            for start in range(max(0, end - self.longest), end):
                token = ranks.get(piece[start:end])
                if token is not None and (start == 0 or goes(last[start], token)):
                    last.append(token)
                    count.append(count[start] + 1)
                    break
        self.path = piece
        return count[n]


def _pieces(texts: DataFrame, folder: str, tokenizer: str) -> DataFrame:
    """Distinct pieces of the texts with how often they stand there: (piece binary, n long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = vocabulary(folder, tokenizer).split
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([p.encode() for p in held], pa.binary()), pa.array(list(held.values()), pa.int64())], names=["piece", "n"])

        for batch in batches:
            for text in batch.column("text").to_pylist():
                held.update(split(text))
            if len(held) > HELD:
                yield out()
                held.clear()
        yield out()

    return texts.mapInArrow(run, "piece binary, n long").groupBy("piece").agg(F.sum("n").alias("n"))


def piece_counts(texts: DataFrame, folder: str = TOKENIZERS, tokenizer: str = NAME) -> DataFrame:
    """(piece binary, n long, size long) of each distinct piece of the texts (column text): how often it stands there, its number of tokens. Stored."""
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = _pieces(texts, folder, tokenizer).repartitionByRange(parts, "piece").sortWithinPartitions("piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PrefixTrie(vocabulary(folder, tokenizer))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("piece"), batch.column("n"), pa.array([trie(p) for p in batch.column("piece").to_pylist()], pa.int64())], names=["piece", "n", "size"])

    return stored(ordered.mapInArrow(run, "piece binary, n long, size long"))


def _hot(pieces: DataFrame) -> tuple[int, dict[str, int]]:
    """The least number of times from which pieces are sent to all tasks, as a power of two, and the sizes of those pieces."""
    level = F.floor(F.log2("n")).cast("int")
    short = pieces.where(F.length("piece") <= HOT_BYTES)
    by_level = {r["level"]: r["count"] for r in short.groupBy(level.alias("level")).count().collect()}
    least, held = 64, 0
    for i in range(63, -1, -1):
        held += by_level.get(i, 0)
        if held > HOT:
            break
        least = i
    sent = short.where(level >= least).select("piece", "size").toArrow()
    return least, {p.decode(): n for p, n in zip(sent.column("piece").to_pylist(), sent.column("size").to_pylist())}


def token_counts(texts: DataFrame, keys: list[str], pieces: DataFrame, folder: str = TOKENIZERS, tokenizer: str = NAME) -> DataFrame:
    """(keys, n_texts long, n_tokens long) summed over the texts (keys, text) of each combination of keys; pieces: piece_counts of texts that hold all their pieces.

    What is shuffled are a row for each key of a task and the pieces that aren't frequent, never texts.
    """
    least, hot = _hot(pieces)
    shared = texts.sparkSession.sparkContext.broadcast(hot)
    kinds = ", ".join(f"{k} {texts.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, known = vocabulary(folder, tokenizer).split, shared.value
        size_of = known.__getitem__
        held: dict[tuple, list] = {}
        n_held = 0

        def out(types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
            rows = [(key, t, n, None, 0) for key, (t, n, _) in held.items()] + [(key, 0, 0, p.encode(), m) for key, (_, _, cold) in held.items() for p, m in cold.items()]
            columns = [pa.array([r[0][i] for r in rows], types[i]) for i in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array([r[i] for r in rows], kind) for i, kind in ((1, pa.int64()), (2, pa.int64()), (3, pa.binary()), (4, pa.int64())))], names=[*keys, "n_texts", "n_tokens", "piece", "m"])
            held.clear()

        types: list[pa.DataType] = []
        for batch in batches:
            types = [batch.column(k).type for k in keys]
            for *key, text in zip(*(batch.column(c).to_pylist() for c in [*keys, "text"])):
                entry = held.get(tuple(key))
                if entry is None:
                    entry = held[tuple(key)] = [0, 0, Counter()]
                    n_held += 1
                found = split(text)
                entry[0] += 1
                try:
                    entry[1] += sum(map(size_of, found))
                except KeyError:
                    cold = entry[2]
                    before = len(cold)
                    for p in found:
                        if (n := known.get(p)) is None:
                            cold[p] += 1
                        else:
                            entry[1] += n
                    n_held += len(cold) - before
            if n_held > HELD:
                yield from out(types)
                n_held = 0
        if held:
            yield from out(types)

    told = stored(texts.mapInArrow(run, f"{kinds}, n_texts long, n_tokens long, piece binary, m long"))
    plain = told.where("piece IS NULL").select(*keys, "n_texts", "n_tokens")
    cold = pieces.where((F.length("piece") > HOT_BYTES) | (F.floor(F.log2("n")) < least)).select("piece", "size")
    joined = told.where("piece IS NOT NULL").join(cold, "piece").select(*keys, "n_texts", (F.col("m") * F.col("size")).alias("n_tokens"))
    return plain.unionByName(joined).groupBy(*keys).agg(F.sum("n_texts").alias("n_texts"), F.sum("n_tokens").alias("n_tokens"))


def token_budget(texts: DataFrame, keys: list[str], text_col: str = "text", folder: str = TOKENIZERS, tokenizer: str = NAME) -> DataFrame:
    """One row for each combination of keys: keys, n_texts long, n_tokens long, exact.

    Null texts don't count; empty ones count as texts of no tokens. A null key is written `unknown` if it is a string,
    else null. Repeated rows count as often as they stand there: drop repeats before, where they shouldn't. An empty
    table gives no rows. Other columns don't take part. The texts are read twice: for their distinct pieces and for
    their counts. The driver gets the sizes of the most frequent pieces (HOT at most).
    """
    named = spread(texts.where(F.col(text_col).isNotNull()).select(*[_named(texts, k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(text_col).alias("text")))
    ks = [f"k{i}" for i in range(len(keys))]
    out = token_counts(named, ks, piece_counts(named, folder, tokenizer), folder, tokenizer)
    return out.select(*[F.col(k).alias(name) for k, name in zip(ks, keys)], "n_texts", "n_tokens")


def _named(texts: DataFrame, key: str) -> Column:
    return F.coalesce(F.col(key), F.lit("unknown")) if texts.schema[key].dataType.simpleString() == "string" else F.col(key)


def document_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = TOKENIZERS, tokenizer: str = NAME) -> DataFrame:
    """token_budget() by document: id_col, n_texts (rows of that id with a text), n_tokens. Null texts give no rows."""
    return token_budget(docs, [id_col], text_col, folder, tokenizer)


def corpus_budget(docs: DataFrame, pairs: DataFrame, guides: DataFrame, folder: str = TOKENIZERS, tokenizer: str = NAME) -> DataFrame:
    """The budget of the corpus: kind (`document`, `question`, `paragraphs`), source, lang, topic, n_texts, n_tokens.

    A document's own source and topic count, else those of its guide; its own lang, else its guide's. A pair has source
    and topic of its guide and the language of its lang_code, else its guide's. Each pair (guide_id, group_id,
    grouping_method, model_name) counts once; of rows that share the key the least (question, paragraphs, lang_code)
    counts, nulls first. Nulls in key columns make a key of their own.
    """
    g = guides.select(F.col("guide_id").alias("g"), F.col("source").alias("g_source"), F.col("topic").alias("g_topic"), language(F.col("lang_code")).alias("g_lang"))
    # one row for each guide: the least of those that share an id
    g = g.groupBy("g").agg(F.min(F.struct("g_source", "g_topic", "g_lang")).alias("m")).select("g", "m.*")
    d = spread(docs.where(F.col("text").isNotNull()).select("guide_id", F.col("source").alias("own_source"), language(F.col("lang")).alias("own_lang"), F.col("topic").alias("own_topic"), "text"))
    d = d.join(g, F.col("guide_id") == F.col("g"), "left").select(
        F.lit("document").alias("kind"), F.coalesce("own_source", "g_source").alias("source"), F.coalesce("own_lang", "g_lang").alias("lang"), F.coalesce("own_topic", "g_topic").alias("topic"), "text",
    )
    key = ["guide_id", "group_id", "grouping_method", "model_name"]
    both = "stack(2, 'question', question, 'paragraphs', paragraphs) AS (kind, text)"
    p = pairs.groupBy(*key).agg(F.min(F.struct("question", "paragraphs", language(F.col("lang_code")).alias("own_lang"))).alias("m")).select("guide_id", "m.*")
    p = p.join(g, F.col("guide_id") == F.col("g"), "left").select(F.col("g_source").alias("source"), F.coalesce("own_lang", "g_lang").alias("lang"), F.col("g_topic").alias("topic"), F.expr(both))
    keys = ["kind", "source", "lang", "topic"]
    texts = d.unionByName(p).where("text IS NOT NULL").select(*[F.coalesce(k, F.lit("unknown")).alias(k) for k in keys], "text")
    # repeated pairs have no further pieces: the pieces are taken from all rows, before any shuffle
    every = spread(docs.select("text")).union(spread(pairs.select("question", "paragraphs")).select(F.expr(both)).select("text")).where("text IS NOT NULL")
    return token_counts(texts, keys, piece_counts(every, folder, tokenizer), folder, tokenizer)
