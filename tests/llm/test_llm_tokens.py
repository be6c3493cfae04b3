"""Encoding, budgets and packing against public libraries and brute force."""

import random

import pytest
import tiktoken
from pyspark.sql import functions as F

from quillon.llm import tokens
from quillon.llm.bpe import PIECES, vocabulary
from quillon.llm.encode import count_tokens, encode_corpus
from quillon.llm.packing import best_two_fit, pack, pack_documents
from quillon.llm.tokens import PrefixTrie, corpus_budget, language, token_budget

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def public():
    return tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks=vocabulary().ranks, special_tokens={})


ODD = ["", " ", "a" * 3000, " " * 5000, "abc" * 2000, "กขค" * 300, "\x1c\x85​﻿ x　", "<|endoftext|> it's we'LL", "é 👩‍👧 \n \n\t x", "0123456789" * 50]


def test_encoding_is_that_of_the_public_library(public):
    v, rnd = vocabulary(), random.Random(1)
    letters = [chr(i) for i in [*range(0x250), 0x200B, 0x2028, 0x3000, 0xFEFF, 0x1F600, 0x4E2D, 0xE01, 0x301]]
    for text in ODD + ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 80))) for _ in range(800)]:
        assert v.encode(text) == public.encode_ordinary(text)
        assert v.count(text) == len(v.encode(text))
        assert b"".join(v.bytes_of[i] for i in v.encode(text)) == text.encode()


def test_whole_table(spark, public):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {r["doc_id"]: public.encode_ordinary(r["text"]) if r["text"] else [] for r in docs.collect()}
    got = {r["doc_id"]: r["ids"] for r in encode_corpus(docs).collect()}
    assert got == want


def test_encode_nulls_repeats_and_clashing_names(spark):
    df = spark.createDataFrame([(1, None, 7), (1, "a b", 7), (1, "a b", 7), (None, "", 7)], "doc_id long, text string, id int")
    assert sorted((r["doc_id"] or 0, len(r["ids"])) for r in encode_corpus(df).collect()) == [(0, 0), (1, 0), (1, 2), (1, 2)]
    assert encode_corpus(df.limit(0)).count() == 0
    assert count_tokens(df).agg(F.sum("n_tokens")).first()[0] == 4


def test_trie_states_are_exact():
    v = vocabulary()
    pieces = sorted({" the", " there", " therefore", "x" * 300, "Überprüfung".encode().decode(), " процессуальный", "什么也没说", *[" " + w for w in "appeal appealed appealing application applicant".split()]}, key=str.encode)
    trie = PrefixTrie(v)
    assert [trie(p.encode()) for p in pieces] == [len(v.encode_bytes(p.encode())) for p in pieces]


def test_budget(spark):
    v = vocabulary()
    rows = [("a", "x", "the cat sat"), ("a", None, "the cat"), ("b", "x", None), ("b", "x", ""), ("a", "x", "the cat sat")]
    got = {(r["s"], r["t"]): (r["n_texts"], r["n_tokens"]) for r in token_budget(spark.createDataFrame(rows, "s string, t string, text string"), ["s", "t"]).collect()}
    assert got == {("a", "x"): (2, 2 * v.count("the cat sat")), ("a", "unknown"): (1, v.count("the cat")), ("b", "x"): (1, 0)}
    assert token_budget(spark.createDataFrame([], "s string, text string"), ["s"]).count() == 0


def test_corpus_budget(spark):
    docs, pairs, guides = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "question_generations", "guides"))
    got = {r["kind"]: (r["n"], r["t"]) for r in corpus_budget(docs, pairs, guides).groupBy("kind").agg(F.sum("n_texts").alias("n"), F.sum("n_tokens").alias("t")).collect()}
    v = vocabulary()
    texts = [r["text"] for r in docs.collect() if r["text"] is not None]
    once = {(r["guide_id"], r["group_id"], r["grouping_method"], r["model_name"]): r for r in pairs.collect()}.values()
    questions = [r["question"] for r in once if r["question"] is not None]
    assert got["document"] == (len(texts), sum(map(v.count, texts)))
    assert got["question"] == (len(questions), sum(map(v.count, questions)))
    assert corpus_budget(docs.limit(0), pairs.limit(0), guides.limit(0)).count() == 0


@pytest.mark.parametrize("hot", [100_000, 50, 0])
def test_counts_by_document_are_those_of_the_encoder(spark, monkeypatch, hot):
    """However few pieces are sent to the tasks, and with odd texts among the documents."""
    monkeypatch.setattr(tokens, "HOT", hot)
    v = vocabulary()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(ODD)] + [(-100, None), (None, "a b")], "doc_id long, text string")
    every = docs.union(odd).withColumn("piece", F.lit(1))
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.document_tokens(every).collect()}
    assert got == {r["doc_id"]: v.count(r["text"]) for r in every.collect() if r["text"] is not None}


def test_language_spellings(spark):
    df = spark.createDataFrame([("EN",), (" fra ",), ("ron",), ("xx",), ("",), (None,)], "c string")
    assert [r[0] for r in df.select(language(F.col("c"))).collect()] == ["eng", "fre", "ron", "xx", None, None]


def check(rows, sizes, capacity):
    by: dict = {}
    pieces: dict = {}
    for r in rows:
        by.setdefault(r["container"], []).append((r["at"], r["n_tokens"]))
        pieces.setdefault(r["doc_id"], []).append((r["piece"], r["tok_start"], r["n_tokens"]))
    for spans in by.values():
        end = 0
        for at, n in sorted(s for s in spans if s[1]):
            assert at == end
            end += n
        assert end <= capacity
    assert set(pieces) == set(sizes)
    for i, n in sizes.items():
        parts = sorted(pieces[i])
        assert sum(p[2] for p in parts) == n and [p[0] for p in parts] == list(range(len(parts)))
        assert n > capacity or len(parts) == 1
    return len(by)


@pytest.mark.parametrize("seed", range(4))
def test_packing_holds_every_item_whole(spark, seed):
    rnd = random.Random(seed)
    sizes = {i: rnd.choice([0, 1, 5, 31, 32, 33, 50, 64, 100, 101, 250, rnd.randint(0, 99)]) for i in range(400)}
    df = spark.createDataFrame([*((i, n, 1) for i, n in sizes.items()), (999, None, 1)], "doc_id long, n_tokens long, size int").repartition(5)
    used = check(pack(df, capacity=100).collect(), sizes, 100)
    assert used <= 1.03 * sum(sizes.values()) / 100 + 2


def test_packing_sizes_over_many_partitions(spark):
    """One size holds a third of the items; partitions hold runs of sizes, whatever the capacity."""
    rnd = random.Random(9)
    sizes = {i: 700 if i % 3 == 0 else rnd.randint(0, 140_000) for i in range(3000)}
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        used = check(pack(spark.createDataFrame(list(sizes.items()), "doc_id long, n_tokens long").repartition(9), capacity=131_072).collect(), sizes, 131_072)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert used <= 1.03 * sum(sizes.values()) / 131_072 + 2


def test_packing_small_cases(spark):
    schema = "doc_id long, n_tokens long"
    assert pack(spark.createDataFrame([], schema)).count() == 0
    assert check(pack(spark.createDataFrame([(1, 0), (2, 0)], schema)).collect(), {1: 0, 2: 0}, 10) == 1
    assert check(pack(spark.createDataFrame([(1, 30)], schema), capacity=10).collect(), {1: 30}, 10) == 3
    assert sum(n for _, n in best_two_fit({6: 2, 5: 2, 4: 3, 1: 1}, 10)) == 4


def test_pack_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    v = vocabulary()
    sizes = {r["doc_id"]: v.count(r["text"]) for r in docs.collect() if r["text"] is not None}
    assert check(pack_documents(docs).collect(), sizes, 2048) <= sum(sizes.values()) / 2048 + 2
