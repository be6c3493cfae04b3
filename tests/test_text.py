"""Text functions on literal rows."""

import random

import pytest
from pyspark.sql import functions as F

from quillon.functions import text as X
from quillon.functions.urls import normal_url, normal_urls, normalise_url

def marked(rnd):
    """A sentence with a marker of a random form, and the numbers it stands for."""
    n = sorted(rnd.sample(range(1, 40), rnd.randint(1, 4)))
    listed = ", ".join(map(str, n))
    if len(n) > 1 and rnd.random() < 0.5:
        listed = ", ".join(map(str, n[:-1])) + rnd.choice([" and ", ", and "]) + str(n[-1])
    if rnd.random() < 0.3:
        last = n[0] + rnd.randint(-3, 6)
        listed, n = f"{n[0]}-{last}", list(range(n[0], last + 1))
    form = rnd.choice(["Doc {}", "[{}]", "[Doc {}]", "【{}】", "【Doc {}】"])
    return f"{rnd.choice(['It was so', 'Era așa', 'So held the court,'])} {form.format(listed)}{rnd.choice(['.', ' then.', ''])}", n


RND = random.Random(11)
CITED = [(None, None), ("", []), ("No marker, 12 and 13.", []), ("[3000000000]", [3000000000])]
for _ in range(120):
    _parts = [marked(RND) for _ in range(RND.randint(1, 3))]
    CITED.append((" ".join(t for t, _ in _parts), sorted({k for _, n in _parts for k in n})))


@pytest.fixture(scope="module")
def one(spark):
    def run(column, **values):
        names = list(values)
        schema = ", ".join(f"{n} {'array<string>' if isinstance(values[n], list) else 'int' if isinstance(values[n], int) else 'string'}" for n in names)
        return spark.createDataFrame([tuple(values[n] for n in names)], schema).select(column).first()[0]

    return run


def test_doc_numbers(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CITED)], "i int, t string")
    got = {r[0]: r[1] for r in df.select("i", X.doc_numbers(F.col("t"))).collect()}
    assert got == {i: want for i, (_, want) in enumerate(CITED)}


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("https://h.example/eng?i=001-1", "https://h.example/eng?i=001-1"), ('https://h.example/eng#{"itemid":["001-1"]}', "https://h.example/eng?i=001-1"), ("https://h.example/fre#%7B%22ItemId%22%3A%5B%22001-2%22%5D%7D", "https://h.example/fre?i=001-2"),
        ("https://h.example/eng#{%22itemid%22:[%22001-3%22]}", "https://h.example/eng?i=001-3"), ("https://h.example/eng", "https://h.example/eng"), ('https://h.example/eng#{"itemid":["001-1"', 'https://h.example/eng#{"itemid":["001-1"'),
        ('https://h.example/eng#"itemid":["001-4"]', "https://h.example/eng?i=001-4"), ("", ""),
    ],
)
def test_urls(one, url, want):
    assert normalise_url(url) == want
    assert one(normal_url(F.col("u")), u=url) == want
    assert one(normal_urls(F.array("u", F.lit(None))), u=url) == [want, None]


def test_small_functions(one):
    assert one(X.collapse_space(F.col("t")), t=" a\xa0 b\n c ") == "a b c"
    assert one(X.question_of(F.col("t")), t="Ok.\n**Question:** Why so? Or not?") == "Why so?"
    assert one(X.question_of(F.col("t")), t="Why? More") == "Why?"
    assert one(X.score(F.col("t"), "Relevance"), t="**Relevance Score**: about\n 4/5") == 4
    assert one(X.score(F.col("t"), "Relevance"), t="none") is None
    assert one(X.without_fence(F.col("t")), t='```json{"a": 1}```') == '{"a": 1}'
    assert one(X.https(F.col("t")), t="http://a https://b") == "https://a https://b"
    assert one(X.numbered(F.col("a")), a=["x", "y"]) == "[1]: x\n[2]: y"
    assert one(X.without_trailing_list(F.col("a")), a=["A b.", "C", "[1]"]) == ["A b."]
    assert one(X.without_trailing_list(F.col("a")), a=["x"]) == []
    assert one(X.collapse_repeats(F.col("a")), a=["x", "x", "y", "x"]) == ["x", "y", "x"]
    assert one(X.points(F.col("t")), t="16px") == 12.0
    assert one(X.points(F.col("t")), t="2em") is None
    assert one(X.year_of(F.col("t")), t="0001-01-01") == 1
    assert one(X.year_of(F.col("t")), t="x") == 0
    assert one(X.error_category(F.col("t")), t="Year mismatch (2001) for 001-12") == "Year mismatch"
    assert one(X.error_category(F.col("t")), t="Timeout while fetching: x") == "Timeout while fetching"
    assert [f["text"] for f in one(X.facts_of(F.col("t")), t="A [1]. B [2-3]. C")] == ["A.", "B.", "C"]


@pytest.mark.parametrize("n", [0, 1, 4, 5, 9])
def test_chunks(one, n):
    items = [str(i) for i in range(n)]
    want, at = [], 0
    while at < n:
        want.append(items[at : at + 4])
        if at + 4 >= n:
            break
        at += 3
    assert one(X.chunks(F.col("a"), 4, 3), a=items) == want


def test_wide_and_reversed_ranges(one, spark):
    assert one(X.bracket_numbers(F.col("t")), t="x [3000000000, 5-3, 7-9]") == [7, 8, 9, 3000000000]
    for text in ("x [1-2000000000]", "x [99999999999999999999]"):
        with pytest.raises(Exception, match="too wide|CAST_INVALID_INPUT|CAST_OVERFLOW"):
            one(X.bracket_numbers(F.col("t")), t=text)
