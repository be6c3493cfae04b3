"""Text functions as column expressions. `\\s` and `\\d` are Unicode-aware where the text may hold hard blanks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Numbers that a cited range may span.
WIDEST = 1_000_000
BRACKETS = r" ?\[\d+(?:-\d+)?(?:, ?\d+(?:-\d+)?)*\]"


def collapse_space(x: Column) -> Column:
    """Each run of white space as one blank, none at the ends; hard blanks count as white space."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def int_range(item: Column) -> Column:
    """`7` as [7], `3-5` as [3, 4, 5], a reversed range as [].

    Numbers beyond 64 bits and ranges wider than WIDEST are errors, never left out.
    """
    ends = F.split(item, "-")
    first, last = F.try_element_at(ends, F.lit(1)).cast("bigint"), F.try_element_at(ends, F.lit(-1)).cast("bigint")
    return F.when(first > last, F.array().cast("array<bigint>")).when(last - first < WIDEST, F.sequence(first, last)).otherwise(F.raise_error(F.concat(F.lit("range of citations too wide: "), item)))


def bracket_numbers(x: Column) -> Column:
    """Sorted distinct numbers in groups such as [1], [2, 5-7]."""
    groups = F.regexp_extract_all(x, F.lit(f"({BRACKETS})"), 1)
    items = F.flatten(F.transform(groups, lambda g: F.regexp_extract_all(g, F.lit(r"(\d+(?:-\d+)?)"), 1)))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(items, int_range))))


def without_brackets(x: Column) -> Column:
    return F.regexp_replace(x, BRACKETS, "")


#: A list of numbers, the first maybe a range, its parts joined by commas, `and` or both.
_LISTED = r"\d+(?:-\d+)?(?:(?:,|,? and)\s\d+)*"


def doc_numbers(x: Column) -> Column:
    """Sorted distinct numbers cited as `Doc 1, 2`, `Doc 2-5`, `[1]`, `[3-5]`; `and` counts as a comma, 【】 as []."""
    lists = F.concat(*(F.regexp_extract_all(x, F.lit(marked), 1) for marked in (rf"Doc\s({_LISTED})", rf"[\[【]({_LISTED})[\]】]")))
    items = F.flatten(F.transform(lists, lambda l: F.regexp_extract_all(l, F.lit(r"(\d+(?:-\d+)?)"), 1)))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(items, int_range))))


def without_citations(x: Column) -> Column:
    """Without ` [...]` (a blank before it)."""
    return F.regexp_replace(x, r" \[.*?\]", "")


def lines(x: Column) -> Column:
    """Lines without outer white space, blank ones left out."""
    return F.filter(F.transform(F.split(x, "\n"), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")), lambda s: s != "")


def without_trailing_list(sentences: Column) -> Column:
    """Sentences up to the last that ends in a full stop, doesn't begin with a bracket and doesn't hold `citations:`."""
    def kept(s: Column) -> Column:
        t = F.trim(s)
        return t.endswith(".") & ~t.startswith("[") & ~t.startswith("【") & ~F.contains(F.lower(s), F.lit("citations:"))

    last = F.array_max(F.transform(sentences, lambda s, i: F.when(kept(s), i + 1).otherwise(0)))
    return F.slice(sentences, F.lit(1), F.coalesce(last, F.lit(0)))


def page_content(case: Column, number: Column, text: Column) -> Column:
    """`case; § n: text` without every `n.` of the text."""
    n = number.cast("string")
    return F.concat(case, F.lit("; § "), n, F.lit(": "), F.regexp_replace(F.replace(text, F.concat(n, F.lit(".")), F.lit("")), r"(?U)^\s+|\s+$", ""))


def without_prefix(text: Column, case: Column, number: Column) -> Column:
    """Without the prefix that page_content puts before, wherever it stands."""
    return F.replace(text, F.concat(case, F.lit("; § "), number.cast("string"), F.lit(": ")), F.lit(""))


def numbered(strings: Column, label: str = "") -> Column:
    """`[i]: s` lines; with a label `[label i]: s`."""
    head = f"[{label} " if label else "["
    return F.array_join(F.transform(strings, lambda s, i: F.concat(F.lit(head), (i + 1).cast("string"), F.lit("]: "), s)), "\n")


def question_of(response: Column) -> Column:
    """What follows the marker `Question:` (or the Romanian one), else all, up to the first question mark, with one put after."""
    after = F.regexp_extract(response, r"(?s)(?:\*\*Question:\*\*|Question:|\*\*Întrebare:\*\*|Întrebare:)\s*(.*)", 1)
    body = F.trim(F.coalesce(F.nullif(after, F.lit("")), response))
    return F.concat(F.substring_index(body, "?", 1), F.lit("?"))


def facts_of(answer: Column) -> Column:
    """Facts that end in `].`, each (text without citation numbers, sorted numbers)."""
    parts = F.filter(F.transform(F.split(answer, r"(?<=\]\.)"), lambda s: F.trim(s)), lambda s: s != "")
    return F.transform(parts, lambda s: F.struct(without_brackets(s).alias("text"), bracket_numbers(s).alias("numbers")))


def score(response: Column, label: str) -> Column:
    """The first number after `<label> Score`, null if there is none."""
    return F.nullif(F.regexp_extract(response, rf"(?s){label} Score\**:.*?\s*.*?(\d+)", 1), F.lit("")).try_cast("int")


def thoughts(response: Column) -> tuple[Column, Column]:
    """Text between the first think tags, and the answer without them."""
    inner = F.regexp_extract(response, r"(?s)<think>(.*?)</think>", 1)
    return inner, F.trim(F.concat(F.substring_index(response, "<think>", 1), F.when(F.contains(response, F.lit("</think>")), F.regexp_replace(response, r"(?s)^.*?</think>", "")).otherwise("")))


def without_fence(response: Column) -> Column:
    """What a ```json fence holds; other text unchanged."""
    return F.when(response.startswith("```json"), F.substr(response, F.lit(8), F.greatest(F.length(response) - 10, F.lit(0)))).otherwise(response)


def https(url: Column) -> Column:
    return F.regexp_replace(url, "http(?!s)", "https")


def link_targets(markdown: Column) -> Column:
    """Targets of Markdown links, in order."""
    return F.regexp_extract_all(markdown, F.lit(r"\((http.*?)\)"), 1)


def collapse_repeats(values: Column) -> Column:
    """Without elements equal to the one before."""
    return F.transform(F.filter(F.transform(values, lambda x, i: F.struct(x.alias("x"), (i == 0).alias("first"), F.get(values, i - 1).alias("before"))), lambda s: s["first"] | (s["x"] != s["before"])), lambda s: s["x"])


# Markers of error messages and their labels, in order.
MARKERS = (
    ("year mismatch", "Year mismatch"), ("link mismatch", "Link mismatch"), ("unconsumed links", "Unconsumed links"), ("still links in the stripped sentences", "Links in stripped sentences"),
    ("no ```json block found", "JSON block not found"), ("invalid json format", "Invalid JSON"), ("no paragraphs provided", "No paragraphs in citation"), ("missing field", "Missing field in citation"),
)
# Messages told by pattern, before all markers; what is masked in a message; where its leading phrase ends; how long that may be.
FAILURES = ((r"(?i)Failed to fetch .*judgment", "Failed to fetch judgment"), (r"(?i)Failed to fetch .* for citation", "Failed to fetch resource for citation"))
MASKS = ((r"\b\d{3,}-\d+\b", "<ID>"), (r"https?://\S+|\bwww\.\S+", "<URL>"))
LEADING, LONGEST_PHRASE = r"^(.+?)(?:[:.\-]| for citation| for |$)", 120


def error_category(message: Column) -> Column:
    """The label of an error message: by pattern, by marker, else its leading phrase, at most 120 characters."""
    clean = message
    for pattern, mask in MASKS:
        clean = F.regexp_replace(clean, pattern, mask)
    rules = [(message.rlike(pattern), label) for pattern, label in FAILURES] + [(F.contains(F.lower(clean), F.lit(marker)), label) for marker, label in MARKERS]
    out = F.when(F.coalesce(message, F.lit("")) == "", "No error")
    for holds, label in rules:
        out = out.when(holds, label)
    lead = F.trim(F.regexp_extract(clean, LEADING, 1))
    return out.otherwise(F.when(F.length(lead) > LONGEST_PHRASE, F.concat(F.left(lead, F.lit(LONGEST_PHRASE - 3)), F.lit("..."))).otherwise(lead))


def strategy(name: Column) -> dict[str, Column]:
    """Parts of `doc_<d>_query_<q>_<model>_<translation>`; empty strings where the shape is another."""
    rest = F.regexp_extract(name, r"^doc_(.*?)_query_(.*)$", 2)
    doc = F.coalesce(F.nullif(F.regexp_extract(name, r"^doc_(.*?)_query_", 1), F.lit("")), F.when(name.startswith("doc_") & ~F.contains(name, F.lit("_query_")), F.substr(name, F.lit(5))).otherwise(""))
    words = F.split(rest, "_")
    long = F.size(words) >= 2
    query = F.when(long, F.array_join(F.slice(words, F.lit(1), F.size(words) - 2), "_")).otherwise(rest)
    return {
        "doc_embed": doc, "query_embed": query, "model": F.when(long, F.element_at(words, -2)).otherwise(""), "translation": F.when(long, F.element_at(words, -1)).otherwise(""),
        "retrieval_language": F.when(query == "translation_echr_retrieve", "query_translation_echr_retrieve").otherwise("query_echr_retrieve"),
    }


def without_ron_suffix(name: Column) -> Column:
    """Without a `_ron` that the prefix already says."""
    return F.when(name.endswith("_ron") & (name.startswith("ron_") | name.startswith("translation_ron_")), F.left(name, F.length(name) - 4)).otherwise(name)


def first_words(text: Column, n: int) -> Column:
    return F.array_join(F.slice(F.split(text, r"\s+"), 1, n), " ")


def filled(template: str, **values: Column) -> Column:
    """The template with each {name} replaced by its column."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def prompt_hash(system: Column, prompt: Column) -> Column:
    return F.sha2(F.concat(F.coalesce(system, F.lit("")), prompt), 256)


def points(size: Column) -> Column:
    """A font size in pt (px x 0.75); null for other units."""
    number = F.regexp_extract(F.lower(size), r"^\s*(\d+(?:\.\d+)?)\s*(pt|px)\s*$", 1).try_cast("double")
    return F.when(F.regexp_extract(F.lower(size), r"(pt|px)\s*$", 1) == "px", number * 0.75).otherwise(number)


def chunks(items: Column, length: int, stride: int) -> Column:
    """Windows of `length` elements every `stride`, up to the first that reaches the end."""
    n = F.size(items)
    last = F.when(n <= length, F.lit(0)).otherwise(F.ceil((n - length) / F.lit(stride)).cast("int"))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(items, i * stride + 1, F.lit(length)))).otherwise(F.array())


def year_of(date: Column) -> Column:
    """The first four characters as a number, else 0."""
    return F.coalesce(F.left(date, F.lit(4)).try_cast("int"), F.lit(0))


def case_id_of(url: Column) -> Column:
    return F.substring_index(F.substring_index(url, "?i=", -1), "&", 1)


def shrunk(text: Column, n: int, retry: int, step: int = 500) -> Column:
    """The first n words, `step` fewer for each retry, at least one step."""
    return first_words(text, max(step, n - step * retry))


def vector(text: Column) -> Column:
    """A vector written as a JSON list; null if it isn't readable as one."""
    return F.from_json(text, "array<double>")


def cited_facts(answer: Column, citations: Column) -> Column:
    """facts_of() with the citations that the numbers (from 1) stand for: (text, citations); numbers without one are left out."""
    named = lambda ns: F.filter(F.transform(ns, lambda n: F.get(citations, F.least(n, F.lit(2**31 - 1)).cast("int") - 1)), lambda c: c.isNotNull())
    return F.transform(facts_of(answer), lambda f: F.struct(f["text"].alias("text"), named(f["numbers"]).alias("citations")))


def logged_pairs(lines: DataFrame, column: str) -> DataFrame:
    """(case_id, paragraph_number int) of each `('ddd-ddd', n)` in the lines of a log, repeats included."""
    found = lines.select(F.explode(F.regexp_extract_all(column, F.lit(r"\('(\d{3}-\d+', \d+)\)"), 1)).alias("x"))
    return found.select(F.substring_index("x", "'", 1).alias("case_id"), F.substring_index("x", " ", -1).cast("int").alias("paragraph_number"))
