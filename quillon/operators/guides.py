"""Markdown guides to numbered paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse_space

# The line before the numbered part of a guide and the heading after it, by language.
KEYWORDS = {"eng": ("HUDOC keywords", "List of cited cases"), "fre": ("Mots-clés HUDOC", "Liste des affaires citées"), "ron": ("Cuvinte-cheie HUDOC", "Lista cauzelor citate")}
# Running footer and header of a guide's pages, by language.
RUNNING = {
    "eng": ("European Court of Human Rights", r"(?<!\[)Guide on"), "fre": ("Cour européenne des droits de l’homme", r"(?<!\[)Guide sur"), "ron": ("Curtea Europeană a Drepturilor Omului", r"(?<!\[)Ghid privind"),
}
# Clutter of converted pages (lines with ^ and $): headings, page marks, footnotes.
FLAGS = "(?mdU)"
FOOTNOTE = r"^\s*<sup>(.*?)</sup>(.*)"
CLUTTER = (r"^\s*#{1,6}\s+.*$\n?", r'<span id=".*?"></span>', FOOTNOTE)
#: The rules of guides: a start string (kind `start`), and patterns that are replaced (`replace`) or removed (`remove`), in order.
RULES = "guide_id string, kind string, ord int, pattern string, replacement string"


def guide_language(guide_id: Column) -> Column:
    return F.right(guide_id, F.lit(3))


def _after(text: Column, mark: Column) -> Column:
    """What follows the first mark; null if there is none."""
    at = F.instr(text, mark)
    return F.when(at > 0, F.substr(text, at + F.length(mark)))


def trimmed(text: Column, start: Column, keyword: Column, end: Column) -> Column:
    """The numbered part: from the start string (without its `1. `), if there is one, else from after the first `\\n1. ` after the keyword; up to the end keyword, if that is there.

    Null where the start string, the keyword or the first number is missing.
    """
    body = F.when(start.isNotNull(), F.concat(F.replace(start, F.lit("1. "), F.lit("")), _after(text, start))).otherwise(_after(_after(text, keyword), F.lit("\n1. ")))
    stop = F.instr(body, end)
    return F.when(stop > 0, F.left(body, stop - 1)).otherwise(body)


def footnotes(text: Column) -> Column:
    """Map from footnote key to text, the last of equal keys."""
    found = F.regexp_extract_all(text, F.lit(FLAGS + FOOTNOTE), 1)
    texts = F.regexp_extract_all(text, F.lit(FLAGS + FOOTNOTE), 2)
    pairs = F.arrays_zip(found.alias("k"), texts.alias("t"))
    last = F.filter(F.transform(pairs, lambda p, i: F.struct(p["k"].alias("k"), p["t"].alias("t"), i.alias("i"))), lambda p: ~F.exists(F.slice(found, p["i"] + 2, F.size(found)), lambda x: x == p["k"]))
    return F.map_from_entries(F.transform(last, lambda p: F.struct(p["k"], p["t"])))


def decluttered(text: Column, rules: Column | None = None) -> Column:
    """The text after the guide's own rules (array of pattern, replacement), without headings, page marks and footnotes."""
    out = text
    if rules is not None:
        out = F.aggregate(F.coalesce(rules, F.array().cast("array<struct<pattern:string,replacement:string>>")), out, lambda t, r: F.regexp_replace(t, F.concat(F.lit(FLAGS), r["pattern"]), r["replacement"]))
    for pattern in CLUTTER:
        out = F.regexp_replace(out, FLAGS + pattern, "")
    return out


def number_of_paragraphs(text: Column) -> Column:
    """The largest n with `1.` to `n.` each somewhere in the text, also as the end of a longer number."""
    runs = F.regexp_extract_all(text, F.lit(r"(\d+)\."), 1)
    ends = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.least(F.length(r), F.lit(9))), lambda k: F.right(r, k))))
    found = F.array_distinct(F.transform(F.filter(ends, lambda e: ~e.startswith("0")), lambda e: e.cast("int")))
    return F.array_min(F.array_except(F.sequence(F.lit(1), F.size(found) + 1), found)) - 1


def split_paragraphs(text: Column, count: Column) -> Column:
    """The parts between the marks `\\n2. `, `\\n3. ` and so on (or `\\n- 2.`), in turn, without the marks; null if one of the `count` - 1 marks is missing.

    Each step searches in what the step before left, so marks count only in order.
    """
    start = F.struct(text.alias("rest"), F.array().cast("array<string>").alias("out"), F.lit(True).alias("ok"))

    def step(state: Column, i: Column) -> Column:
        number = (i + 1).cast("string")
        rest = state["rest"]
        plain, listed = (F.concat(F.lit(begin), number, F.lit(end)) for begin, end in (("\n", ". "), ("\n- ", ".")))
        mark = F.when(F.instr(rest, plain) > 0, plain).otherwise(listed)
        at = F.instr(rest, mark)
        ok = state["ok"] & (at > 0)
        return F.struct(F.when(ok, F.substr(rest, at + F.length(mark))).otherwise(rest).alias("rest"), F.when(ok, F.array_append(state["out"], F.left(rest, at - 1))).otherwise(state["out"]).alias("out"), ok.alias("ok"))

    steps = F.when(count > 1, F.sequence(F.lit(1), count - 1)).otherwise(F.array().cast("array<int>"))
    done = F.aggregate(steps, start, step)
    return F.when(done["ok"], F.array_append(done["out"], done["rest"]))


def with_footnotes(paragraph: Column, notes: Column) -> Column:
    """The paragraph on one line, followed by the footnotes it names, each on a line of its own; unknown and empty ones are left out."""
    line = collapse_space(paragraph)
    keys = F.regexp_extract_all(line, F.lit(r"<sup>(.*?)</sup>"), 1)
    text = lambda k: F.coalesce(*(F.nullif(F.try_element_at(notes, key), F.lit("")) for key in (k, F.concat(k, F.lit(".")))))
    named = F.filter(F.transform(keys, lambda k: F.concat(F.lit("<sup>"), k, F.lit("</sup>"), text(k))), lambda t: t.isNotNull())
    return F.array_join(F.array_insert(named, 1, line), "\n")


def parse_guides(guides: DataFrame, rules: DataFrame | None = None, count: Column | None = None) -> DataFrame:
    """(guide_id, text) to (guide_id, paragraph_id from 1, paragraph without its number).

    The language is the end of the id. rules (see RULES; patterns and replacements as in Java): replacements go before
    removals, each kind by ord. Guides that lack their start or a mark give no rows; one with no numbers but the first is
    one paragraph. A guide's rules are few: they are gathered in its row.
    """
    lang = guide_language(F.col("guide_id"))
    keyword, end = (F.try_element_at(F.create_map(*[F.lit(x) for k, v in KEYWORDS.items() for x in (k, v[i])]), lang) for i in (0, 1))
    g = guides.select("guide_id", "text")
    if rules is None:
        g = g.withColumn("start", F.lit(None).cast("string")).withColumn("rules", F.lit(None).cast("array<struct<pattern:string,replacement:string>>"))
    else:
        order = F.struct(F.when(F.col("kind") == "replace", 0).otherwise(1).alias("n"), "ord", "pattern", F.coalesce("replacement", F.lit("")).alias("replacement"))
        own = rules.groupBy("guide_id").agg(
            F.min(F.when(F.col("kind") == "start", F.col("pattern"))).alias("start"),
            F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") != "start", order))), lambda r: F.struct(r["pattern"].alias("pattern"), r["replacement"].alias("replacement"))).alias("rules"),
        )
        g = g.join(own, "guide_id", "left")
    body = g.select("guide_id", "rules", trimmed(F.col("text"), F.col("start"), keyword, end).alias("body")).where("body IS NOT NULL")
    clean = body.withColumn("notes", footnotes(F.col("body"))).withColumn("body", decluttered(F.col("body"), F.col("rules")))
    n = number_of_paragraphs(F.col("body")) if count is None else count
    parts = clean.withColumn("n", n).select("guide_id", "notes", F.posexplode(split_paragraphs(F.col("body"), F.col("n"))).alias("pos", "part"))
    return parts.select("guide_id", (F.col("pos") + 1).alias("paragraph_id"), with_footnotes(F.col("part"), F.col("notes")).alias("paragraph"))


def residual_clutter(paragraphs: DataFrame) -> DataFrame:
    """Paragraphs (guide_id, paragraph) that still hold clutter, with `problem`: `footer` or `header` (of the guide's language), `heading`, `page` or `anchor`."""
    lang = guide_language(F.col("guide_id"))
    running = lambda i: F.coalesce(*(F.when(lang == k, F.col("paragraph").rlike(v[i])) for k, v in RUNNING.items()), F.lit(False))
    text = F.col("paragraph")
    problem = F.when(running(0), "footer").when(running(1), "header").when(text.rlike(r"(?:^|\s)#{1,6} "), "heading").when(text.rlike("<span id="), "page").when(text.rlike(r"\]\(#page"), "anchor")
    return paragraphs.withColumn("problem", problem).where("problem IS NOT NULL")
