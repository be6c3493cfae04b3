"""Citations: reading, equivalence, validity, availability, names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse_repeats, https, link_targets

CITATION = "struct<original_url:string,citation_url:string,citation_year:string,citation_tags:array<string>,citation_paragraphs:array<string>,citation_date:string,multilingual:map<string,struct<id:string,docname:string>>>"


def citation_lists(text: Column) -> Column:
    """An array of arrays of citations; null if it isn't readable as such."""
    return F.from_json(text, f"array<array<{CITATION}>>")


def url_of(c: Column) -> Column:
    return F.coalesce(c["original_url"], c["citation_url"], F.lit(""))


def ids_of(c: Column) -> Column:
    """Sorted distinct ids of the language versions."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.map_values(c["multilingual"]), lambda v: F.trim(v["id"])), lambda i: i.isNotNull() & (i != ""))))


def same_case(a: Column, b: Column) -> Column:
    """Equal lists of paragraphs and a common id (both must have some)."""
    return F.coalesce(a["pars"] == b["pars"], F.lit(False)) & F.arrays_overlap(a["ids"], b["ids"])


def merged(citations: Column) -> Column:
    """Citations without those that are the same as an earlier kept one; structs with pars and ids. Greedy in order, as sameness isn't transitive."""
    empty = F.slice(citations, 1, 0)
    return F.aggregate(citations, empty, lambda kept, c: F.when(F.exists(kept, lambda k: same_case(k, c)), kept).otherwise(F.array_append(kept, c)))


def citation_string(c: Column, main_lang: str | None = None) -> Column:
    """Year, tags, main name, paragraphs and other names; the main name is that of the language given, else French, else English."""
    order = ([main_lang] if main_lang else []) + ["fre", "eng"]
    names = F.filter(F.array(*(F.try_element_at(c["multilingual"], F.lit(lang))["docname"] for lang in order)), lambda n: n.isNotNull())
    head = F.coalesce(F.nullif(F.get(names, F.lit(0)), F.lit("")), F.lit("Unknown Case"))
    others = F.filter(F.slice(names, F.lit(2), F.lit(9)), lambda n: n != "")
    pars = F.when(F.size(c["citation_paragraphs"]) > 0, F.concat(F.lit("Paragraphs: "), F.array_join(c["citation_paragraphs"], ", "))).otherwise("No paragraphs")
    tags = F.when(F.size(c["citation_tags"]) > 0, F.concat(F.lit(" "), F.array_join(c["citation_tags"], " "))).otherwise("")
    return F.concat(F.coalesce(c["citation_year"], F.lit("0")), tags, F.lit(", "), head, F.lit(", "), pars, F.when(F.size(others) > 0, F.concat(F.lit(", Alternative names: "), F.array_join(others, ", "))).otherwise(""))


def paragraph_links(markdown: Column) -> Column:
    """Targets of a paragraph's links as https, neighbours that repeat once."""
    return collapse_repeats(F.transform(link_targets(markdown), https))


def link_mismatches(urls: Column, links: Column) -> Column:
    """(mismatches, links not consumed): urls matched against links in order; a url may repeat the link before."""
    start = F.struct(F.lit(0).alias("j"), F.lit(0).alias("bad"))

    def step(s: Column, u: Column) -> Column:
        hit = F.coalesce(F.get(links, s["j"]) == u, F.lit(False))
        again = F.coalesce((s["j"] > 0) & (F.get(links, s["j"] - 1) == u), F.lit(False))
        return F.struct((s["j"] + hit.cast("int")).alias("j"), (s["bad"] + (~hit & ~again).cast("int")).alias("bad"))

    done = F.aggregate(urls, start, step)
    return F.struct(done["bad"].alias("mismatched"), (F.size(links) - done["j"]).alias("unconsumed"))


def valid_groups(wanted: DataFrame, extracted: DataFrame, ignored: tuple[str, ...] = ()) -> DataFrame:
    """Groups (guide_id, group_id, paragraph_id) all of whose paragraphs were extracted without an error and with some citation.

    extracted: guide_id, paragraph_id, errors array<string>, n_citations. Gives guide_id, group_id, valid.
    """
    x = extracted.withColumn("bad", F.size(F.filter("errors", lambda e: ~e.isin(*ignored) if ignored else F.lit(True)))).withColumn("found", F.lit(True))
    joined = wanted.join(x, ["guide_id", "paragraph_id"], "left")
    return joined.groupBy("guide_id", "group_id").agg((F.every(F.coalesce("found", F.lit(False))) & (F.coalesce(F.sum("bad"), F.lit(0)) == 0) & (F.coalesce(F.sum("n_citations"), F.lit(0)) > 0)).alias("valid"))


def all_or_nothing(wanted: DataFrame, there: DataFrame, owner: str, keys: list[str], value: str) -> DataFrame:
    """For each owner its values in order of `ord`, or null if one of its keys isn't there; of several values of a key the least counts."""
    once = there.groupBy(*keys).agg(F.min(value).alias("v"), F.lit(True).alias("hit"))
    joined = wanted.join(once, keys, "left")
    return joined.groupBy(owner).agg(F.when(F.every(F.coalesce("hit", F.lit(False))), F.transform(F.sort_array(F.collect_list(F.struct("ord", "v"))), lambda s: s["v"])).alias("values"))


def missing_names(judgements: DataFrame, meta: DataFrame) -> DataFrame:
    """case_id and name of cases with rows that lack it, from metadata (url, data JSON): the name of the version of that id, else English, French, any."""
    cases = judgements.where("case_name IS NULL AND case_id IS NOT NULL").select("case_id").distinct()
    versions = F.from_json(F.get_json_object("data", "$.lang_versions"), "map<string,struct<id:string,docname:string>>")
    flat = meta.select(versions.alias("v")).where("v IS NOT NULL").select("v", F.explode("v").alias("lang", "one")).select(F.trim("one.id").alias("case_id"), F.col("lang"), F.col("one.docname").alias("docname")).where("docname IS NOT NULL")
    order = F.when(F.col("lang") == "eng", 0).when(F.col("lang") == "fre", 1).otherwise(2)
    best = flat.join(cases, "case_id", "left_semi").withColumn("n", F.row_number().over(Window.partitionBy("case_id").orderBy(order, "lang", "docname"))).where("n = 1")
    return best.select("case_id", "docname")


def in_languages(multilingual: Column, lang: str) -> Column:
    """The versions of a citation in English, French and the language given."""
    return F.map_filter(multilingual, lambda k, v: k.isin("eng", "fre", lang))


def citation_json(c: Column) -> Column:
    """A citation as JSON under `original_url`, whichever of its two names the URL had; citation_lists() reads it back."""
    return F.to_json(c.withField("original_url", F.coalesce(c["original_url"], c["citation_url"])).dropFields("citation_url"))


def language_groups(citations: Column) -> Column:
    """Distinct language maps of an array of citations, each as its sorted entries."""
    return F.array_distinct(F.transform(citations, lambda c: F.array_sort(F.map_entries(c["multilingual"]))))
