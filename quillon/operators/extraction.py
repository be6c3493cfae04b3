"""Citations out of paragraphs by a model: prompt, JSON, metadata, checks, one retry by another model."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.jsonrepair import extracted_json
from ..functions.text import https, link_targets, year_of
from ..functions.urls import normal_url, normal_urls
from ..session import stored
from .citations import link_mismatches, paragraph_links
from .models import CompletionProvider, complete

REPLY = "struct<sentences:array<struct<stripped_sentence:string,citations:array<struct<citation_url:string,citation_year:int,citation_tags:array<string>,citation_paragraphs:array<int>>>>>>"
# Error codes; those of the second group may vanish with another reply.
FATAL = ("no_metadata", "year_mismatch")
RETRYABLE = ("no_json", "invalid_json", "link_mismatch", "unconsumed_links", "links_left", "no_paragraphs")
PROMPT = "Split the paragraph into sentences and give each sentence its citations as JSON (sentences: stripped_sentence, citations: citation_url, citation_year, citation_tags, citation_paragraphs).\n{paragraph}"


LINK = re.compile(r"\[((?:[^\[\]]|\\.)*)\]\(([^()\s]*)\)")


class LinkProvider:
    """Deterministic replies for dry runs: the prompt's sentences with their links as citations, by hash with one of the faults that a model's replies have.

    Of `every` replies one isn't JSON, one lacks its first citation; of `every` citations one has no paragraphs, one a wrong year. Without faults for 0.
    """

    def __init__(self, name: str, every: int = 10) -> None:
        self.name, self.every = name, every

    def _fault(self, text: str) -> int:
        return int(hashlib.sha256((self.name + text).encode()).hexdigest()[:8], 16) % self.every if self.every else -1

    def complete(self, prompts: list[str]) -> list[str | None]:
        return [self._reply(p.partition("\n")[2]) for p in prompts]

    def _reply(self, paragraph: str) -> str:
        fault = self._fault(paragraph)
        if fault == 0:
            return "I found no citations."
        urls: list[str] = []

        def marked(m: re.Match) -> str:
            urls.append(m[2])
            return f"\x00{len(urls) - 1}\x00"

        sentences = []
        for part in re.split(r"(?<=[.!?])\s+", LINK.sub(marked, paragraph)):
            cited = []
            for i in re.findall("\x00(\\d+)\x00", part):
                kind = self._fault(f"{i} {paragraph}")
                cited.append({"citation_url": urls[int(i)], "citation_year": 1900 if kind == 0 else None, "citation_tags": [], "citation_paragraphs": [] if kind == 1 else [len(part) % 90 + 1]})
            sentences.append({"stripped_sentence": re.sub(r" ?\[?\x00\d+\x00(?:; \x00\d+\x00)*\]?", "", part), "citations": cited})
        if fault == 1 and (full := [x for x in sentences if x["citations"]]):
            del full[0]["citations"][0]
        return json.dumps({"sentences": sentences}, ensure_ascii=False)


def _one_pass(tasks: DataFrame, metadata: DataFrame, provider: CompletionProvider) -> DataFrame:
    prompts = tasks.withColumn("system", F.lit(None).cast("string")).withColumn("prompt", F.replace(F.lit(PROMPT), F.lit("{paragraph}"), F.col("paragraph_text")))
    replies, _ = complete(prompts, None, provider)
    parsed = replies.withColumn("x", extracted_json(F.col("response"))).withColumn("r", F.from_json("x.json", REPLY))
    sentences = F.coalesce(F.transform("r.sentences", lambda s: s["stripped_sentence"]), F.array().cast("array<string>"))
    lists = F.coalesce(F.transform("r.sentences", lambda s: F.transform(F.coalesce(s["citations"], F.array().cast("array<struct<citation_url:string,citation_year:int,citation_tags:array<string>,citation_paragraphs:array<int>>>")), lambda c: c.withField("citation_url", https(c["citation_url"])))), F.array())
    base = stored(parsed.select("guide_id", "paragraph_id", "paragraph_text", sentences.alias("sentences"), lists.alias("lists"), F.col("x.error").alias("json_error")))
    flat = base.select("guide_id", "paragraph_id", F.posexplode("lists").alias("s", "cs")).select("guide_id", "paragraph_id", "s", F.posexplode("cs").alias("i", "c")).withColumn("c", F.col("c").withField("citation_url", normal_url(F.col("c.citation_url"))))
    found = flat.join(metadata.select(F.col("url").alias("m_url"), "kpdate", "multilingual"), F.col("c.citation_url") == F.col("m_url"), "left")
    wrong = (F.col("c.citation_year") > 0) & (year_of(F.col("kpdate")) > 0) & (F.col("c.citation_year") != year_of(F.col("kpdate")))
    codes = F.filter(F.array(F.when(F.col("m_url").isNull(), "no_metadata"), F.when(wrong, "year_mismatch"), F.when(F.coalesce(F.size("c.citation_paragraphs"), F.lit(0)) <= 0, "no_paragraphs")), lambda e: e.isNotNull())
    built = F.struct("s", "i", F.col("c.citation_url").alias("original_url"), F.coalesce("c.citation_year", year_of(F.col("kpdate"))).alias("citation_year"), "c.citation_tags", "c.citation_paragraphs", F.col("kpdate").alias("citation_date"), F.coalesce("multilingual", F.create_map().cast("map<string,struct<id:string,docname:string>>")).alias("multilingual"), codes.alias("codes"))
    per = found.groupBy("guide_id", "paragraph_id").agg(F.array_sort(F.collect_list(built), lambda a, b: F.when(a["s"] != b["s"], a["s"] - b["s"]).otherwise(a["i"] - b["i"])).alias("citations"))
    whole = base.join(per, ["guide_id", "paragraph_id"], "left").withColumn("links", normal_urls(paragraph_links(F.col("paragraph_text"))))
    links = F.filter("links", lambda u: u.startswith("https://"))
    urls = F.coalesce(F.transform("citations", lambda c: c["original_url"]), F.array().cast("array<string>"))
    v = link_mismatches(urls, links)
    own = F.array(
        F.when(F.col("json_error").isNotNull(), F.when(F.col("json_error").startswith("Invalid"), "invalid_json").otherwise("no_json")),
        F.when(F.col("json_error").isNull() & (v["mismatched"] > 0), "link_mismatch"), F.when(F.col("json_error").isNull() & (v["unconsumed"] > 0), "unconsumed_links"), F.when(F.size(link_targets(F.array_join("sentences", " "))) > 0, "links_left"),
    )
    errors = F.array_distinct(F.concat(F.filter(own, lambda e: e.isNotNull()), F.coalesce(F.flatten(F.transform("citations", lambda c: c["codes"])), F.array().cast("array<string>"))))
    return whole.select("guide_id", "paragraph_id", "paragraph_text", "sentences", "citations", errors.alias("errors"))


def retryable(errors: Column) -> Column:
    """Whether there are errors and each may vanish with another reply."""
    return (F.size(errors) > 0) & F.forall(errors, lambda e: e.isin(*RETRYABLE))


def extract_citations(tasks: DataFrame, metadata: DataFrame, provider: CompletionProvider, fallback: CompletionProvider | None = None) -> DataFrame:
    """(guide_id, paragraph_id, sentences, citations, errors, n_errors): one row for each distinct task with a text.

    tasks: guide_id, paragraph_id, paragraph_text; repeats of a key are sent once (the greatest text). metadata: url,
    kpdate, multilingual. Where all errors are retryable the fallback is asked, and its result taken.
    """
    once = tasks.where("trim(paragraph_text) <> ''").groupBy("guide_id", "paragraph_id").agg(F.max("paragraph_text").alias("paragraph_text"))
    first = stored(_one_pass(once, metadata, provider))
    if fallback is not None:
        again = _one_pass(first.where(retryable(F.col("errors"))).select("guide_id", "paragraph_id", "paragraph_text"), metadata, fallback)
        first = first.where(~retryable(F.col("errors"))).unionByName(again)
    return first.drop("paragraph_text").withColumn("n_errors", F.size("errors"))
