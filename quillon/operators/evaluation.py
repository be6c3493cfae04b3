"""Evaluation frames: registries, selections, completeness, score reports."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import strategy

# Configurations of runs.
MODELS, TRANSLATIONS, DOC_EMBEDS = ("flash", "llama", "k2"), ("pre", "post", "none"), ("base", "instruct")
SENTINELS = (-1, -2)
# Own wording: what passages and queries are told to be when they are embedded.
DOCUMENTS = {
    "base": "", "passage": "Represent this passage of a judgment", "legal": "Represent this legal passage for retrieval", "cited": "Represent this passage as it may be cited", "facts": "Represent the facts of this passage", "law": "Represent the rule of law in this passage",
    "reasoning": "Represent the reasoning of this passage", "question": "Represent the question that this passage answers", "eng": "Represent this English passage", "fre": "Represent this French passage", "ron": "Represent this Romanian passage",
}
QUERIES = {
    "base": "", "search": "Search for the passage that answers the question", "legal": "Find the passage of a judgment that answers the question", "cited": "Find the passage that is cited for this statement", "support": "Find the passage that bears out this statement",
    "rule": "Find the rule of law that applies", "similar": "Find passages with the same meaning", "ron": "Find the passage for this Romanian question", "translated": "Find the passage for this translated question",
}
INSTRUCTIONS = {"base": "", "legal": "Find the passage of a judgment that answers the question", "cited": "Find the passage that is cited for this statement", "ron": "Find the passage for this Romanian question"}


def registry(spark: SparkSession) -> DataFrame:
    """All runs by name with their parsed parts."""
    names = [(f"doc_{d}_query_{q}_{m}_{t}",) for d, q, m, t in itertools.product(DOC_EMBEDS, ("base", "translation_echr_retrieve"), MODELS, TRANSLATIONS)]
    df = spark.createDataFrame(names, "name string")
    return df.select("name", *[c.alias(k) for k, c in strategy(F.col("name")).items()])


def select_runs(runs: DataFrame, **wanted: str | None) -> DataFrame:
    """Runs that have the given values; None asks nothing."""
    for column, value in wanted.items():
        if value is not None:
            runs = runs.where(F.col(column) == value)
    return runs


def with_eval(runs: DataFrame, evals: DataFrame, prefix: str = "e_") -> DataFrame:
    """runs joined to evals (file_key, ...) by name, else by name with prefix."""
    keyed = evals.select("file_key", *[c for c in evals.columns if c != "file_key"])
    bare = keyed.withColumn("name", F.when(F.col("file_key").startswith(prefix), F.substr("file_key", F.lit(len(prefix) + 1))).otherwise(F.col("file_key"))).withColumn("exact", ~F.col("file_key").startswith(prefix))
    best = bare.groupBy("name").agg(F.max("exact").alias("best"))
    return runs.join(bare.join(best, "name").where(F.col("exact") == F.col("best")).drop("exact", "best", "file_key"), "name", "left")


def complete_rows(df: DataFrame, scores: list[str]) -> Column:
    """Whether all scores of a row are there; false if a column is missing."""
    missing = [s for s in scores if s not in df.columns]
    if missing or not scores:
        return F.lit(False)
    out = F.col(scores[0]).isNotNull() & ~F.isnan(F.col(scores[0]).cast("double"))
    for s in scores[1:]:
        out = out & F.col(s).isNotNull() & ~F.isnan(F.col(s).cast("double"))
    return out


def valid_scores(df: DataFrame, score: str, sentinels: tuple[int, ...] = SENTINELS) -> DataFrame:
    return df.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")) & ~F.col(score).isin(*sentinels))


def mean_and_std(df: DataFrame, score: str, *group: str, sentinels: tuple[int, ...] = SENTINELS) -> DataFrame:
    """`mean ± std` with three decimals (halves to even) by group, N/A where a group has no valid score."""
    groups = df.select(*group).distinct()
    s = valid_scores(df, score, sentinels).groupBy(*group).agg(F.avg(score).alias("m"), F.coalesce(F.stddev_samp(score), F.lit(float("nan"))).alias("s"))
    text = F.when(F.col("m").isNull(), "N/A").otherwise(F.format_string("%.3f ± %.3f", F.bround("m", 3), F.bround("s", 3)))
    return groups.join(s, list(group), "left").select(*group, text.alias("report"))


def usable_gold(df: DataFrame, gold: str, blocked: list[str]) -> DataFrame:
    """Rows with some gold and none of it blocked."""
    out = df.where(F.size(gold) > 0)
    return out.where(~F.arrays_overlap(F.col(gold), F.array(*map(F.lit, blocked)))) if blocked else out


def unanswered(df: DataFrame, answer: str = "generated_answer") -> DataFrame:
    return df.where(F.col(answer).isNull()) if answer in df.columns else df


def same_root(pairs: DataFrame) -> DataFrame:
    """Pairs a, b of one document set where b's query is a's in Romanian."""
    return pairs.where((F.col("a_doc") == F.col("b_doc")) & (F.concat("a_query", F.lit("_ron")) == F.col("b_query")))


def in_order(df: DataFrame, column: str, template: list[str]) -> DataFrame:
    """Rows in the order of the template, others after by name, translation variants last."""
    position = F.array_position(F.array(*map(F.lit, template)), F.col(column))
    return df.orderBy(F.col(column).startswith("translation"), F.when(position == 0, len(template) + 1).otherwise(position), column)


def unique_keys(citations_json: Column) -> Column:
    """Ordered distinct (case_id, paragraph_number) of a generated answer's sentences; null for null, [] for none."""
    parsed = F.from_json(citations_json, "array<struct<sentence:string,citations:array<struct<case_id:string,case_name:string,paragraph_number:int,paragraph_text:string>>>>")
    keys = F.flatten(F.transform(parsed, lambda s: F.transform(F.coalesce(s["citations"], F.array().cast("array<struct<case_id:string,case_name:string,paragraph_number:int,paragraph_text:string>>")), lambda c: F.struct(c["case_id"].alias("case_id"), c["paragraph_number"].alias("paragraph_number")))))
    return F.array_distinct(keys)


def gold_keys(answer_json: Column, language: str = "eng") -> Column:
    """Ordered distinct (case_id, paragraph_number) of gold facts; null if a citation lacks the id of the language."""
    parsed = F.from_json(answer_json, "array<struct<text:string,citations:array<struct<citation_paragraphs:array<int>,multilingual:map<string,struct<id:string,docname:string>>>>>>")
    cited = F.flatten(F.transform(F.filter(parsed, lambda f: f["citations"].isNotNull()), lambda f: f["citations"]))
    one = lambda c: F.try_element_at(c["multilingual"], F.lit(language))["id"]
    keys = F.flatten(F.transform(cited, lambda c: F.transform(F.coalesce(c["citation_paragraphs"], F.array().cast("array<int>")), lambda p: F.struct(one(c).alias("case_id"), p.alias("paragraph_number")))))
    return F.when(~F.exists(cited, lambda c: one(c).isNull()), F.array_distinct(keys))


def sentence_texts(citations_json: Column) -> Column:
    """Each sentence with its citations' texts numbered from 1, as JSON; null if it isn't readable."""
    parsed = F.from_json(citations_json, "array<struct<sentence:string,citations:array<struct<paragraph_text:string>>>>")
    out = F.transform(parsed, lambda s: F.struct(s["sentence"].alias("sentence"), F.map_from_entries(F.transform(s["citations"], lambda c, i: F.struct((i + 1).cast("string").alias("k"), c["paragraph_text"].alias("v")))).alias("citations")))
    return F.to_json(out)


def first_rows(df: DataFrame, ordinal: str, n: int | None) -> DataFrame:
    return df if n is None else df.orderBy(ordinal).limit(n)


def by_model(runs: DataFrame) -> DataFrame:
    """(model, names): the names of each model's runs, sorted."""
    return runs.groupBy("model").agg(F.sort_array(F.collect_set("name")).alias("names"))


def metric_table(scores: DataFrame, models: list[str]) -> DataFrame:
    """(metric, model, value) as a row for each metric, a column for each model in the order given; means of repeats."""
    return scores.groupBy("metric").pivot("model", models).agg(F.avg("value"))


def sample_groups(groups: DataFrame, n_guides: int = 15, n_groups: int = 10, seed: int = 112) -> DataFrame:
    """(guide_id, group_id, rank): groups of n_guides guides, by hash with the seed.

    Guides are taken in the order of their hash; each gives at most n_groups groups, and a guide that has fewer lowers
    that number for all after it. Null guides take no part. The running least is over the n_guides guides alone.
    """
    g = groups.where("guide_id IS NOT NULL").select("guide_id", "group_id").distinct()
    hashed = lambda *parts: F.md5(F.concat(F.lit(str(seed)), *parts))
    guides = g.groupBy("guide_id").agg(F.count("*").alias("n")).withColumn("h", hashed("guide_id")).orderBy("h", "guide_id").limit(n_guides)
    order = Window.orderBy("h", "guide_id").rowsBetween(Window.unboundedPreceding, 0)
    caps = guides.withColumn("cap", F.least(F.lit(n_groups), F.min("n").over(order))).select("guide_id", "cap")
    by = Window.partitionBy("guide_id").orderBy(hashed("guide_id", F.lit("/"), F.col("group_id").cast("string")), "group_id")
    return g.join(F.broadcast(caps), "guide_id").withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= F.col("cap")).select("guide_id", "group_id", "rank")
