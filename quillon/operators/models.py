"""Model-backed steps: a cache in front of a pluggable provider, and the pipelines built on it."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import doc_numbers, facts_of, filled, lines, numbered, prompt_hash, question_of, score, without_citations, without_trailing_list
from ..session import stored
from .citations import CITATION, all_or_nothing
from .retrieval import top_k

# Own templates; {name} is filled from columns.
TEMPLATES = {
    "question": "Write one question in LANG that these paragraphs answer. Begin with 'Question:'.\n{paragraphs}",
    "answer": "Answer the question from the paragraphs only. End each sentence with the numbers of its citations, as [1].\nQuestion: {question}\n{paragraphs}\nCitations:\n{citations}",
    "quality": "Rate the pair. Give Relevance Score:, Clarity Score: and Completeness Score:, each from 1 to 5.\nQuestion: {question}\nAnswer: {answer}",
    "grounding": "Rate how far the answer rests on the reference. Give Support Score: and Citation Score:, each from 1 to 5.\nAnswer: {answer}\nReference: {reference}",
    "rag": "Answer from the documents, one sentence a line, with [Doc i] after each.\n{documents}\nQuestion: {question}",
    "translate": "Translate to LANG: {text}",
    "recall": 'How much of the gold answer is in the generated one, 0 to 6? Reply as {"evaluation": {"rating": n}}.\nGold: {gold}\nGenerated: {generated}',
    "faithfulness": 'Do the cited paragraphs bear out each sentence, and are they the right ones, each from 0 to 5? Reply as {"faithfullness_evaluation": {"faithfullness_rating": n}, "citation_correctness_evaluation": {"citation_correctness_rating": n}}.\n{sentences}',
    "similarity": 'How near are the paragraphs cited only by the generated answer, with those cited by both, to those cited only by the gold one, 0 to 5? Reply as {"evaluation": {"rating": n}}.\nQuestion: {question}\nGenerated only:\n{generated}\nBoth:\n{both}\nGold only:\n{gold}',
}
LANGUAGE_NAMES = {"eng": "English", "fre": "French", "ron": "Romanian"}


class CompletionProvider(Protocol):
    name: str

    def complete(self, prompts: list[str]) -> list[str | None]: ...


class FakeProvider:
    """Deterministic replies for tests and dry runs, from the hash of the prompt."""

    name = "fake-1"

    def complete(self, prompts: list[str]) -> list[str | None]:
        out: list[str | None] = []
        for p in prompts:
            n = int(hashlib.sha256(p.encode()).hexdigest()[:8], 16)
            if p.startswith("Write one question"):
                out.append(f"Question: What follows from paragraph {n % 9 + 1}? Nothing else.")
            elif p.startswith("Answer the question"):
                out.append(f"It follows from the text [{n % 3 + 1}]. It is settled [1, 2].")
            elif p.startswith("Rate the pair"):
                out.append(f"Relevance Score: {n % 2 + 4}\nClarity Score: {n // 7 % 3 + 3}\nCompleteness Score: 5")
            elif p.startswith("Rate how far"):
                out.append(f"Support Score: {n % 3 + 3}\nCitation Score: 5")
            elif p.startswith("Answer from the documents"):
                out.append(f"The first point holds [Doc {n % 4 + 1}].\nThe second rests on [Doc 1, 2].\nCitations: [Doc 1]")
            elif p.startswith("How much of the gold"):
                out.append(f'{{"evaluation": {{"rating": {n % 8}}}}}')
            elif p.startswith("Do the cited paragraphs"):
                out.append(f'{{"faithfullness_evaluation": {{"faithfullness_rating": {n % 7}}}, "citation_correctness_evaluation": {{"citation_correctness_rating": {n // 7 % 6}}}}}')
            elif p.startswith("How near are"):
                out.append(f'{{"evaluation": {{"rating": {n % 7}}}}}')
            else:
                out.append(f"reply {n % 1000}")
        return out


def template(name: str, lang: str = "eng") -> str:
    return TEMPLATES[name].replace("LANG", LANGUAGE_NAMES[lang].upper())


def complete(prompts: DataFrame, cache: DataFrame | None, provider: CompletionProvider, temperature: float = 1.0, batch: int = 64) -> tuple[DataFrame, DataFrame]:
    """prompts (prompt_id, system, prompt) answered: (rows with response, new cache rows).

    Prompts are told apart by hash of system and prompt, model and temperature; each distinct one that the cache lacks
    (or holds an empty response for) is sent once. Failed prompts have a null response and aren't cached. What the
    provider returned is written to the shared folder at once, so that no later step asks it again.
    """
    keyed = prompts.withColumn("prompt_hash", prompt_hash(F.col("system"), F.col("prompt")))
    need = keyed.where("prompt IS NOT NULL").select("prompt_hash", "system", "prompt").dropDuplicates(["prompt_hash"])
    known = None
    if cache is not None:
        known = cache.where((F.col("model_name") == provider.name) & (F.col("temperature") == temperature) & (F.coalesce("response_content", F.lit("")) != "")).select("prompt_hash", F.col("response_content").alias("response"))
        need = need.join(known.select("prompt_hash"), "prompt_hash", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            asked = [(s or "") + p for s, p in zip(b.column("system").to_pylist(), b.column("prompt").to_pylist())]
            replies = [r for i in range(0, len(asked), batch) for r in provider.complete(asked[i : i + batch])]
            yield pa.RecordBatch.from_arrays([b.column("prompt_hash"), b.column("prompt"), pa.array(replies, pa.string())], names=["prompt_hash", "prompt", "response"])

    asked = stored(need.mapInArrow(run, "prompt_hash string, prompt string, response string"))
    fresh = asked.where("response IS NOT NULL").select("prompt_hash", F.lit(provider.name).alias("model_name"), F.lit(temperature).alias("temperature"), "prompt", F.col("response").alias("response_content"))
    answers = asked.select("prompt_hash", "response")
    if known is not None:
        answers = answers.unionByName(known)
    return keyed.join(answers, "prompt_hash", "left"), fresh


def _asked(rows: DataFrame, prompt: Column, out: str, provider: CompletionProvider, cache: DataFrame | None = None) -> DataFrame:
    answered, _ = complete(rows.withColumn("system", F.lit(None).cast("string")).withColumn("prompt", prompt), cache, provider)
    return answered.withColumnRenamed("response", out).drop("prompt_hash", "system", "prompt")


def qa_pairs(groups: DataFrame, provider: CompletionProvider, lang: str = "eng") -> DataFrame:
    """groups (guide_id, group_id, paragraphs array<string>, citations array<string>) to question, facts and gates.

    Questions, then answers, then the quality gate (least of three scores at least 4) and, for those that pass, the
    grounding gate (least of two). Columns: guide_id, group_id, question, facts, quality, grounded (null where not asked).
    """
    g = groups.withColumn("text", F.array_join("paragraphs", " "))
    g = _asked(g, filled(template("question", lang), paragraphs=F.col("text")), "reply", provider).withColumn("question", question_of(F.col("reply"))).drop("reply")
    g = _asked(g, filled(template("answer"), question=F.col("question"), paragraphs=F.array_join("paragraphs", "\n"), citations=numbered(F.col("citations"))), "answer", provider)
    g = _asked(g, filled(template("quality"), question=F.col("question"), answer=F.col("answer")), "rated", provider)
    g = stored(g.withColumn("quality", F.coalesce(F.least(*(F.coalesce(score(F.col("rated"), s), F.lit(0)) for s in ("Relevance", "Clarity", "Completeness"))) >= 4, F.lit(False))))
    passed = _asked(g.where("quality"), filled(template("grounding"), answer=F.col("answer"), reference=F.col("text")), "support", provider)
    gate = passed.select("guide_id", "group_id", (F.least(score(F.col("support"), "Support"), score(F.col("support"), "Citation")) >= 4).alias("grounded"))
    return g.join(gate, ["guide_id", "group_id"], "left").select("guide_id", "group_id", "question", facts_of(F.col("answer")).alias("facts"), "quality", "grounded")


def rag_answers(questions: DataFrame, passages: DataFrame, provider: CompletionProvider, k: int = 4) -> DataFrame:
    """questions (id, question, embedding) answered from the k nearest passages (id, text, embedding).

    Columns: id, question, sentences array<struct<sentence, citations array<long>>>: citations are ids of passages;
    numbers that name no document are left out, as is a list of citations at the end.
    """
    near = top_k(questions.select("id", "embedding"), passages.select("id", "embedding"), k)
    found = near.join(passages.select(F.col("id").alias("vec_id"), "text"), "vec_id").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "text"))).alias("docs"))
    rows = questions.select("id", "question").join(found, F.col("id") == F.col("query_id"), "left").drop("query_id")
    answered = _asked(rows, filled(template("rag"), documents=F.coalesce(numbered(F.transform("docs", lambda d: d["text"]), "Doc"), F.lit("")), question=F.col("question")), "reply", provider)
    kept = without_trailing_list(lines(F.col("reply")))
    return answered.select("id", "question", F.transform(kept, lambda s: F.struct(
        without_citations(s).alias("sentence"), F.filter(F.transform(doc_numbers(s), lambda n: F.get("docs", F.least(n, F.lit(2**31 - 1)).cast("int") - 1)["vec_id"]), lambda v: v.isNotNull()).alias("citations"),
    )).alias("sentences"))


def rag_experiment(name: str, questions: DataFrame, passages: DataFrame, provider: CompletionProvider, k: int = 4, lang: str = "ron") -> DataFrame:
    """rag_answers() of a run by its name `..._<translation>`: `pre` translates the questions to English before, `post` the answers' sentences to lang after.

    Columns: id, question (as it was asked), sentences.
    """
    translation = name.rpartition("_")[2]
    if translation == "pre":
        asked = translated(questions, "question", "eng", provider).withColumn("question", F.coalesce("translation", "question")).drop("translation")
        return rag_answers(asked, passages, provider, k)
    answers = rag_answers(questions, passages, provider, k)
    if translation != "post":
        return answers
    flat = answers.select("id", F.posexplode_outer("sentences").alias("n", "s")).select("id", "n", F.col("s.sentence").alias("sentence"), F.col("s.citations").alias("citations"))
    said = translated(flat, "sentence", lang, provider).withColumn("sentence", F.coalesce("translation", "sentence"))
    whole = said.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.when(F.col("sentence").isNotNull(), F.struct("n", "sentence", "citations")))), lambda x: F.struct(x["sentence"].alias("sentence"), x["citations"].alias("citations"))).alias("sentences"))
    return answers.select("id", "question").join(whole, "id")


def judged_rating(reply: Column, most: int, path: str = "evaluation.rating") -> Column:
    """The rating in a judge's JSON, by pattern where that is broken; -1 if there is none or it is out of 0..most, -2 for no reply."""
    rating = F.coalesce(F.get_json_object(reply, f"$.{path}").try_cast("int"), F.nullif(F.regexp_extract(reply, rf'"{path.split(".")[-1]}"\s*:\s*"?(\d)"?', 1), F.lit("")).try_cast("int"))
    return F.when(reply.isNull(), -2).when(rating.between(0, most), rating).otherwise(-1)


def judged_recall(rows: DataFrame, provider: CompletionProvider) -> DataFrame:
    """rows (id, gold, generated) with llm_claim_recall: 0 to 6, -1 unreadable, -2 where an input is missing."""
    both = F.col("gold").isNotNull() & F.col("generated").isNotNull()
    answered = _asked(rows, F.when(both, filled(TEMPLATES["recall"], gold=F.col("gold"), generated=F.col("generated"))), "reply", provider)
    return answered.select("id", judged_rating(F.col("reply"), 6).alias("llm_claim_recall"))


#: A generated answer's sentences with what they cite.
CITED = "array<struct<sentence:string,citations:array<struct<case_id:string,paragraph_number:string,paragraph_text:string>>>>"


def judged_faithfulness(rows: DataFrame, provider: CompletionProvider) -> DataFrame:
    """rows (id, generated_citations JSON) with llm_faithfulness and llm_citation_correctness: 0 to 5, both -1 if one is unreadable, -2 where the JSON isn't readable or lacks a part."""
    said = F.from_json("generated_citations", CITED)
    lacking = F.exists(said, lambda s: s.isNull() | s["sentence"].isNull() | s["citations"].isNull() | F.coalesce(F.exists(s["citations"], lambda c: c["paragraph_text"].isNull()), F.lit(False)))
    texts = F.transform(said, lambda s: F.struct(s["sentence"].alias("sentence"), F.map_from_entries(F.transform(s["citations"], lambda c, i: F.struct((i + 1).cast("string"), c["paragraph_text"]))).alias("citations")))
    answered = _asked(rows.select("id", "generated_citations"), F.when(said.isNotNull() & ~lacking, filled(TEMPLATES["faithfulness"], sentences=F.to_json(texts))), "reply", provider)
    one, two = (judged_rating(F.col("reply"), 5, path) for path in ("faithfullness_evaluation.faithfullness_rating", "citation_correctness_evaluation.citation_correctness_rating"))
    unreadable = (one == -1) | (two == -1)
    return answered.select("id", F.when(unreadable, -1).otherwise(one).alias("llm_faithfulness"), F.when(unreadable, -1).otherwise(two).alias("llm_citation_correctness"))


def gold_keys(answer: Column, lang: str = "eng") -> Column:
    """Distinct (case_id, num) that the facts of a gold answer cite, in order; null if it isn't readable or a citation lacks an id of the language or its paragraphs."""
    facts = F.from_json(answer, f"array<struct<citations:array<{CITATION}>>>")
    cited = F.flatten(F.transform(facts, lambda f: F.coalesce(f["citations"], F.from_json(F.lit("[]"), f"array<{CITATION}>"))))
    version = lambda c: F.try_element_at(c["multilingual"], F.lit(lang))["id"]
    lacking = F.exists(cited, lambda c: version(c).isNull() | c["citation_paragraphs"].isNull() | F.coalesce(F.exists(c["citation_paragraphs"], lambda p: p.isNotNull() & p.try_cast("int").isNull()), F.lit(False)))
    pairs = F.flatten(F.transform(F.filter(cited, lambda c: version(c) != ""), lambda c: F.transform(F.filter(c["citation_paragraphs"], lambda p: p.isNotNull()), lambda p: F.struct(version(c).alias("case_id"), p.try_cast("int").alias("num")))))
    return F.when(~lacking, F.array_distinct(pairs))


def generated_keys(cited: Column) -> Column:
    """Distinct (case_id, num) that a generated answer cites, in order; null if it isn't readable or a number is none."""
    all_ = F.filter(F.flatten(F.transform(F.from_json(cited, CITED), lambda s: F.coalesce(s["citations"], F.array()))), lambda c: (F.coalesce(c["case_id"], F.lit("")) != "") & c["paragraph_number"].isNotNull())
    lacking = F.exists(all_, lambda c: c["paragraph_number"].try_cast("int").isNull())
    return F.when(~lacking, F.array_distinct(F.transform(all_, lambda c: F.struct(c["case_id"].alias("case_id"), c["paragraph_number"].try_cast("int").alias("num")))))


def judged_similarity(rows: DataFrame, paragraphs: DataFrame, provider: CompletionProvider, lang: str = "eng") -> DataFrame:
    """rows (id, question, target_answer JSON, generated_citations JSON) with llm_citation_semantic_similarity: 0 to 5, -1 unreadable, -2 where citations aren't readable or one of them isn't in paragraphs.

    paragraphs: case_id, case_name, paragraph_number, paragraph_text; of several of a number the least counts. Ids must differ.
    """
    keys = rows.select("id", "question", gold_keys(F.col("target_answer"), lang).alias("gold"), generated_keys(F.col("generated_citations")).alias("gen")).where("gold IS NOT NULL AND gen IS NOT NULL")
    sets = stored(keys.select("id", "question", F.array_except("gen", "gold").alias("a"), F.array_intersect("gen", "gold").alias("b"), F.array_except("gold", "gen").alias("c")))
    wanted = sets.select("id", F.posexplode(F.concat("a", "b", "c")).alias("ord", "k")).select("id", "ord", "k.case_id", "k.num")
    num = F.col("paragraph_number").cast("int")
    there = paragraphs.select("case_id", num.alias("num"), F.concat(F.coalesce("case_name", F.lit("")), F.lit(", paragraph "), num.cast("string"), F.lit(": "), F.coalesce("paragraph_text", F.lit(""))).alias("text"))
    found = sets.join(all_or_nothing(wanted, there, "id", ["case_id", "num"], "text"), "id", "left").withColumn("values", F.when(F.size(F.concat("a", "b", "c")) == 0, F.array().cast("array<string>")).otherwise(F.col("values")))
    part = lambda start, size: F.coalesce(F.nullif(F.array_join(F.slice("values", start, size), "\n"), F.lit("")), F.lit("None"))
    a, b, c = F.size("a"), F.size("b"), F.size("c")
    prompt = filled(TEMPLATES["similarity"], question=F.coalesce("question", F.lit("")), generated=part(F.lit(1), a), both=part(a + 1, b), gold=part(a + b + 1, c))
    asked = _asked(found, F.when(F.col("values").isNotNull(), prompt), "reply", provider).select("id", judged_rating(F.col("reply"), 5).alias("s"))
    return rows.select("id").join(asked, "id", "left").select("id", F.coalesce("s", F.lit(-2)).alias("llm_citation_semantic_similarity"))


def scored(rows: DataFrame, paragraphs: DataFrame, provider: CompletionProvider) -> DataFrame:
    """rows (id, question, target_answer, generated_answer, generated_citations, any others; ids differ) with the four scores of the judges."""
    recall = judged_recall(rows.select("id", F.col("target_answer").alias("gold"), F.col("generated_answer").alias("generated")), provider)
    return rows.join(recall, "id").join(judged_faithfulness(rows, provider), "id").join(judged_similarity(rows, paragraphs, provider), "id")


def translated(rows: DataFrame, text_col: str, lang: str, provider: CompletionProvider) -> DataFrame:
    """rows with `translation`: null for null, '' for ''."""
    sent = F.when(F.col(text_col) != "", filled(template("translate", lang), text=F.col(text_col)))
    return _asked(rows, sent, "translation", provider).withColumn("translation", F.when(F.col(text_col) == "", "").otherwise(F.col("translation")))


