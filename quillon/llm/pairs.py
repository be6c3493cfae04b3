"""Problem 6: broken pairs of question and answer."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread, stored
from .corpus import QUESTION, Corpus, completed, questions, token_table
from .cuts import distinct_texts
from .endings import CLOSING, FINAL, Endings, core
from .refusals import kind_of

#: Sureness of a complete end below which an answer breaks off.
DOUBT = 0.4
# What an answer that says nothing consists of, letters and digits only.
FILLERS = set("|na|none|null|nil|nan|nothing|empty|tbd|tba|todo|undefined|noanswer|notavailable|notapplicable|unknown|aucun|aucune|néant|rien|sansobjet|so|àcompléter|vide|niciunul|niciuna|nimic|nespecificat|fărărăspuns|keine|keineangabe|ka|nichts|нет|нетответа|لايوجد|无|暂无|なし|ไม่มี|कोईनहीं|x|xx|xxx|lorem|placeholder|answer|réponse|răspuns".split("|"))
# Words that give an answer's question again before it.
FRAMES = set("question q the is asked was you ask would like to know on answer la est posée était vous demandez souhaitez savoir à întrebarea întrebare este întrebați doriți să aflați pusă a fost frage die lautet sie fragen".split())
# Frequent words of each language in Latin script; those of the last five that French or English share are left out.
STOPWORDS = {
    "eng": "the of and to in that was had is for on with by as at it his her which from be been not were an or there this has have under although given neither nor whether what when how did does must can a born lives".split(),
    "fre": "le la les de des du et à que qui dans est une un en pour par sur pas au aux ce cette il elle sont été était avait dont ne se d l n s qu où selon quelles quels comment sous a pour né née".split(),
    "ron": "de la și în că nu a al ale cu pe din pentru este sau un o care fost fi lui unui unei prin după către se s-a ce când cum potrivit iar sunt era avea urmare".split(),
    "spa": "el los las del y por con su no lo como más pero fue había sido según cuando qué cuál cómo también ha este esta".split(),
    "ita": "il gli di della che è non alla dei delle nel nella sono stato anche quando quale dal dalla secondo come cosa era".split(),
    "por": "os as do da em uma não dos das são mais mas também quando qual segundo pelo pela foi ser".split(),
    "nld": "het een van dat op te met voor niet zijn aan om hij als ook door bij wordt werd heeft naar wanneer welke volgens".split(),
    "deu": "der die das und in den dem des von zu mit dass nicht ist war wurde ein eine auf für als auch nach bei aus im am sich hat unter gegen ohne folgt wonach".split(),
}
SCRIPTS = {"rus": r"\p{Cyrillic}", "ara": r"\p{Arabic}", "jpn": r"[\p{Hiragana}\p{Katakana}]", "zho": r"\p{Han}", "tha": r"\p{Thai}", "hin": r"\p{Devanagari}"}
SCRIPT_MARKS = {k: regex.compile(v) for k, v in SCRIPTS.items()}
VOTES: dict[str, set[str]] = {}
for _lang, _words in STOPWORDS.items():
    for _w in _words:
        VOTES.setdefault(_w, set()).add(_lang)
WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")
QUOTED = regex.compile(r"„[^“”]*[“”]|“[^”]*”|«[^»]*»|「[^」]*」|\"[^\"]*\"|\([^()]*\)")
BLANK = regex.compile(r"[^\p{L}\p{N}]+")
SENTENCE = regex.compile(r"(?<=[.!?।؟][»”\"]?)\s+|(?<=[。！？][」”]?)\s*")


def texts_of(answer: str | None) -> tuple[list[str], bool]:
    """The texts of an answer's facts, and whether its JSON breaks off. An answer that isn't JSON is one text."""
    if answer is None:
        return [], False
    value: Any = answer
    while isinstance(value, str):
        try:
            value = json.loads(value)
        except (ValueError, RecursionError):
            head = value.lstrip()
            if head[:1] in ("[", "{") and regex.match(r'[\[{]\s*(?:$|["{\[\]}])', head) or head[:2] in ('"[', '"{'):
                return [value], True
            return [value], False
    out: list[str] = []
    stack = [value]
    while stack:
        v = stack.pop()
        if isinstance(v, str):
            out.append(v)
        elif isinstance(v, list):
            stack.extend(reversed(v))
        elif isinstance(v, dict):
            inner = v.get("facts", v.get("text"))
            if inner is not None:
                stack.append(inner)
    return out, False


class SuffixAutomaton:
    """All substrings of a list of words."""

    def __init__(self, words: list[str]) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for w in words:
            cur = len(self.next)
            self.next.append({})
            self.link.append(0)
            self.length.append(self.length[last] + 1)
            p = last
            while p >= 0 and w not in self.next[p]:
                self.next[p][w] = cur
                p = self.link[p]
            if p >= 0:
                q = self.next[p][w]
                if self.length[p] + 1 == self.length[q]:
                    self.link[cur] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    self.link.append(self.link[q])
                    self.length.append(self.length[p] + 1)
                    while p >= 0 and self.next[p].get(w) == q:
                        self.next[p][w] = clone
                        p = self.link[p]
                    self.link[q] = self.link[cur] = clone
            last = cur

    def covered(self, words: list[str], least: int) -> list[bool]:
        """For each word whether it lies in a run of at least `least` words that the automaton knows."""
        out = [False] * len(words)
        state = size = 0
        for i, w in enumerate(words):
            while state and w not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if w in self.next[state]:
                state = self.next[state][w]
                size += 1
            else:
                state = size = 0
            if size >= least:
                out[i - size + 1 : i + 1] = [True] * size
        return out


def _words(text: str) -> list[str]:
    return [w.lower() for w in WORD.findall(text)]


def copies(question: str, answer: str) -> bool:
    """Whether the answer gives the question back and adds nothing: nearly all its words lie in runs taken from the question, which it covers for the most part."""
    q, a = _words(question), _words(answer)
    if len(q) < 3 or len(a) < 3:
        return False
    covered = SuffixAutomaton(q).covered(a, 2)
    rest = [w for w, c in zip(a, covered) if not c and w not in FRAMES]
    again = SuffixAutomaton(a).covered(q, 2)
    return len(rest) <= max(1, 0.12 * len(a)) and sum(again) >= 0.6 * len(q)


def refuses(text: str) -> bool:
    """Whether each sentence outside quotations declines or goes with that, and one declines."""
    declined = False
    for sentence in SENTENCE.split(QUOTED.sub(" ", text.replace("’", "'"))):
        words = _words(sentence)
        if not words or all(w in FRAMES for w in words):
            continue
        kind = kind_of(sentence)
        if kind is None:
            return False
        declined = declined or kind == "declines"
    return declined


def voted(text: str) -> str | None:
    """The language for which the most frequent words vote, or its script; None if undecided."""
    plain = QUOTED.sub(" ", text)
    letters = sum(c.isalpha() for c in plain)
    if not letters:
        return None
    for lang, mark in SCRIPT_MARKS.items():
        if len(mark.findall(plain)) > (0.08 if lang == "jpn" else 0.4) * letters:
            return lang
    votes: Counter = Counter()
    for w in _words(plain):
        for lang in VOTES.get(w, ()):
            votes[lang] += 1 / len(VOTES[w])
    for c in plain.lower():
        if c in "șțăŝ":
            votes["ron"] += 0.3
        elif c in "äöüß":
            votes["deu"] += 0.3
    ranked = votes.most_common(2)
    if not ranked or ranked[0][1] < 2 or len(ranked) > 1 and ranked[0][1] < 1.3 * ranked[1][1]:
        return None
    return ranked[0][0]


def defects_by_end(question: str | None, answer: str | None) -> tuple[str | None, str | None, float | tuple]:
    """The defect of a pair if its answer ends as it should, that if it breaks off there, and how surely it is complete or what Endings.answer() must be asked for that."""
    texts, broken = texts_of(answer)
    told = [t for t in texts if BLANK.sub("", t).lower() not in FILLERS]
    if not told:
        return "empty", "empty", 1.0
    if broken:
        return "truncated", "truncated", 1.0
    whole = " ".join(t.strip() for t in told)
    if refuses(whole):
        return "refusal", "refusal", 1.0
    if question and copies(question, whole):
        return "copied", "copied", 1.0
    end = ending_of(told[-1])
    return (None if isinstance(end, float) and end < DOUBT else other_language(question, told)), "truncated", end


def other_language(question: str | None, told: list[str]) -> str | None:
    """`language` if the most of an answer's texts is in another language than its question."""
    asked = voted(question) if question else None
    votes = Counter()
    for t in told if asked else ():
        if v := voted(t):
            votes[v] += len(QUOTED.sub(" ", t))
    if asked and votes:
        given, n = votes.most_common(1)[0]
        if given != asked and n > sum(votes.values()) / 2:
            return "language"
    return None


def defect_of(question: str | None, answer: str | None, endings: Endings | None) -> str | None:
    """The defect of a pair, the first that holds of `empty`, `truncated` (JSON), `refusal`, `copied`, `truncated`, `language`; None for a proper answer. Without endings no answer breaks off."""
    whole, broken, end = defects_by_end(question, answer)
    if endings is None:
        return whole
    return broken if (endings.answer(*end) if isinstance(end, tuple) else end) < DOUBT else whole


def ending_of(text: str) -> float | tuple:
    """How surely a text is complete, or what Endings.answer() must be asked for that."""
    end = core(text)
    bare = end.rstrip("".join(CLOSING) + "*_ ")
    if not end or bare and bare[-1] in FINAL and bare[-1] != ".":
        return 1.0
    return Endings.question(end)


def fact_ends(answer: str) -> list[tuple[str, bool]]:
    """The facts of an answer from which endings are learnt, and whether their end teaches one: not that of the last."""
    texts, broken = texts_of(answer)
    told = [t for t in texts if t.strip()]
    return [] if broken else [(t, i + 1 < len(told)) for i, t in enumerate(told)]


def broken_pairs(pairs: DataFrame) -> DataFrame:
    """One row for each defective key of question_generations: guide_id, group_id, grouping_method, model_name, defect.

    Repeated rows of a key count once, that of the least (question, answer); a null answer is empty, a null question can
    show neither copies nor languages; a null in the key makes no row. Other columns don't take part. Endings are learnt
    from all distinct answers (see corpus.py), but not from the end of an answer, where it may break off. The pairs are
    shuffled once, by key, and stored; besides, the distinct answers are, and the tokens of their facts stored.
    """
    key = ["guide_id", "group_id", "grouping_method", "model_name"]
    known = pairs.where(" AND ".join(f"{k} IS NOT NULL" for k in key))
    once = stored(known.groupBy(*key).agg(F.min(F.struct("question", "answer")).alias("pair")).select(*key, "pair.question", "pair.answer"))
    schema = ", ".join(f"{k} {pairs.schema[k].dataType.simpleString()}" for k in key) + f", whole string, broken string, complete double, {QUESTION}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [defects_by_end(q, a) for q, a in zip(batch.column("question").to_pylist(), batch.column("answer").to_pylist())]
            keep = [i for i, (whole, _, end) in enumerate(found) if whole or isinstance(end, tuple) or end < DOUBT]
            whole, broken, ends = zip(*(found[i] for i in keep)) if keep else ((), (), ())
            at = pa.array(keep, pa.int32())
            complete = pa.array([None if isinstance(x, tuple) else x for x in ends], pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in key), pa.array(whole, pa.string()), pa.array(broken, pa.string()), complete, *questions(ends)], names=[*key, "whole", "broken", "complete", "asked", "scale", "tail"])

    judged = completed(stored(spread(once).mapInArrow(run, schema)), lambda: Corpus(token_table(distinct_texts(once, "answer"), fact_ends)))
    return judged.select(*key, F.when(F.col("complete") < DOUBT, F.col("broken")).otherwise(F.col("whole")).alias("defect")).where("defect IS NOT NULL")
