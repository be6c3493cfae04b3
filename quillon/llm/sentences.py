"""Problem 1: sentence boundaries across languages and scripts.

A pushdown automaton runs over the marks of a text (terminators, quotation marks, brackets, line ends; in Thai also
spaces). One stack holds the open quotations and brackets, whose inside is never split, another the open list levels,
by which an enumerated line is told to go on with its level. On the ground level each mark is judged by what stands
before it (tries of abbreviations, walked backwards; initials, numbers) and after it. What a language can't tell
beforehand is learnt from the texts: short words whose dot is followed within the sentence, and lines that return as
lines of their own (headings). The language of a text is never needed: scripts are told by their characters.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Container, Iterator
from functools import reduce
from operator import or_
from typing import NamedTuple

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread, stored

# Brackets and quotation marks. A mark may open one kind and close another.
PAIRS = {"(": ")", "[": "]", "{": "}", "（": "）", "［": "］", "【": "】", "〔": "〕", "「": "」", "『": "』", "《": "》", "〈": "〉", "«": "»", "‹": "›", "“": "”", "„": "“”", "”": "", '"': '"'}
CLOSERS = {c for closing in PAIRS.values() for c in closing}
# Marks that end a sentence wherever they stand, and those that have other uses too.
HARD, SOFT = "。！？｡।॥؟۔", ".!?…"
# Abbreviations that never end a sentence, by language or kind.
NEVER = {
    "titles": "adv bros capt cdr col cpl dir dna doc dr dra dres drs ed eds fr gen gov hon hrsg insp ltd lt maj messrs mgr mlle mlles mm mme mmes mr mrs ms msgr mt mx prof pres rep rev sen sgt sr sra sres srta st ste supt vda",
    "references": "al alin ann anm app appx approx arrt art arts aufl bd bk bldg cap cf cfr ch cl comp cons conf def dept diss ediz eq eqn eqs ex fasc fig figs fn fol ibd inv kap lect lib lit loc n nº no nos nr nrn num obs op par para paras parág pág págs pct pg pkt pl pp pr prop ref refs reg res rdnr rn sec sect sects ss std subsec suppl tab teil th thm tit tr transl univ urt vgl vid viz vol vols vs zb ziff",
    "measures": "abt apt av ave avda blvd cca cpt dept est exp ft gr hr incl int max min mio mrd str tel tsd zzgl inkl exkl bzw ggf evtl sog ca resp",
    "letters": "i.e e.g z.b d.h u.a s.a s.r.l s.c s.p.a i.v.m v.m o.ä u.ä p.ej p.es i.d.r q.v n.b dl dlui p s d m t",
    "rus": "им гл гр г-н г-жа ул обл п пп р рис см ср ст стр с т табл ч акад проф пер изд напр",
    "ara": "د م ص أ ف ق",
    "hin": "डॉ पृ श्री प्रो सं",
    "tha": "พ.ศ ค.ศ ดร นาย",
}
# Abbreviations that end a sentence if one seems to begin after them.
MAY = "a.m p.m etc ș.a.m.d ş.a.m.d ș.a etc usw ff f suiv urm ibid ltd inc co corp cie jr h u.s u.k г гг руб коп тыс млн млрд др пр д е ин".split()
# Words before a number or a letter that belong to it; before a number with a dot they make it an ordinal.
ORDINAL_AFTER = {"am", "der", "die", "das", "dem", "den", "des", "vom", "zum", "zur", "im", "beim", "bis", "seit", "ab", "ein", "eine", "einem", "einer", "jeder", "dieser"}
NAMED_BY_LETTER = {"annex", "annexe", "anexa", "anlage", "anhang", "appendix", "appendice", "article", "articol", "articolul", "artikel", "exhibit", "schedule", "part", "partie", "partea", "teil", "приложение", "статья", "section"}
ANSWERED = {"was", "is", "said", "answered", "be", "replied"}
MINUTES_BEFORE = {"et", "à", "jusqu", "du", "le", "de", "pour", "puis", "ou"}
def _trie(words: list[str]) -> dict:
    root: dict = {}
    for word in words:
        node = root
        for c in reversed(word):
            node = node.setdefault(c, {})
        node[""] = word
    return root


NEVER_TRIE, MAY_TRIE = _trie([w for words in NEVER.values() for w in words.split() if w not in MAY]), _trie(MAY)
#: What is learnt: times that a word stands before a dot, or a line stands alone, at least; share of the former within sentences; entries that are sent to all tasks, the most frequent: all others are joined to the texts that may ask for them.
SEEN, WITHIN, LEARNT = 20, 0.6, 20_000
LINES = 3
#: Letters of a learnt word and line, at most (see learn()); small letters may be twice as many.
WORD_LETTERS, LINE_LETTERS = 5, 120


class Learnt(NamedTuple):
    """Short words whose dot doesn't end a sentence and lines that return as lines of their own, in small letters.

    rest has those that are rarer than the ones held here: (kind `words` or `lines`, item); None if there are none.
    """

    words: Container[str] = frozenset()
    lines: Container[str] = frozenset()
    rest: DataFrame | None = None


class _Either(NamedTuple):
    """Whether one of two sets has an item, without their union."""

    one: Container[str]
    other: Container[str]

    def __contains__(self, item: object) -> bool:
        return item in self.one or item in self.other


MARKS = regex.compile("[" + regex.escape(HARD + SOFT + "".join(PAIRS) + "".join(CLOSERS)) + r"]|\s*\n\s*|(?<=\p{Thai})\s+(?=\p{Thai})", regex.VERSION0)
SPACE = regex.compile(r"\s*")
LINE_ENDS = regex.compile(r"\s*\n\s*")
DATE_PART, MINUTES, NUMBER = regex.compile(r"\d{1,2}\. ?\d{4}"), regex.compile(r"([0-5]\d)\b\W*(\w*)"), regex.compile(r"\d+(/?)")
DOTTED = regex.compile(r"(?:^|[\s(\[])(?:\p{Lu}\.)+\p{Lu}$")
NO_VOWEL = regex.compile(r"[bcdfghjklmnpqrstvwxzßçñ]{2,}")
UNITS = set("mm cm dm km kg mg ml dl cl hl ms hz kw mw gb mb kb".split())
NOTE = regex.compile(r"(?:\[\d{1,3}\]|[¹²³⁴-⁹⁰]+)+|\d{1,3}(?=\s|$)")
ENUMERATED = r"^(?:(?:[A-ZА-Я]|[IVXLC]{1,6}|\d{1,3}(?:\.\d{1,3})*)\.\s|\(?(?:[a-zа-я]|[ivx]{1,5}|\d{1,2})\)\s|[一二三四五六七八九十]{1,3}、)"
ENUMERATOR = regex.compile(r"(?:[A-ZА-Я]|[IVXLC]{1,6}|\d{1,3}(?:\.\d{1,3})*)\.\s|\(?(?:[a-zа-я]|[ivx]{1,5}|\d{1,2})\)\s|[一二三四五六七八九十]{1,3}、")
ROMAN = regex.compile(r"[IVXLC]+$")
NUMERALS = "一二三四五六七八九十"
CJK_PAUSE = regex.compile("[，。；：]")
# Words after which a line goes on.
OPEN_ENDED = regex.compile(r"\b(?:of|the|de|la|le|les|der|die|das|des|a|în|din|to|in|and|et|und|și)$")
CJK = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")
CASELESS = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Arabic}\p{Devanagari}\p{Hebrew}]")


def _thai(c: str) -> bool:
    return "\u0e00" <= c <= "\u0e7f"


def _wordy(c: str) -> bool:
    return c.isalnum() or c > "\u02ff" and unicodedata.category(c)[0] == "M"


def _word_before(text: str, at: int, floor: int) -> tuple[str, int, int]:
    """The last word that ends at or before `at`, with its start and end; empty if there is none after floor."""
    end = at
    while end > floor and not _wordy(text[end - 1]):
        end -= 1
    start = end
    while start > floor and _wordy(text[start - 1]):
        start -= 1
    return text[start:end], start, end


def _found(trie: dict, text: str, end: int, start: int) -> str | None:
    """The longest word of the trie that stands as a word before end."""
    node, at, best = trie, end - 1, None
    while at >= start:
        c = text[at].lower()
        if c.isspace() and node is not trie and "." in node:  # "z. B", "т. е"
            at -= 1
            continue
        node = node.get(c)
        if node is None:
            break
        if "" in node and (at == start or not (text[at - 1].isalnum() or text[at - 1] in "-")):
            best = node[""]
        at -= 1
    return best


def _begins(text: str, at: int) -> bool:
    """Whether what stands at `at` can begin a sentence: no small letter, unless a capital follows in its word."""
    if at >= len(text):
        return True
    c = text[at]
    if c in "*_":
        return _begins(text, at + 1)
    if c.islower():
        end = at + 1
        while end < len(text) and text[end].isalnum():
            if text[end].isupper():
                return True
            end += 1
        return False
    return c not in ",;:-–—)]}»”%&/=" 


def _matches(text: str, marks: list[tuple[int, str]]) -> dict[int, int]:
    """Position of the closing mark of each opening one; marks without a partner in their block of lines are no brackets."""
    pairs: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    held: Counter = Counter()  # closing marks that the stack waits for
    for at, mark in marks:
        if mark.count("\n") > 1:
            stack.clear()
            held.clear()
        if len(mark) != 1 or mark not in CLOSERS and not PAIRS.get(mark):
            continue
        if held[mark] > 0:
            while True:
                opened, begin = stack.pop()
                held.subtract(PAIRS[opened])
                if mark in PAIRS[opened]:
                    break
            pairs[begin] = at
        elif PAIRS.get(mark):
            stack.append((mark, at))
            held.update(PAIRS[mark])
    return pairs


def _dot_ends(text: str, start: int, at: int, learnt: Learnt) -> bool:
    """Whether the full stop at `at` ends the sentence that begins at `start`."""
    after = at + 1
    nxt = SPACE.match(text, after).end()
    attached = nxt == after and after < len(text)
    before = text[at - 1] if at > start else " "
    follow = text[nxt] if nxt < len(text) else ""
    if attached:
        if text[after] in SOFT or text[after] in CLOSERS and not follow.isalnum():
            pass
        if before.isdigit() and follow.isdigit():
            return False
        if follow.islower() and not _begins(text, nxt):
            return False
        if follow.isalnum() and not (follow.isupper() and (before.islower() or before in ")]»”") or CASELESS.match(before + "") and CASELESS.match(follow)):
            # only a word and a capital run together without a space are two sentences: never initials, never numbers
            known = _found(MAY_TRIE, text, at, start)
            roman = _word_before(text, at, max(start, at - 8))[0]
            if not (follow.isupper() and (known or ROMAN.match(roman) and len(roman) > 1 or before.isdigit() and not text[max(start, at - 12):at].rpartition(" ")[2].count("/"))):
                return False
        elif not follow.isalnum() and follow not in PAIRS and follow not in CLOSERS:
            if follow in ",;:/=-–":
                return False
    if not _begins(text, nxt):
        return False
    if before.isspace() or at == start:
        return not attached and not follow.islower()
    if "\u0900" <= before <= "\u097f":
        return not follow or "\n" in text[after:nxt]
    if _thai(before):
        return False
    if at - start < 16 and ENUMERATOR.fullmatch(text[start:at] + ". "):
        return False  # "II." or "12." at the start of a unit
    last, word_start, word_end = _word_before(text, at, max(start, at - 40))
    word = last if word_end == at else ""
    previous = _word_before(text, word_start, max(start, word_start - 40))[0].lower() if last else ""
    if word.lower() == "no" and previous in ANSWERED:
        number = NUMBER.match(text, nxt)
        return not (number and number[1])
    if word.lower() == "no" and not follow.isdigit():
        return True
    if word.isdigit():
        if len(word) <= 2 and previous in ORDINAL_AFTER and follow.isupper():
            return False
        if follow.isdigit() and DATE_PART.match(text, nxt):
            return False
        return True
    may = _found(MAY_TRIE, text, at, start)
    if may == "h":
        if previous == "d":
            return False
        if minutes := MINUTES.match(text, nxt):
            return minutes[2].lower() not in MINUTES_BEFORE and bool(minutes[2])
        return previous.isdigit()
    if may:
        if may in ("д", "е", "пр", "др") and follow.islower():
            return False
        return True
    if len(word) == 1 and word.isalpha() and (word.isupper() or word.islower()):
        return word.isupper() and previous in NAMED_BY_LETTER
    if len(word) == 1 and CASELESS.match(word):
        return False
    if _found(NEVER_TRIE, text, at, start) or word.lower() in learnt.words:
        return False
    if NO_VOWEL.fullmatch(word.lower()) and not word.isupper() and not (word.lower() in UNITS or previous.isdigit()):
        return False  # "Thm.", "ggf."
    return not DOTTED.search(text[max(start, at - 16) : at])  # U.V.O.


def _item(line: str) -> tuple[str, int] | None:
    """The kind of enumerator with which a line begins, and its number in it."""
    found = ENUMERATOR.match(line)
    if not found:
        return None
    mark = found[0].strip().strip("().、")
    closing = ")" if ")" in found[0] else found[0].strip()[-1]
    if mark[0].isdigit():
        return f"1{closing}{mark.count('.')}", int(mark.rpartition(".")[2] or 0)
    if mark[0] in NUMERALS:
        return "一", sum(NUMERALS.index(c) + 1 for c in mark)
    if ROMAN.match(mark.upper()) and (len(mark) > 1 or mark in "Ii"):
        values = ["IVXLC".index(c) for c in mark.upper()]
        numbers = [(1, 5, 10, 50, 100)[v] for v in values]
        return ("I" if mark.isupper() else "i") + closing, sum(-n if n < max(numbers[i:]) else n for i, n in enumerate(numbers))
    return ("A" if mark.isupper() else "a") + closing, ord(mark.lower()[0])


class _Levels:
    """The open list levels: kind, number of the last item, whether it was a heading."""

    def __init__(self) -> None:
        self.stack: list[list] = []

    def enter(self, kind: str, number: int) -> bool:
        """An item of the kind closes the levels within its own, or opens one; whether it goes on after a heading of its level."""
        depth = next((i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i][0] == kind), None)
        if depth is None:
            self.stack.append([kind, number, False])
            return False
        del self.stack[depth + 1 :]
        level = self.stack[depth]
        follows = level[2] and number == level[1] + 1
        level[1], level[2] = number, False
        return follows


def _bare(line: str, item: bool) -> str:
    """A line without its enumerator, if it is an item."""
    return line[ENUMERATOR.match(line).end() :].strip() if item else line


def _line_key(bare: str) -> str:
    """How a line is looked up among the learnt ones."""
    return bare.lower().strip("*_ ").replace("’", "'")


def lookups(text: str) -> tuple[set[str], set[str]]:
    """All words and lines that sentences() may look up among the learnt ones, and perhaps more, but none that can't be learnt."""
    words: set[str] = set()
    at = text.find(".")
    while at >= 0:
        word = _word_before(text, at, max(0, at - 40))
        if word[2] == at:
            # a sentence may begin within a run of letters and digits, after the number of a note
            rest = word[0][1 + max((i for i, c in enumerate(word[0]) if c.isdigit()), default=-1) :]
            words.update(w for w in (word[0].lower(), rest.lower()) if 0 < len(w) <= 2 * WORD_LETTERS)
        at = text.find(".", at + 1)
    lines = {_line_key(_bare(line, bool(_item(line)))) for line in LINE_ENDS.split(text[SPACE.match(text).end() :])}
    return words, {k for k in lines if 0 < len(k) <= 2 * LINE_LETTERS}


def _heading(text: str, start: int, end: int, follow: int, levels: _Levels, learnt: Learnt) -> bool:
    """Whether text[start:end], all of one line and followed by another, is a heading.

    It is if the line returns among the texts, if it is enumerated and reads like no sentence, or if it goes on with a
    level whose last item was a heading.
    """
    line = text[start:end]
    if follow >= len(text) or not line or not _begins(text, follow):
        return False
    item = _item(line)
    follows = bool(item) and levels.enter(*item)
    bare = _bare(line, bool(item))
    known = _line_key(bare) in learnt.lines
    words = bare.split()
    read = bool(item) and len(words) >= 2 and "," not in bare and not OPEN_ENDED.search(bare)
    if CJK.match(line) and CJK.match(line[-1]):
        read = bool(item) and not CJK_PAUSE.search(line)
    is_heading = known or read or follows and not OPEN_ENDED.search(bare)
    if item and is_heading:
        levels.stack[-1][2] = True
    return is_heading


def sentences(text: str | None, learnt: Learnt = Learnt()) -> list[tuple[int, int]]:
    """Start and end (exclusive), in code points, of each unit of the text, in order; none for null and blank texts.

    The units and the white space between them are the whole text. What was learnt from other texts may help.
    """
    if not text or not text.strip():
        return []
    marks = [(m.start(), m.group()) for m in MARKS.finditer(text)]
    pairs = _matches(text, marks)
    levels = _Levels()
    out: list[tuple[int, int]] = []
    start = SPACE.match(text).end()
    n = len(text)

    def close(end: int) -> int:
        """A unit ends at `end`; gives the start of the next."""
        stop = end
        while stop > start and text[stop - 1].isspace():
            stop -= 1
        if stop > start:
            out.append((start, stop))
        return SPACE.match(text, end).end()

    def tail(at: int) -> int:
        """Past further terminators, stray closing marks and a note number."""
        while at < n and (text[at] in HARD or text[at] in SOFT or text[at] in CLOSERS and text[at] not in PAIRS):
            at += 1
        note = NOTE.match(text, at)
        if note and not (text[at].isdigit() and at >= 2 and text[at - 2].isdigit()):
            at = note.end()
        return at

    skip = start
    line = 0  # where the last line break before began
    for at, mark in marks:
        if "\n" in mark:
            broken, line = line, at
        if at < skip:
            continue
        if at in pairs:
            end = pairs[at] + 1
            skip = end
            inside = pairs[at] - 1
            while inside > at and text[inside].isspace():
                inside -= 1
            if text[inside] in HARD or text[inside] in SOFT:
                nxt = SPACE.match(text, end).end()
                alone = at == start
                line_end = nxt >= n or "\n" in text[end:nxt]
                if nxt < n and (text[nxt] in HARD or text[nxt] in SOFT):
                    continue
                quoted = mark in "“„«\"「『"
                cased = nxt < n and (text[nxt].isupper() or text[nxt].islower() or text[nxt].isdigit() or text[nxt] in PAIRS) and _begins(text, nxt)
                if alone and (nxt >= n or _begins(text, nxt)) or quoted and text[inside] not in "…" and text[inside - 2 : inside + 1] != "..." and (cased and not CASELESS.match(text[at + 1 :].lstrip()[:1] or " ") or line_end and _begins(text, nxt)):
                    start = skip = close(tail(end))
            continue
        if mark[0] in HARD:
            start = skip = close(tail(at + 1))
        elif mark in "!?…" or mark == ".":
            if mark == ".":
                if at + 1 < n and text[at + 1] in SOFT:
                    continue
                note = NOTE.match(text, at + 1)
                if note and not (at and text[at - 1].isdigit()) and _begins(text, SPACE.match(text, note.end()).end()) and (text[at + 1] in "[¹²³" or len(text[max(start, at - 120) : at].split()) > 3 and not _found(NEVER_TRIE, text, at, start) and text[at - 1].islower()):
                    start = skip = close(note.end())
                    continue
                if text[max(0, at - 2) : at] == "..":
                    if _begins(text, SPACE.match(text, at + 1).end()) and at > start + 3:
                        start = skip = close(tail(at + 1))
                    continue
                ends = _dot_ends(text, start, at, learnt)
            else:
                nxt = SPACE.match(text, at + 1).end()
                ends = nxt >= n or (_begins(text, nxt) or text[nxt] in "»”)") and (nxt > at + 1 or text[nxt].isupper() or CASELESS.match(text[nxt]) or text[nxt] in PAIRS or text[nxt] in SOFT or text[nxt] in CLOSERS or text[nxt] == "[")
            if ends:
                start = skip = close(tail(at + 1))
        elif "\n" in mark or mark.isspace():
            if at + len(mark) <= start or at < start:
                continue
            end = at + len(mark)
            if mark.count("\n") > 1:
                start = skip = close(end)
            elif _thai(text[at - 1]) and end < n and _thai(text[end]):
                if text[at - 1] not in "ๆฯ" and text[end] not in "ๆฯ":
                    start = skip = close(end)
            elif "\n" in mark and broken < start + (start == 0) and (not out or "\n" in text[out[-1][1] : start]) and _heading(text, start, at, end, levels, learnt):
                start = skip = close(end)
    close(n)
    return out


def learn(texts: DataFrame, text_col: str) -> Learnt:
    """Short words and lines that are learnt from all texts: the LEARNT most frequent of each come to the driver, all others stay in a table (rest).

    A word of two to five letters is learnt if it stands before a dot SEEN times and WITHIN of these are followed by a
    small letter, a digit or a comma; a line, without its enumerator, if LINES different texts have it as a line of its
    own, before a line that may begin a sentence, and it ends in no mark.
    """
    t = texts.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("t"))
    dotted = t.select(F.explode(F.regexp_extract_all("t", F.lit(r"(?U)(?<![\p{L}\p{M}.])(\p{L}{2,5}\.(?:\s*[\p{Ll}\p{N},])?)"), 1)).alias("x"))
    words = dotted.groupBy(F.lower(F.substring_index("x", ".", 1)).alias("w")).agg(F.count("*").alias("n"), F.count_if(~F.col("x").endswith(".")).alias("within")).where((F.col("n") >= SEEN) & (F.col("within") >= WITHIN * F.col("n")))
    # a line and the character after its break; what follows is only looked at, so that neighbouring lines count too
    lines = t.select(F.xxhash64("t").alias("h"), F.explode(F.regexp_extract_all("t", F.lit(r"(?U)(?:^|\n)[ \t]*([^\n]{2,120})(?=\s*\n\s*[^\s\p{Ll},;])"), 1)).alias("x"))
    bare = F.regexp_replace(F.lower(F.trim(F.regexp_replace("x", ENUMERATED, ""))), r"^[*_ ]+|[*_ ]+$", "")
    lines = lines.select("h", F.replace(bare, F.lit("’"), F.lit("'")).alias("l")).where(~F.col("l").rlike(r"[.!?;:,。！？、，।؟]\s?[”“\"»'」』)]*$") & (F.col("l") != ""))
    often = lines.distinct().groupBy("l").agg(F.count("*").alias("n")).where(F.col("n") >= LINES)
    words = words.where(~F.col("w").isin(MAY))
    found = stored(words.select(F.lit("words").alias("kind"), F.col("w").alias("item"), "n").unionByName(often.select(F.lit("lines").alias("kind"), F.col("l").alias("item"), "n")))
    held, rarer = {}, []
    for kind in ("words", "lines"):
        first = found.where(F.col("kind") == kind).orderBy(F.desc("n"), "item").limit(LEARNT + 1).collect()
        held[kind] = frozenset(r["item"] for r in first[:LEARNT])
        if len(first) > LEARNT:
            n, item = first[LEARNT]["n"], first[LEARNT]["item"]
            rarer.append((F.col("kind") == kind) & ((F.col("n") < n) | (F.col("n") == n) & (F.col("item") >= item)))
    return Learnt(**held, rest=found.where(reduce(or_, rarer)).select("kind", "item") if rarer else None)


def _with_rest(rows: DataFrame, rest: DataFrame) -> DataFrame:
    """rows, stored, with the words and lines of rest that each text may look up.

    Texts are told by a hash: where two share one, each also gets what the other asks for and is learnt, which changes nothing.
    """
    rows = stored(rows.withColumn("h", F.xxhash64("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, kinds, items = [], [], []
            for h, text in zip(batch.column("h").to_pylist(), batch.column("text").to_pylist()):
                for kind, found in zip(("words", "lines"), lookups(text or "")):
                    hashes += [h] * len(found)
                    kinds += [kind] * len(found)
                    items += found
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), pa.array(kinds, pa.string()), pa.array(items, pa.string())], names=["h", "kind", "item"])

    asked = spread(rows.select("h", "text")).mapInArrow(run, "h long, kind string, item string").join(rest, ["kind", "item"], "left_semi")
    return rows.join(asked.groupBy("h").agg(*(F.collect_set(F.when(F.col("kind") == k, F.col("item"))).alias(k) for k in ("words", "lines"))), "h", "left").drop("h")


def split_sentences(texts: DataFrame, keys: list[str], text_col: str, learnt: Learnt | None = None) -> DataFrame:
    """One row (keys, start_pos int, end_pos int) for each unit of each row's text; see sentences().

    Null and blank texts give no rows; repeated rows give repeated units. Whole texts; learnt from themselves, unless
    what was learnt is given. Other columns don't take part. Where more is learnt than is sent to all tasks, the rows are
    stored and joined by a hash to what else is learnt of what they may look up.
    """
    learnt = learn(texts, text_col) if learnt is None else learnt
    rows = spread(texts.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(text_col).alias("text")), scanned=False)
    ks = [f"k{i}" for i in range(len(keys))]
    schema = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in ks) + ", start_pos int, end_pos int"
    held = learnt._replace(rest=None)
    if learnt.rest is not None:
        rows = _with_rest(rows, learnt.rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, starts, ends = [], [], []
            more = [batch.column(k).to_pylist() for k in ("words", "lines") if k in batch.schema.names]
            for i, text in enumerate(batch.column("text").to_pylist()):
                known = Learnt(*(_Either(x, m[i]) if m[i] else x for x, m in zip(held, more))) if more else held
                for s, e in sentences(text, known):
                    index.append(i)
                    starts.append(s)
                    ends.append(e)
            at = pa.array(index, pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in ks), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=[*ks, "start_pos", "end_pos"])

    return rows.mapInArrow(run, schema).select(*[F.col(k).alias(name) for k, name in zip(ks, keys)], "start_pos", "end_pos")


def task_sentences(tasks: DataFrame) -> DataFrame:
    """Distinct (guide_id, paragraph_id, start_pos, end_pos) of extraction_tasks (guide_id, paragraph_id, paragraph_text, attempt).

    Of several attempts at a paragraph the text of the highest with a text that is not blank counts; ties go to the
    greater text. Rows with a null key give no rows.
    """
    told = tasks.where("guide_id IS NOT NULL AND paragraph_id IS NOT NULL AND paragraph_text RLIKE '[^\\\\s]'")
    once = told.groupBy("guide_id", "paragraph_id").agg(F.max(F.struct(F.coalesce("attempt", F.lit(-1)).alias("attempt"), F.col("paragraph_text").alias("text"))).alias("m"))
    return split_sentences(once.select("guide_id", "paragraph_id", "m.text"), ["guide_id", "paragraph_id"], "text", learn(tasks, "paragraph_text"))
