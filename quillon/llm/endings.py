"""How likely a text ends where a sentence ends, learnt from the corpus itself.

Inside texts every token is either followed by the end of a sentence or of a line, or not. A model of these followings,
by the last tokens before them (words; single characters in scripts without spaces), tells an ending that needs no full
stop from one that breaks off.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable

import regex

TOKEN = regex.compile(r"(?<=\p{Thai})\s+(?=\p{Thai})|[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]|[\p{L}\p{M}]+(?:['’\-][\p{L}\p{M}]+)*['’]?|\d+|\n\s*|[^\s\p{L}\p{M}\d]")
LINE, THAI = regex.compile(r"(\n\s*)"), regex.compile(r"\p{Thai}")
SINGLE = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]")
# Marks that end a sentence.
FINAL = set(".!?…。！？｡।॥؟۔")
CLOSING = set(")]}»”“\"'’」』）】›*_")
#: Occurrences of a token from which it stands for itself, of a context from which it counts, tokens in a context.
KNOWN, SEEN, LONGEST = 8, 4, 5
#: Characters looked at first, from the end; more where they don't do.
WINDOW = 240
#: Characters of a chunk whose tokens are remembered, at most; such chunks.
CHUNK, CHUNKS = 24, 200_000
_chunks: dict[str, list[str]] = {}
#: Share of all tokens from which a word in capitals stands for itself; rarer ones are names.
NAMED = 0.0003


def tokens(text: str) -> list[str]:
    """The tokens of a text. What stands between white space is split by TOKEN once and then remembered; Thai, where white space counts, isn't."""
    if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:  # white space for split() only
        return TOKEN.findall(text)
    out: list[str] = []
    for line in LINE.split(text) if "\n" in text else (text,):
        if line[:1] == "\n":
            out.append(line)
            continue
        for chunk in line.split():
            found = _chunks.get(chunk)
            if found is None:
                if THAI.search(chunk):
                    return TOKEN.findall(text)
                found = TOKEN.findall(chunk)
                if len(chunk) <= CHUNK:
                    if len(_chunks) >= CHUNKS:
                        _chunks.clear()
                    _chunks[chunk] = found
            out += found
    return out


def last_tokens(text: str) -> list[str]:
    """The last LONGEST tokens."""
    start = max(0, len(text) - WINDOW)
    ts = tokens(text[start:])
    if start and len(ts) <= LONGEST:  # the first may have been cut
        ts = tokens(text)
    return ts[-LONGEST:]


def named(total: int) -> int:
    """Times that a word in capitals must stand among so many tokens to stand for itself."""
    return max(KNOWN, int(NAMED * total))


class Endings:
    def __init__(self) -> None:
        self.words: Counter = Counter()
        self.all: Counter = Counter()
        self.end: Counter = Counter()
        self.pause: Counter = Counter()
        self.common = KNOWN
        self.last: Counter = Counter()
        self.again: Counter = Counter()
        self.sorted: list[str] = []

    def shape(self, token: str, known: bool | None = None) -> str:
        """What a token stands for in contexts; known tells whether it is frequent enough to stand for itself, if that isn't to be looked up."""
        if token[0].isspace():
            return "\n"
        if token[0].isdigit():
            return "0"
        if len(token) == 1 and not SINGLE.match(token):
            return token if not token.isupper() else "A"
        if known is None:
            known = self.words.get(token, 0) >= (self.common if token[0].isupper() else KNOWN)
        if known:
            return token
        return "Xx" if token[0].isupper() else "xx"

    @classmethod
    def fit(cls, texts: Iterable[str], doubtful: Iterable[str] = ()) -> Endings:
        """Texts of which some may break off, counted on the driver: corpus.py counts whole tables, with the same result.

        Texts that end in the same tokens count once as an end, and their last word once as a word of its own: however
        often a text that breaks off is copied, it doesn't teach its own ending. Doubtful texts' ends teach nothing.
        """
        self = cls()
        split, ended = [], []
        endings: set[tuple[str, ...]] = set()
        for text, sure in [*((t, True) for t in texts), *((t, False) for t in doubtful)]:
            ts = tokens(core(text))
            ending = tuple(ts[-LONGEST:])
            new = bool(ts) and ending not in endings
            endings.add(ending)
            self.words.update(ts)
            if ts:
                self.last[ts[-1]] += 1
                self.again[ts[-1]] += not new
            split.append(ts)
            ended.append(new and sure)
        self.common = named(sum(self.words.values()))
        self.sorted = sorted(w for w, n in self.words.items() if n >= KNOWN)
        for ts, counts in zip(split, ended):
            shapes = [self.shape(t) for t in ts]
            n = len(shapes)
            for i, s in enumerate(shapes if counts else shapes[:-1]):
                if s == "\n" or s in FINAL:
                    continue
                after = shapes[i + 1] if i + 1 < n else "\n"
                if after in FINAL and after == "." and i + 2 < n and (shapes[i + 2] != "\n" and (ts[i + 2][0].islower() or ts[i + 2][0] in ",;:" or s == "A" or s != "0" and len(ts[i]) <= 3 and not SINGLE.match(s) or s == "0" and ts[i + 2][0].isdigit())):
                    ends = False
                else:
                    ends = after in FINAL or after == "\n"
                    if after == "\n" and not SINGLE.match(s) and "\n\n" not in (ts[i + 1] if i + 1 < n else "\n\n") and i + 2 < n:
                        continue  # a single line break tells nothing
                context = ""
                for k in range(min(LONGEST, i + 1)):
                    context = shapes[i - k] + " " + context
                    self.all[context] += 1
                    if ends:
                        self.end[context] += 1
                    elif after in ",;":
                        self.pause[context] += 1
                    if shapes[i - k] == "\n":
                        break
        self.all = Counter({c: n for c, n in self.all.items() if n >= SEEN})
        self.end = Counter({c: n for c, n in self.end.items() if c in self.all})
        self.pause = Counter({c: n for c, n in self.pause.items() if c in self.all})
        return self

    def chance(self, ts: list[str], least: int = SEEN) -> float:
        """The share of endings in such tokens that are ends, by the longest context that was seen often enough.

        Where a sentence may end but a clause follows as often, pauses count too. A last word that is rare ends nothing.
        """
        if not ts:
            return 1.0
        if self.rare(ts[-1]):
            return 0.0
        shapes = [self.shape(t) for t in ts]
        context, found = "", 0.5
        for k in range(len(shapes)):
            context = shapes[len(shapes) - 1 - k] + " " + context
            n = self.all.get(context, 0)
            if n < least:
                break
            found = (self.end.get(context, 0) + 0.02) / (n + 0.04)
            if 0.15 <= found:
                found = max(found, 0.9 * (self.end.get(context, 0) + self.pause.get(context, 0)) / n)
        return found

    def rare(self, token: str) -> bool:
        """Whether the token is, as a rule, the beginning of a word: a rare one in small letters, or one that hardly stands elsewhere than last and begins a more frequent one."""
        if SINGLE.match(token) or not token[0].isalpha():
            return False
        n = self.words.get(token, 0)
        if n < 3:
            return token[0].islower() or (n == self.last.get(token, 0) or not token[0].isupper()) and self._begins(token, 3)
        return self.last.get(token, 0) >= 0.6 * n and self._begins(token, 3 * (n - self.again.get(token, 0)))

    def _begins(self, token: str, least: int) -> bool:
        i = bisect_right(self.sorted, token)
        while i < len(self.sorted) and self.sorted[i].startswith(token):
            if self.words[self.sorted[i]] >= least:
                return True
            i += 1
        return False

    @staticmethod
    def unclosed(text: str) -> bool:
        """Whether the last block opens a bracket, a quotation or a tag that it doesn't close."""
        stack: list[str] = []
        for c in BRACKETS.findall(text, max(text.rfind("\n\n"), 0)):
            if c in CLOSES:
                if stack and stack[-1] in CLOSES[c]:
                    stack.pop()
                elif c == "“":
                    stack.append(c)
            elif c in OPENS:
                stack.append(c)
        return bool(stack)

    def complete(self, text: str) -> float:
        """How surely the text, what was put after it left away, ends with a sentence, a list or the like: 0 to 1."""
        found = self.question(core(text))
        return self.answer(*found) if isinstance(found, tuple) else found

    def answer(self, ts: list[str], scale: float, tail: str | None) -> float:
        """What question() left open: a line that is whole if its last word, the tail, is; else the chance of the last tokens, scaled."""
        if tail is not None and not self.rare(tail):
            return 0.9
        return min(1.0, scale * self.chance(ts))

    @staticmethod
    def question(text: str) -> float | tuple[list[str], float, str | None]:
        """complete() of what core() left of a text where that needs nothing learnt, else what answer() must be asked."""
        if footer := FOOTER.search(text, max(0, len(text) - WINDOW)):
            text = core(text[: footer.start()]) or text
        if not text:
            return 1.0
        if Endings.unclosed(text):
            return 0.0
        bare = text.rstrip("".join(CLOSING))
        if not bare:
            return 1.0
        if bare[-1] in FINAL:
            if bare[-1] != ".":
                return 1.0
            stem = bare[:-1]
            if stem[-1:].isdigit():
                return last_tokens(stem), 4.0, None
            end = stem[-WINDOW:]
            word = LAST_WORD.search(end)[0].lower()
            if not stem[: len(stem) - len(word)].strip() and word.isalpha():
                return 1.0  # a single word: "No."
            if word in ABBREVIATIONS or LAST_LETTER.search(" " + end if len(end) == len(stem) else end):
                return 1.0 if word == "no" and ANSWERED_NO.search(end) else 0.0
            return 1.0
        if bare[-1] in ",;:-–(" or bare[-1] in "/=&<":
            return 0.0
        if LAST_WORD.search(bare[-WINDOW:])[0].lower().strip(".-") in DANGLING:
            return 0.0
        line = bare[bare.rfind("\n") + 1 :]
        tail_ = last_tokens(line)[-1:]
        if "\n\n" in bare and DATED.fullmatch(line):
            return 0.9
        labelled = "\n" in bare and tail_ and (LABELLED.fullmatch(line) or SIGNED.search(bare))
        ts = last_tokens(text)
        return (ts, 1.0, tail_[0] if labelled else None) if ts else 1.0


# A line of keywords or references; a signature; a closing line of place and date.
LABELLED = regex.compile(r"\s*(?:[\p{L}\p{M}\-]+ ?){1,3}[:：] ?[^\s«„“][^!?。।]{1,110}")
SIGNED = regex.compile(r"\n\n(?:\p{Lu}\. ?){1,3}\p{Lu}[\p{L}\-]+\n\p{Lu}[\p{L}\- ]{3,40}$")
DATED = regex.compile(r"[^\n,]{4,40},\s*(?:le\s|la\s|den\s)?\d{1,2}(?:\.\s?\d{1,2}\.\s?|\.?\s\p{L}+\s)\d{4}")
# Words that can't be the last of a sentence.
DANGLING = set("the a an of to and or that which by with for from because as at into le la les de des du et que qui dans pour à au aux par sur un une car și din cu pe pentru că care la der die das und dass mit von zu den dem des ein eine für и в на с что к по".split())
# Abbreviations after which a text can't end.
ABBREVIATIONS = set("no nos nr nº art arts v vs c p pp para paras pct vol t bd s abs lit alin cf vgl sec al mr mrs ms dr mm mme st dl dna dlui bldg i.v.m п ст т г-н им डॉ पृ i.e e.g d.h z.b".split())
OPENS = "([{<“„«「（【\x22"[:-1]
CLOSES = {")": "(", "]": "[", "}": "{", ">": "<", "”": "“„", "“": "„", "»": "«", "」": "「", "）": "（", "】": "【"}
LAST_WORD, LAST_LETTER, ANSWERED_NO = regex.compile(r"(?r)[\p{L}.\-']*$"), regex.compile(r"[\s(]\p{L}$"), regex.compile(r"\b(?:was|is|be) no$")
BRACKETS = regex.compile("<(?=[A-Za-z/!])|[" + regex.escape("".join(sorted({*OPENS, *CLOSES} - {"<"}))) + "]", regex.VERSION0)
# What is put after a cut, and notes after a sentence.
PUT_AFTER = regex.compile(r"(?:\s|</?\w*[^<>]*>|</?\w{0,10}$|&hellip;|…|\.{3,}|\[(?:\.{2,}|…)\]|\((?:\.{3}|…|(?i:more|continued|truncated|suite|cut|tronqué|continuare)[^()]{0,12})\)|\[(?i:more|continued|truncated|suite|cut|tronqué)[^\[\]]{0,20}\]|(?i:read more|lire la suite|citește mai mult)\W*|[\u200b-\u200f\ufeff\u0000-\u001f\ufffd])+$")
# The last letters of the words in it, before a full stop.
MORE = {"more", "uite", "mult"}
# Lines that close an extract.
FOOTER = regex.compile(r"\n\s*\n\s*(?:[（(\[【][^\n（）()\[\]]{1,60}[）)\]】]|[—–-]{1,3}[^\n]{1,60}[—–-]{1,3}|(?:\*\s*){1,5}|以上)\s*$")
NOTES = regex.compile(r"(?<=[.!?。！？»”])(?:\[\d+\]|[¹²³⁴-⁹])+$")


def core(text: str) -> str:
    """The text without what is put after a cut or a sentence."""
    end = text[-5:-1]
    if text[-1:] == "." and end.isascii() and end[-1:].isalnum() and end.lower() not in MORE:
        return text  # as most do: neither pattern can match
    before = None
    while before != text:
        before, text = text, _without(NOTES, _without(PUT_AFTER, text))
    return text


def _without(pattern: regex.Pattern, text: str) -> str:
    """The text without the end that matches, looked for from the end."""
    window = WINDOW
    while True:
        start = max(0, len(text) - window)
        found = pattern.search(text, start)
        if not found:
            return text
        if found.start() > start or not start:
            return text[: found.start()]
        window *= 4
