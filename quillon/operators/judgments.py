"""HTML judgments to numbered paragraphs: headlines are told by style, paragraphs by their numbers."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

# Style properties that tell a headline; size in pt of normal text; share of paragraphs that larger type may remove; letters of a headline.
PROPERTIES = ("font-weight", "font-size", "text-transform", "font-variant", "font-variant-caps", "font")
NORMAL_PT, MOST_SHARE, LETTERS = 12.0, 0.30, 5
# Classes and style names of headings; how a paragraph's number is marked, best first (n the number, last its last digit).
HEADING_CLASS = re.compile(r"(?i)\b(?:(?:mso)?heading\d+|(?:mso)?(?:sub)?title)\b")
HEADING_STYLE = re.compile(r"(?i)mso-style-name\s*:\s*['\"]?\s*(?:heading\s*\d+|(?:sub)?title)\b")
MARKS = (r"\n{n}\s?\.", r"(?<![\d/]){n}\s?\.", r"(?<![\d/.]){n}(?![/.])", r"\n{n}{last}\.")
VOID = {"br", "img", "hr", "meta", "link", "input", "col", "area", "base", "wbr"}
CLOSES_P = {"p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "table", "section"}


class Node:
    __slots__ = ("tag", "attrs", "parent", "children", "style")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []
        self.style: dict[str, str] = {}


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)
        self.css: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in CLOSES_P:
            node = self.at
            while node.parent and node.tag not in ("div", "td", "body", "section"):
                if node.tag == "p":
                    self.at = node.parent
                    break
                node = node.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node.parent and node.tag != tag:
            node = node.parent
        if node.parent:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        (self.css if self.at.tag == "style" else self.at.children).append(data)


def style_of(text: str) -> dict[str, str]:
    """Declarations of a style; the weight and size in a `font` shorthand count where they aren't set themselves."""
    out: dict[str, str] = {}
    for part in text.split(";"):
        name, mark, value = part.partition(":")
        if mark and value.strip():
            out[name.strip().lower()] = value.strip().lower()
    for word in re.split(r"[\s/]+", out.get("font", "")):
        if word in ("bold", "bolder", "lighter") or re.fullmatch("[1-9]00", word):
            out.setdefault("font-weight", word)
        elif word.endswith(("pt", "px")):
            out.setdefault("font-size", word)
    return out


def points(value: str | None) -> float | None:
    """The first size in pt or px of a value, in pt; None if there is none."""
    m = re.search(r"(\d*\.?\d+)\s*(pt|px)", value or "")
    return float(m[1]) * (0.75 if m[2] == "px" else 1) if m else None


def is_bold(style: dict[str, str]) -> bool:
    weight = style.get("font-weight", "")
    return weight == "bold" or bool(re.fullmatch("[6-9]00", weight))


def is_upper(style: dict[str, str]) -> bool:
    return style.get("text-transform") == "uppercase" or "small-caps" in style.get("font-variant", "") or "small-caps" in style.get("font-variant-caps", "")


def size_of(style: dict[str, str]) -> float | None:
    size = points(style.get("font-size"))
    return points(style.get("font")) if size is None else size


def letters(text: str) -> int:
    return sum(c.isalpha() for c in text)


class Judgment:
    def __init__(self, html: str) -> None:
        builder = _Builder()
        builder.feed(html)
        builder.close()
        self.root = builder.root
        css = re.sub(r"(?s)/\*.*?\*/", "", "".join(builder.css))
        self.classes: dict[str, dict[str, str]] = {}
        for selectors, body in re.findall(r"([^{}]+)\{([^}]*)\}", css):
            kept = {k: v for k, v in style_of(body).items() if k in PROPERTIES}
            for name in re.findall(r"\.([A-Za-z_][\w-]*)", selectors):
                self.classes.setdefault(name, {}).update(kept)
        self._styles: dict[int, dict[str, str]] = {}

    def walk(self, node: Node | None = None) -> Iterator[Node]:
        stack = [node or self.root]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(c for c in reversed(n.children) if isinstance(c, Node))

    def runs(self, node: Node) -> Iterator[tuple[str, Node]]:
        """Texts below the node with the element that holds each, in order."""
        stack: list[tuple[Node | str, Node]] = [(node, node)]
        while stack:
            n, holder = stack.pop()
            if isinstance(n, str):
                yield n, holder
            elif n.tag not in ("style", "script"):
                stack.extend((c, n) for c in reversed(n.children))

    def style(self, node: Node) -> dict[str, str]:
        """The properties in effect: those of the nearest element that sets them, up to and with the body."""
        if (known := self._styles.get(id(node))) is not None:
            return known
        own = {"font-weight": "bold"} if node.tag in ("b", "strong") else {}
        own = {**style_of(node.attrs.get("style", "")), **own}
        for name in node.attrs.get("class", "").split():
            own = {**self.classes.get(name, {}), **own}
        if node.parent and node.tag not in ("body", "html"):
            own = {**self.style(node.parent), **own}
        self._styles[id(node)] = own
        return own

    def heading(self, node: Node) -> bool:
        if re.fullmatch("h[1-6]", node.tag) or node.attrs.get("role", "").lower() == "heading":
            return True
        return bool(HEADING_CLASS.search(node.attrs.get("class", "")) or HEADING_STYLE.search(node.attrs.get("style", "")))

    def why(self, p: Node) -> str | None:
        """Why a paragraph is a headline: `caps`, `bold` (both only in type that isn't small) or `size`."""
        told = [(text, self.style(holder)) for text, holder in self.runs(p) if text.strip()]
        if not told:
            return None
        sizes = [size_of(style) for _, style in told]
        lettered = [(text, style, size) for (text, style), size in zip(told, sizes) if letters(text)]
        if sum(letters(text) for text, _, _ in lettered) >= LETTERS and all(size is None or size >= NORMAL_PT for _, _, size in lettered):
            if all(is_upper(style) or not any(c.isalpha() and c.islower() for c in text) for text, style, _ in lettered):
                return "caps"
            if is_bold(self.style(p)) or all(is_bold(style) for _, style, _ in lettered):
                return "bold"
        return "size" if all(size is not None and size > NORMAL_PT for size in sizes) else None

    def strip_headlines(self) -> dict[str, int]:
        """Removes headlines; the report counts them by kind."""
        report = {"headings": 0, "caps": 0, "bold": 0, "size": 0, "paragraphs": 0}
        stack = [self.root]
        while stack:  # what stands in a heading goes with it and isn't counted
            node = stack.pop()
            inner = [c for c in node.children if isinstance(c, Node)]
            headings = [c for c in inner if self.heading(c)]
            report["headings"] += len(headings)
            node.children = [c for c in node.children if c not in headings] if headings else node.children
            stack.extend(c for c in inner if c not in headings)
        for p in [n for n in self.walk() if n.tag == "p"]:
            report["paragraphs"] += 1
            if kind := self.why(p):
                report[kind] += 1
                p.parent.children.remove(p)
        return report

    def text(self) -> str:
        """All texts, each on lines of its own."""
        return "\n".join(t for t, _ in self.runs(self.root))


def how_many(text: str) -> int:
    """The greatest n for which each number up to it begins a line, also as the beginning of a longer number."""
    found = {run[:k] for run in re.findall(r"\n(\d+)", text) for k in range(1, min(len(run), 9) + 1)}
    n = 0
    while str(n + 1) in found:
        n += 1
    return n


def _marked(text: str, number: int) -> re.Match | None:
    for form in MARKS:
        if found := re.compile(form.format(n=number, last=number % 10)).search(text):
            return found
    return None


def numbered_paragraphs(text: str) -> dict[int, str]:
    """Paragraphs by number, as `n. text`: from the mark of each number to that of the next; numbers without a mark or text are left out.

    After a paragraph whose next number isn't marked behind it, the rest of the text is that paragraph's.
    """
    n = how_many(text)
    out: dict[int, str] = {}
    for i in range(1, n + 1):
        if not text or not (here := _marked(text, i)):
            continue
        after = _marked(text, i + 1) if i < n else None
        end = after.start() if after and after.start() >= here.end() else len(text)
        if body := " ".join(text[here.end() : end].split()):
            out[i] = f"{i}. {body}"
        text = text[end:]
    return out


def paragraphs_of(html: str) -> tuple[list[tuple[int, str]], dict[str, int], bool]:
    """Numbered paragraphs in order, the report on headlines, and whether those were left in because larger type seemed to be normal."""
    doc = Judgment(html)
    whole = doc.text()
    report = doc.strip_headlines()
    doubtful = report["size"] > MOST_SHARE * max(1, report["paragraphs"])
    return sorted(numbered_paragraphs(whole if doubtful else doc.text()).items()), report, doubtful


def docname_of(html: str | None) -> str | None:
    """The text of a page's first paragraph of class docname; None if it has none."""
    doc = Judgment(html or "")
    for node in doc.walk():
        if node.tag == "p" and "docname" in node.attrs.get("class", "").split():
            return " ".join(t.strip() for t, _ in doc.runs(node) if t.strip())
    return None


def html_paragraphs(pages: DataFrame, id_col: str = "_id", html_col: str = "html", scanned: bool = True) -> DataFrame:
    """(id, paragraph_number, paragraph_text) of each page; null, empty and number-less pages give no rows."""
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, n, t) for i, h in enumerate(batch.column("html").to_pylist()) if h for n, t in paragraphs_of(h)[0]]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array([r[0] for r in rows], pa.int32())), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string())], names=["id", "paragraph_number", "paragraph_text"])

    rows = spread(pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")), scanned)
    return rows.mapInArrow(run, f"id {kind}, paragraph_number int, paragraph_text string").withColumnRenamed("id", id_col)


def headline_report(pages: DataFrame, id_col: str = "_id", html_col: str = "html", scanned: bool = True) -> DataFrame:
    """(id, headings, caps, bold, size, paragraphs, doubtful) for each page that isn't null or empty."""
    kind = pages.schema[id_col].dataType.simpleString()
    names = ["headings", "caps", "bold", "size", "paragraphs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [(i, *paragraphs_of(h)[1:]) for i, h in enumerate(batch.column("html").to_pylist()) if h]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array([d[0] for d in done], pa.int32())), *(pa.array([d[1][n] for d in done], pa.int32()) for n in names), pa.array([d[2] for d in done], pa.bool_())], names=["id", *names, "doubtful"])

    rows = spread(pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")), scanned)
    return rows.mapInArrow(run, f"id {kind}, " + ", ".join(f"{n} int" for n in names) + ", doubtful boolean").withColumnRenamed("id", id_col)
