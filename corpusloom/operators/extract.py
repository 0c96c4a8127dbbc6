"""Prose sections of HTML pages, from a tree built with the standard library's tolerant parser.

An element is open until its end tag or the end of an element around it; an end tag without an open element is ignored.
Navigation, headers, footers, feedback, warnings, scripts, styles and code are removed; the content root is the first
of the usual containers. Headings h1-h3 start a section, p, li and td add a line each - nested ones add their text again.
Sections under ``section_words`` words and pages under ``page_words`` words in what is left are dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as t

#: Elements that never hold prose, by tag, class and id.
DROP_TAGS = {"nav", "header", "footer", "script", "style", "pre", "code"}
DROP_CLASSES = {"breadcrumb", "feedback", "page-feedback", "warning"}
DROP_IDS = {"feedback", "left-column"}
DROP_TEST_IDS = {"feedback"}
#: Where the content is, the first that occurs counts.
ROOTS: tuple[tuple[str, str], ...] = (("tag", "main"), ("id", "main-content"), ("id", "main"), ("class", "main-content"), ("tag", "article"), ("tag", "body"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr basefont bgsound command frame image isindex keygen nextid spacer".split())
SECTION_WORDS, PAGE_WORDS = 20, 100


class Element:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]) -> None:
        self.tag, self.attrs, self.children = tag, attrs, []

    def has_class(self, names: set[str]) -> bool:
        return not names.isdisjoint(self.attrs.get("class", "").split())

    def walk(self) -> Iterator["Element"]:
        """Descendants in document order; a page nested a million deep is fine."""
        todo = [iter(self.children)]
        while todo:
            for c in todo[-1]:
                if isinstance(c, Element):
                    yield c
                    todo.append(iter(c.children))
                    break
            else:
                todo.pop()

    def strings(self) -> Iterator[str]:
        todo = [iter(self.children)]
        while todo:
            for c in todo[-1]:
                if isinstance(c, Element):
                    todo.append(iter(c.children))
                    break
                if s := c.strip():
                    yield s
            else:
                todo.pop()


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Element("", {})
        self.open = [self.root]
        self.data: list[str] = []

    def flush(self) -> None:
        if self.data:
            self.open[-1].children.append("".join(self.data))
            self.data = []

    def handle_data(self, data: str) -> None:
        self.data.append(data)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.flush()
        e = Element(tag, {k: v or "" for k, v in reversed(attrs)})
        self.open[-1].children.append(e)
        if tag not in VOID:
            self.open.append(e)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.flush()
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                break

    def _cut(self, _: str) -> None:
        self.flush()

    handle_comment = handle_decl = handle_pi = unknown_decl = _cut


def parse(html: str) -> Element:
    b = _Builder()
    b.feed(html)
    b.close()
    b.flush()
    return b.root


def _dropped(e: Element) -> bool:
    return e.tag in DROP_TAGS or e.has_class(DROP_CLASSES) or e.attrs.get("id") in DROP_IDS or e.attrs.get("data-testid") in DROP_TEST_IDS


def _prune(root: Element, drop: Callable[[Element], bool]) -> None:
    todo = [root]
    while todo:
        e = todo.pop()
        e.children = [c for c in e.children if not (isinstance(c, Element) and drop(c))]
        todo += [c for c in e.children if isinstance(c, Element)]


def _content_root(root: Element) -> Element | None:
    found: dict[tuple[str, str], Element] = {}
    for e in root.walk():
        for how, name in ROOTS:
            if (how, name) not in found and (e.tag == name if how == "tag" else e.attrs.get("id") == name if how == "id" else e.has_class({name})):
                found[how, name] = e
    return next((found[r] for r in ROOTS if r in found), None)


def page_title(root: Element, url: str) -> str:
    tag = next((e for e in root.walk() if e.tag == "title"), None)
    return url if tag is None else "".join(tag.strings())


def sections(html: str, url: str, section_words: int = SECTION_WORDS, page_words: int = PAGE_WORDS) -> tuple[str, list[tuple[str, str]]]:
    """(page title, [(heading, text)]); no sections where the page has no content root or too little prose."""
    root = parse(html)
    title = page_title(root, url)
    _prune(root, _dropped)
    main = _content_root(root)
    if main is None:
        return title, []
    out: list[tuple[str, list[str]]] = [(title, [])]
    for e in main.walk():
        if e.tag in ("h1", "h2", "h3"):
            out.append(("".join(e.strings()), []))
        elif e.tag in ("p", "li", "td") and (line := " ".join(e.strings())):
            out[-1][1].append(line)
    kept = [(h, x) for h, lines in out if (x := "\n".join(lines).strip()) and len(x.split()) >= section_words]
    return title, kept if sum(len(x.split()) for _, x in kept) >= page_words else []


def page_titles(df: DataFrame, ids: list[str], url: str = "url", html: str = "html") -> DataFrame:
    """ids, page_title of every page with html: its title, or the url where it has none."""
    pages = df.select(*ids, F.coalesce(F.col(url), F.lit("")).alias("_url"), F.col(html).alias("_html")).filter("_html IS NOT NULL")
    schema = df.select(*ids).schema.add("page_title", t.StringType())

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [page_title(parse(h), u) for h, u in zip(pdf["_html"], pdf["_url"])]
            yield pdf[ids].assign(page_title=pd.array(found, dtype=object))

    return pages.mapInPandas(extract, schema)


def page_sections(df: DataFrame, ids: list[str], url: str = "url", html: str = "html", section_words: int = SECTION_WORDS, page_words: int = PAGE_WORDS) -> DataFrame:
    """ids, page_title, section_no, heading, text. Null html gives none; a null url stands as an empty title."""
    pages = df.select(*ids, F.coalesce(F.col(url), F.lit("")).alias("_url"), F.col(html).alias("_html")).filter("_html IS NOT NULL")
    schema = df.select(*ids).schema.add("page_title", t.StringType()).add("section_no", t.IntegerType()).add("heading", t.StringType()).add("text", t.StringType())

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for row in pdf.itertuples(index=False):
                title, found = sections(row[-1], row[-2], section_words, page_words)
                rows += [(*row[:-2], title, n, h, t) for n, (h, t) in enumerate(found, 1)]
            if rows:
                yield pd.DataFrame(rows, columns=schema.names)

    return pages.mapInPandas(extract, schema)


def page_chunks(df: DataFrame, ids: list[str], url: str = "url", html: str = "html") -> DataFrame:
    """Chunks of each page in document order, each chunk id once per page, at its first place."""
    from .chunking import chunk_sections

    parts = chunk_sections(page_sections(df, ids, url, html), [*ids, "page_title", "section_no", "heading"])
    first = parts.groupBy(*ids, "chunk_id").agg(F.min_by(F.struct("page_title", "heading", "chunk_text", "token_count"), F.struct("section_no", "k")).alias("c"), F.min(F.struct("section_no", "k")).alias("place"))
    return first.select(*ids, "chunk_id", "place.section_no", "place.k", "c.*")
