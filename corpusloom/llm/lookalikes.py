"""One consistent form for texts that look the same but are spelled with different characters.

Strings drawn alike (full-width forms, ligatures, split-up accents, invisible characters, special spaces, look-alike letters)
are merged into transitive classes by union-find, first over code points, then over strings: a letter with its accents in
every spelling of the letter. Each class is represented by its member that is most frequent in the corpus, and an automaton
over all members rewrites a text greedily, longest match first.

Letter case, accents, digits, raised digits and punctuation marks are visible and stay apart:
  * look-alike letters are the letters and letter numerals without parts that Unicode's table of confusable characters
    (Spark's own ICU library) gives one skeleton, among capitals, among small letters and among letters without case, each
    for itself; letters drawn with a mark through them, digits, punctuation and letters like two others take no part;
  * compatibility decompositions are followed only where they keep the drawing (wide, narrow, no-break, font, ligatures
    and numerals made of letters), never for superscripts, fractions, circles or squares.

Defined results
  * null and blank texts are left out of pairs and classes and are unchanged by rewriting;
  * exact copies share a class; pairs are given between documents whose texts differ, copies included; rows with a null
    id are in classes but not in pairs;
  * a ligature or numeral of several letters becomes those letters, each as its class is represented;
  * empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import materialise

#: Decomposition tags that keep what is drawn.
_SAME_DRAWING = {"<wide>", "<narrow>", "<noBreak>", "<font>"}
_INVISIBLE = "­͏؜ᅟᅠ឴឵᠋᠌᠍᠎​‌‍‎‏⁠⁡⁢⁣⁤﻿" + "\u3164\uffa0"
_HIDDEN = frozenset({*_INVISIBLE, *map(chr, range(0xFE00, 0xFE10))})  # and the variation selectors
_HIDDEN_RUN = re.compile(f"[{''.join(sorted(_HIDDEN))}]+")
_CASE = {"Lu": "upper", "Lt": "upper", "Ll": "lower", "Lo": "none", "Nl": "none"}


def prepared(s: str) -> str:
    """Without what is invisible, in composed form. What is hidden may stand between a letter and its accent."""
    return unicodedata.normalize("NFC", _HIDDEN_RUN.sub("", unicodedata.normalize("NFC", s)))


def _case(c: str) -> str | None:
    kind = _CASE.get(unicodedata.category(c))
    if kind == "none" and c != c.lower():
        return "upper"
    return "lower" if kind == "none" and c != c.upper() else kind


def lookalike_letters(spark: SparkSession) -> list[list[str]]:
    """Groups of single letters with one skeleton and case, from the confusables of the ICU library that Spark brings."""
    letters = [c for o in range(0x41, sys.maxunicode + 1) if _case(c := chr(o)) and unicodedata.is_normalized("NFD", c)]
    checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    groups: dict[tuple[str, str], list[str]] = {}
    for s in range(0, len(letters), 20_000):
        part = letters[s : s + 20_000]
        for c, skeleton in zip(part, checker.getSkeleton(0, "\n".join(part)).split("\n"), strict=True):
            if skeleton and not any(map(unicodedata.combining, skeleton)):
                groups.setdefault((_case(c), skeleton), []).append(c)
    return [g for g in groups.values() if len(g) > 1]


def drawn_pairs() -> Iterator[tuple[str, str]]:
    """(code point, string drawn like it) over all code points, by rule."""
    yield "\u2010", "-"
    for o in range(0x80, sys.maxunicode + 1):
        c = chr(o)
        if c in _HIDDEN:
            continue
        kind = unicodedata.category(c)
        if kind == "Zs":
            yield c, " "
            continue
        d = unicodedata.decomposition(c)
        if not d:
            continue
        tag, *rest = d.split() if d[0] == "<" else ["", *d.split()]
        as_text = "".join(chr(int(x, 16)) for x in rest)
        lettered = tag == "<compat>" and (kind == "Nl" or kind[0] == "L" and len(as_text) > 1) and as_text.isalpha()
        if tag in _SAME_DRAWING or tag == "" or lettered:
            yield c, as_text


class Classes:
    """Union-find over strings; the members of a class are what its strings are rewritten to and from."""

    def __init__(self) -> None:
        self.parent: dict[str, str] = {}

    def find(self, x: str) -> str:
        self.parent.setdefault(x, x)
        while (p := self.parent[x]) != x:
            self.parent[x] = x = self.parent[p]
        return x

    def union(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def members(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for x in list(self.parent):
            out.setdefault(self.find(x), []).append(x)
        return out


class Drawings:
    """What every code point is drawn as: a string of roots of classes of code points.

    Classes of code points come first, from every pair of single ones; then each root is spelled out where a member of
    its class is drawn as several. Spelling ends, as decompositions do not lead back.
    """

    def __init__(self, letters: Iterable[list[str]]) -> None:
        self.points, self.parts, self.known = Classes(), {}, {}
        self.pairs = list(drawn_pairs())
        for group in letters:
            for c in group[1:]:
                self.points.union(group[0], c)
        longer = []
        for a, b in self.pairs:
            b = unicodedata.normalize("NFD", b)
            if len(b) == 1:
                self.points.union(a, b)
            else:
                longer.append((a, b))
        for a, b in longer:
            self.parts[self.points.find(a)] = b

    def of(self, s: str) -> str:
        """The drawing of ``s``; equal for strings that look the same."""
        return unicodedata.normalize("NFD", "".join(map(self._point, unicodedata.normalize("NFD", s))))

    def _point(self, c: str) -> str:
        if c not in self.known:
            root = self.points.find(c)
            self.known[c] = root if root not in self.parts else self.of(self.parts[root])
        return self.known[c]


def _accented(drawing: str) -> bool:
    return len(drawing) > 1 and not unicodedata.combining(drawing[0]) and all(map(unicodedata.combining, drawing[1:]))


def rewrite_table(counts: dict[str, int], letters: Iterable[list[str]]) -> tuple[dict[str, str], dict[str, str]]:
    """(code point of several letters -> those letters, other member -> representative), for whatever changes.

    The representative is the most frequent member (a string counts as its rarest character); the shortest, then
    smallest, on ties. The number of members is bounded by the code points of Unicode times the letters of a class.
    """
    d = Drawings(letters)
    alike = d.points.members()
    classes, several = Classes(), {}
    for c in sorted({*d.points.parent, *(a for a, _ in d.pairs)}):
        drawing = d.of(c)
        if len(drawing) > 1 and not _accented(drawing):
            several[c] = unicodedata.normalize("NFC", drawing)
            continue
        classes.union(unicodedata.normalize("NFC", drawing), c)
        if _accented(drawing):
            for base in alike.get(d.points.find(drawing[0]), drawing[:1]):
                classes.union(c, unicodedata.normalize("NFC", base + drawing[1:]))
    table = {}
    for members in classes.members().values():
        if len(members) > 1:
            best = min(members, key=lambda m: (-min(counts.get(c, 0) for c in m), len(m), m))
            table |= {m: best for m in members if m != best}
    return several, table


def character_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """point, n: how often each code point occurs in all prepared texts, counted per batch and summed by Spark."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(0, dtype=np.int64)
        for pdf in batches:
            points = np.frombuffer("".join(map(prepared, pdf["text"])).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            got = np.bincount(points)
            if len(got) > len(total):
                got, total = total, got.astype(np.int64)
            total[: len(got)] += got
        seen = np.flatnonzero(total)
        yield pd.DataFrame({"point": seen.astype(np.int32), "n": total[seen]})

    parts = df.select(F.col(text).alias("text")).filter("text IS NOT NULL").mapInPandas(count, "point int, n bigint")
    return parts.groupBy("point").agg(F.sum("n").alias("n"))


class Rewriter:
    """Greedy left-to-right rewriting with an Aho-Corasick automaton over all members of a table."""

    def __init__(self, several: dict[str, str], table: dict[str, str]) -> None:
        self.several = str.maketrans(several)
        self.auto = ahocorasick.Automaton()
        self.ascii_moves = any(k.isascii() for k in table)
        for k, v in table.items():
            self.auto.add_word(k, (len(k), v))
        # A longer string that must not be broken up by a shorter match is kept as it is.
        for v in set(table.values()):
            if len(v) > 1:
                self.auto.add_word(v, (len(v), v))
        self.auto.make_automaton()
        # Without any of these characters a prepared text is in its final form.
        touched = {*several, *(c for k in table for c in (k if len(k) == 1 else k[1:]))}
        # Beyond 0xFFFF all count, as a class of single ones there would be searched one by one.
        some = f"[{''.join(re.escape(c) for c in sorted(touched) if c < '\U00010000')}\U00010000-\U0010ffff]"
        # A member is a run of them, but for the letter before its accents.
        self.touched, self.runs = re.compile(some), re.compile(f"(?s).?{some}+")

    def rewritten(self, s: str) -> str:
        out, at = [], 0
        for end, (n, new) in self.auto.iter_long(s):
            out.append(s[at : end - n + 1])
            out.append(new)
            at = end + 1
        out.append(s[at:])
        return "".join(out)

    def __call__(self, s: str) -> str:
        if s.isascii() and not self.ascii_moves:
            return s
        s = prepared(s)
        if not self.touched.search(s):
            return s
        # One pass ends it: a letter and its accents are one member or stay apart, whichever way they are spelled.
        s = unicodedata.normalize("NFC", s.translate(self.several) if self.several else s)
        return unicodedata.normalize("NFC", self.runs.sub(lambda m: self.rewritten(m[0]), s))


def corpus_table(df: DataFrame, text: str = "text") -> tuple[dict[str, str], dict[str, str]]:
    """The rewrite tables for a corpus. At most one row per code point comes to the driver."""
    counts = {chr(p): n for p, n in character_counts(df, text).collect() if not 0xD800 <= p < 0xE000}
    return rewrite_table(counts, lookalike_letters(df.sparkSession))


def consistent_texts(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, text, form: every row with its text in the corpus's consistent form. The table (some hundred KB) is shipped."""
    table = df.sparkSession.sparkContext.broadcast(corpus_table(df, text))

    def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = Rewriter(*table.value)
        for pdf in batches:
            yield pdf.assign(form=[None if t is None else f(t) for t in pdf["text"]])

    slim = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text).alias("text"))
    return slim.mapInPandas(rewrite, "id bigint, text string, form string")


def form_hashes(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, form (128-bit hash of the consistent form), spelled (128-bit hash of the text) of every non-blank text."""
    t = consistent_texts(df.filter(~T.is_blank(F.col(text))), id_col, text)
    return t.select("id", F.unhex(F.md5("form")).alias("form"), F.unhex(F.md5("text")).alias("spelled"))


def lookalike_classes(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, class_id, spellings: one row per document; class_id is the smallest id that looks the same."""
    h = materialise(form_hashes(df, id_col, text), "forms")
    c = h.groupBy("form", "spelled").agg(F.min("id").alias("id")).groupBy("form").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("spellings"))
    return h.join(c, "form").select("id", "class_id", "spellings")


def lookalike_pairs(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_a < doc_b whose texts differ and look the same.

    Spellings are paired first, once for all their copies; documents then join their spelling, so that the copies of one
    text, however many, never meet each other.
    """
    h = materialise(form_hashes(df, id_col, text), "forms")
    spellings = h.select("form", "spelled").distinct()
    several = spellings.groupBy("form").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("form")
    # What is joined grows with the documents, so none of it is broadcast.
    several = several.hint("merge")
    spellings = spellings.join(several, "form", "left_semi").hint("merge")
    one, two = spellings.withColumnRenamed("spelled", "sa"), spellings.withColumnRenamed("spelled", "sb")
    alike = one.join(two, "form").filter("sa < sb").select("sa", "sb")
    docs = h.filter("id IS NOT NULL").join(several, "form", "left_semi").hint("merge")
    a = docs.select(F.col("id").alias("a"), F.col("spelled").alias("sa"))
    b = docs.select(F.col("id").alias("b"), F.col("spelled").alias("sb"))
    pairs = alike.join(a, "sa").join(b, "sb")
    return pairs.select(F.least("a", "b").alias("doc_a"), F.greatest("a", "b").alias("doc_b"))
