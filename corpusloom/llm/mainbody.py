"""Main body of a page against what surrounds it, by path ratios.

Pages that were fetched have tags; most texts have lost theirs. Both are decided by ratios that are aggregated per path over
all pages, smoothed, fused and held against a threshold. No phrase, language or kind of line is known beforehand.

Tag paths (``tag_path_scores``)
  1. Every piece of text of a page belongs to the root-to-leaf path of its element (tags with their id and classes).
  2. Length and punctuation are summed per site and path, and per path prefix over all that lies below it.
  3. The fused ratio is ln(1 + mean length) * mean marks; a path's own is smoothed with those of its prefixes, each counting
     half of the one below, but for those that hold nearly all of a site. Paths under ``tag_threshold`` surround the body.
     A heading or footer directly under the body element has only its own ratio.

Wording paths (``line_scores``), for lines without tags
  1. A line's paths are its pairs of neighbouring tokens (words, numbers as one, single symbols, the line's ends); words that
     make up under ``share`` of all tokens are one blank, as names are. The root path holds every line.
  2. Per path over all lines: the spread of ln(length) and the share of lines with punctuation or a number. What runs in
     body text comes back in lines of every length; what a site puts around it always comes back in the same line. The
     spread is smoothed with that of the root. Paths seen once say nothing.
  3. Fused: median spread * (median punctuation share)^4 over a line's paths; menus have no punctuation, notices no spread.
  4. A line's shape (its first symbols, words and numbers as one letter each) is a path too. The score is multiplied by the
     share of the shape's lines with punctuation or a number, and smoothed over neighbours, by the square of the share of
     lines next to that shape that reach the threshold: what only stands among menus and notices sinks.

A line whose page was fetched and has a text node of the same wording takes the verdict of that node's tag path.

Sizes: words and wording paths that are kept make up at least ``share`` of all tokens, pairs or lines, so that at most
1/share of each exist whatever the corpus; those are what the tasks are sent.

Defined results
  * line 1 and blank lines are never reported; null texts have no lines; service, url and html may be null;
  * repeated rows are reported each and count as evidence each; rows with a null id are reported with it;
  * a line of words that nothing else shares is decided by the root path, so it is content;
  * a shape that only ever stands next to menus and notices is taken for one, so a corpus whose body texts are single
    lines of one shape between notices loses them;
  * empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.urls import page
from ..operators.extract import Element, parse
from ..session import materialise

THRESHOLD, TAG_THRESHOLD = 0.1, 3.0
#: What a word, a path or a shape must make up of all to be kept: at most 1 / SHARE of each are.
SHARE = 2e-6
#: Lines that the root's spread counts for, and neighbours that a shape is given for nothing.
PRIOR_LINES, PRIOR_NEIGHBOURS = 0.25, 8
#: How often the punctuation share is multiplied into the score.
_POWER = 4
_SHAPE = 10
#: Elements whose text is not shown on the page, and the levels of a path that are told apart.
_UNSEEN, _LEVELS = frozenset(("script", "style", "title", "template", "noscript")), 32
#: A prefix that holds this share of a site's text nodes, as the body element does, says nothing of what is inside and out.
_WHOLE = 0.98

_MARK = r"[0-9.,;=!?()。、，：；！？（）]|(?<!:):(?!:)"
_TOKEN = r"[\p{L}\p{M}]+|\p{N}+|[^\p{L}\p{M}\p{N}\s]"
_LINES = "array<struct<no:int,h:bigint,chars:int,marked:int,shape:int,tokens:array<int>>>"


def page_of(url: Column) -> Column:
    return F.xxhash64(page(T.strip(url)))


def wording(line: Column) -> Column:
    return F.lower(T.squash(line))


def page_lines(df: DataFrame, id_col: str = "chunk_no", url: str = "source_url", text: str = "text") -> DataFrame:
    """id, page, lines: the non-blank lines after the first of each text, as hashes. A text's lines stay in one row."""
    lines = F.filter(F.transform(F.split(F.col(text), "\n", -1), lambda x, i: F.struct((i + 1).alias("no"), wording(x).alias("line"))), lambda x: (x["no"] > 1) & (x["line"] != ""))

    def measured(x: Column) -> Column:
        line = x["line"]
        # Single classes only: Java would recurse for each repeat of a group, too deep on long lines.
        shape = F.replace(F.regexp_replace(F.regexp_replace(line, r"[\p{L}\p{M}]+", "a"), r"\p{N}+", "0"), F.lit(" "), F.lit(""))
        shape = F.regexp_replace(shape, "aa+", "a")
        tokens = F.regexp_extract_all(F.regexp_replace(line, r"\p{N}+", "0"), F.lit(_TOKEN), F.lit(0))
        return F.struct(
            x["no"].alias("no"),
            F.xxhash64(line).alias("h"),
            F.length(line).alias("chars"),
            line.rlike(_MARK).cast("int").alias("marked"),
            F.hash(F.substring(shape, 1, _SHAPE)).alias("shape"),
            F.transform(tokens, lambda w: F.hash(w)).alias("tokens"),
        )

    return df.filter(F.col(text).isNotNull()).select(F.col(id_col).alias("id"), page_of(F.col(url)).alias("page"), F.transform(lines, measured).cast(_LINES).alias("lines"))


# ---------------------------------------------------------------- wording paths


#: Stand-ins for a token's hash: a line's end, a blank; and for a path's: the root, which holds every line.
_END, _BLANK, _ROOT = 1, 2, 0


def _bounded(counts: DataFrame, by: str, share: float) -> DataFrame:
    """Rows of ``counts`` whose ``by`` is two or more and at least ``share`` of all: at most 1 / share rows."""
    total = counts.agg(F.coalesce(F.sum(by), F.lit(0)).alias("t"))
    return counts.filter(F.col(by) >= F.greatest(F.lit(2.0), total.scalar() * F.lit(share)))


def _line_arrays(batch: pa.RecordBatch, words: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Fields of the batch's lines, lines per row, and the distinct (line, path) pairs, sorted by path."""
    column = batch.column("lines")
    lines = column.flatten()
    field = {f: pc.struct_field(lines, f).to_numpy(zero_copy_only=False) for f in ("no", "h", "chars", "marked", "shape")}
    tokens = pc.struct_field(lines, "tokens")
    n = tokens.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = tokens.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
    at = np.minimum(np.searchsorted(words, flat), max(len(words) - 1, 0))
    flat = np.where(words[at] == flat, flat, _BLANK) if len(words) else np.full_like(flat, _BLANK)
    ends = np.cumsum(n)
    left, right = np.insert(flat, ends - n, _END), np.insert(flat, ends, _END)
    path = (left.astype(np.int64) << 32) | right.astype(np.uint32).astype(np.int64)
    row = np.repeat(np.arange(len(n)), n + 1)
    order = np.argsort(path, kind="stable")
    path, row = path[order], row[order]
    first = np.ones(len(path), dtype=bool)
    first[1:] = (path[1:] != path[:-1]) | (row[1:] != row[:-1])
    return field, column.value_lengths().to_numpy(zero_copy_only=False), row[first], path[first]


_PATHS_DDL = "path bigint, n double, marked double, s double, q double"


def frequent_words(lines: DataFrame, share: float = SHARE) -> np.ndarray:
    tokens = lines.select(F.explode(F.flatten("lines.tokens")).alias("token"))
    counts = materialise(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")), "main-words")
    return np.sort(_bounded(counts, "n", share).select("token").toPandas()["token"].to_numpy(dtype=np.int32))


def wording_paths(lines: DataFrame, words: np.ndarray, share: float = SHARE, prior: float = PRIOR_LINES) -> pd.DataFrame:
    """path, spread, marked of every wording path of two or more lines, sorted by path; the root comes first."""
    shared = lines.sparkSession.sparkContext.broadcast(words)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            field, _, row, path = _line_arrays(b, shared.value)
            if not len(path):
                continue
            x, marked = np.log(field["chars"]), field["marked"].astype(np.float64)
            starts = np.flatnonzero(np.r_[True, path[1:] != path[:-1]])
            columns = [np.ones(len(row)), marked[row], x[row], x[row] ** 2]
            sums = [np.r_[np.add.reduceat(c, starts), r] for c, r in zip(columns, (len(x), marked.sum(), x.sum(), (x * x).sum()))]
            yield pa.record_batch([pa.array(np.r_[path[starts], _ROOT]), *map(pa.array, sums)], names=["path", "n", "marked", "s", "q"])

    sums = lines.mapInArrow(measure, _PATHS_DDL).groupBy("path").agg(*(F.sum(c).alias(c) for c in ("n", "marked", "s", "q")))
    got = _bounded(materialise(sums, "main-paths"), "n", share).toPandas().sort_values("path", ignore_index=True)
    got = pd.concat([got[got["path"] == _ROOT], got[got["path"] != _ROOT]], ignore_index=True)
    if not len(got):
        return pd.DataFrame({"path": [_ROOT], "spread": [1.0], "marked": [1.0]})
    within = np.maximum(got["q"] - got["s"] ** 2 / got["n"], 0)
    root = within[0] / got["n"][0]
    return pd.DataFrame({"path": got["path"], "spread": np.sqrt((within + prior * root) / (got["n"] + prior)), "marked": got["marked"] / got["n"]})


def _medians(row: np.ndarray, value: np.ndarray, rows: int, other: float) -> np.ndarray:
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    n = np.bincount(row, minlength=rows)
    start = np.cumsum(n) - n
    out = np.full(rows, other)
    some = n > 0
    low, high = (start + (n - 1) // 2)[some], (start + n // 2)[some]
    out[some] = (value[low] + value[high]) / 2
    return out


def line_scores(lines: DataFrame, threshold: float = THRESHOLD, share: float = SHARE, prior: float = PRIOR_LINES) -> DataFrame:
    """id, line_no, page, h, shape, marked, score, neighbours, around: of each line, and how many of its neighbours fall short."""
    words = frequent_words(lines, share)
    paths = wording_paths(lines, words, share, prior)
    shared = lines.sparkSession.sparkContext.broadcast((words, paths["path"].to_numpy(np.int64)[1:], paths["spread"].to_numpy(), paths["marked"].to_numpy()))
    id_type = lines.schema["id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, known, spread, marked = shared.value
        for b in batches:
            field, per_row, row, path = _line_arrays(b, kept)
            n = len(field["no"])
            if not n:
                continue
            at = np.minimum(np.searchsorted(known, path), max(len(known) - 1, 0))
            hit = known[at] == path if len(known) else np.zeros(len(path), dtype=bool)
            row, at = row[hit], at[hit] + 1
            s = _medians(row, spread[at], n, spread[0]) * _medians(row, marked[at], n, marked[0]) ** _POWER
            text = np.repeat(np.arange(len(per_row)), per_row)
            low = (s < threshold).astype(np.int32)
            same = text[1:] == text[:-1]
            neighbours, around = np.zeros(n, np.int32), np.zeros(n, np.int32)
            neighbours[1:] += same
            neighbours[:-1] += same
            around[1:] += same * low[:-1]
            around[:-1] += same * low[1:]
            ids, pages = (b.column(c).take(pa.array(text)) for c in ("id", "page"))
            yield pa.record_batch(
                [ids, pa.array(field["no"].astype(np.int64)), pages, *map(pa.array, (field["h"], field["shape"], field["marked"], s, neighbours, around))],
                names=["id", "line_no", "page", "h", "shape", "marked", "score", "neighbours", "around"],
            )

    return lines.mapInArrow(score, f"id {id_type}, line_no bigint, page bigint, h bigint, shape int, marked int, score double, neighbours int, around int")


def smoothed_scores(scores: DataFrame, share: float = SHARE, prior: float = PRIOR_NEIGHBOURS) -> DataFrame:
    """id, line_no, page, h, score: score * share of the shape that is marked * (1 - share of neighbours that fall short)^2."""
    shapes = scores.groupBy("shape").agg(F.count(F.lit(1)).alias("k"), F.sum("marked").alias("m"), F.sum("neighbours").alias("n"), F.sum("around").alias("a"))
    shapes = _bounded(materialise(shapes, "main-shapes"), "k", share).select("shape", (F.col("m") / F.col("k") * F.pow(1 - F.col("a") / (F.col("n") + prior), 2)).alias("keep"))
    # At most 1 / share rows of 12 bytes.
    joined = scores.join(F.broadcast(shapes), "shape", "left")
    return joined.select("id", "line_no", "page", "h", (F.col("score") * F.coalesce("keep", F.col("marked").cast("double"))).alias("score"))


# ---------------------------------------------------------------- tag paths


def _step(e: Element) -> str:
    name = e.tag
    if e.attrs.get("id"):
        name += "#" + e.attrs["id"]
    return ".".join([name, *sorted(e.attrs.get("class", "").split())])


def text_nodes(html: str) -> Iterator[tuple[str, str]]:
    """(path, text) of every piece of text in document order; paths are cut at 32 levels."""
    todo: list[tuple[str, int, Iterator]] = [("", 0, iter(parse(html).children))]
    while todo:
        path, depth, children = todo[-1]
        for c in children:
            if isinstance(c, str):
                if s := c.strip():
                    yield path or "/", s
            elif c.tag not in _UNSEEN:
                todo.append((f"{path}/{_step(c)}" if depth < _LEVELS else path, depth + 1, iter(c.children)))
                break
        else:
            todo.pop()


def tag_nodes(pages: DataFrame, url: str = "url", html: str = "html", id_col: str | None = None) -> DataFrame:
    """site, page, id, no, path, text, chars, marks: one row per piece of text of each page."""
    site = F.coalesce(F.lower(F.regexp_extract(T.strip(F.col(url)), r"^[^:/?#]+://([^/?#]*)", 1)), F.lit(""))
    slim = pages.filter(F.col(html).isNotNull()).select(
        site.alias("site"), page_of(F.col(url)).alias("page"), (F.col(id_col) if id_col else F.lit(None)).cast("bigint").alias("id"), F.col(html).alias("html")
    )

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(*r[:3], n, path, text) for r in pdf.itertuples(index=False, name=None) for n, (path, text) in enumerate(text_nodes(r[3]))]
            out = pd.DataFrame(rows, columns=["site", "page", "id", "no", "path", "text"])
            out["id"] = out["id"].astype("Int64")
            yield out

    nodes = slim.mapInPandas(walk, "site string, page bigint, id bigint, no int, path string, text string")
    marks = F.length("text") - F.length(F.regexp_replace("text", _MARK, ""))
    return nodes.withColumn("chars", F.length("text")).withColumn("marks", marks)


def tag_path_scores(nodes: DataFrame) -> DataFrame:
    """site, path, score of every root-to-leaf path. Sums combine map-side; from there on there is one row per path."""
    own = materialise(nodes.groupBy("site", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"), F.sum("marks").alias("marks")), "tag-paths")
    steps = F.split("path", "/")
    up = own.select("site", "path", "n", "chars", "marks", F.explode(F.sequence(F.lit(1), F.size(steps))).alias("level")).withColumn("prefix", F.array_join(F.slice(F.split("path", "/"), 1, F.col("level")), "/"))
    below = up.groupBy("site", "prefix").agg(F.sum("n").alias("n"), F.sum("chars").alias("chars"), F.sum("marks").alias("marks"))
    whole = below.filter("prefix = ''").select("site", F.col("n").alias("all"))
    said = below.join(whole, "site").select("site", "prefix", (F.log1p(F.col("chars") / F.col("n")) * F.col("marks") / F.col("n")).alias("ratio"), (F.col("n") < _WHOLE * F.col("all")).alias("part"))
    weight = F.pow(F.lit(2.0), F.col("level") - F.size(steps))
    weighed = up.select("site", "path", "prefix", "level", weight.alias("w"), (F.col("level") == F.size(steps)).alias("leaf")).join(said, ["site", "prefix"]).filter("part OR leaf")
    return weighed.groupBy("site", "path").agg((F.sum(F.col("w") * F.col("ratio")) / F.sum("w")).alias("score"))


def page_verdicts(pages: DataFrame, threshold: float = TAG_THRESHOLD, url: str = "url", html: str = "html") -> DataFrame:
    """page, h, outside: each wording on each fetched page, and whether all its nodes there lie outside the body."""
    nodes = materialise(tag_nodes(pages, url, html).select("site", "page", "path", F.xxhash64(wording(F.col("text"))).alias("h"), "chars", "marks"), "tag-nodes")
    verdict = nodes.join(tag_path_scores(nodes), ["site", "path"])
    return verdict.groupBy("page", "h").agg((F.max("score") < threshold).alias("outside"))


def page_bodies(pages: DataFrame, id_col: str = "fetch_no", threshold: float = TAG_THRESHOLD, url: str = "url", html: str = "html") -> DataFrame:
    """id, kept, dropped, body: the main text of each page that has any text, its pieces in document order."""
    nodes = materialise(tag_nodes(pages, url, html, id_col), "tag-texts")
    rows = nodes.join(tag_path_scores(nodes), ["site", "path"]).withColumn("inside", F.col("score") >= threshold)
    piece = F.when(F.col("inside"), F.struct("no", "text"))
    g = rows.groupBy("id", "page").agg(F.count_if("inside").alias("kept"), F.count_if(~F.col("inside")).alias("dropped"), F.array_sort(F.collect_list(piece)).alias("pieces"))
    return g.select("id", "kept", "dropped", F.array_join("pieces.text", "\n").alias("body"))


# ---------------------------------------------------------------- both


def surrounding_lines(
    df: DataFrame,
    pages: DataFrame | None = None,
    threshold: float = THRESHOLD,
    tag_threshold: float = TAG_THRESHOLD,
    share: float = SHARE,
    id_col: str = "chunk_no",
    url: str = "source_url",
    text: str = "text",
) -> DataFrame:
    """id, line_no of every line that does not belong to the main body. ``pages`` (url, html) are the fetched pages."""
    lines = materialise(page_lines(df, id_col, url, text), "main-lines")
    scores = smoothed_scores(materialise(line_scores(lines, threshold, share), "main-scores"), share)
    outside = F.col("score") < threshold
    if pages is not None:
        scores = scores.join(page_verdicts(pages, tag_threshold), ["page", "h"], "left")
        outside = F.coalesce("outside", outside)
    return scores.filter(outside).select("id", "line_no")
