"""Lines that one source repeats over many of its pages, and their removal.

1. Every line is known by its service, its page and a 128-bit hash; the texts are read for that once.
2. How many pages of its service a line is on is compared with what is found outside the service: the number of pages an
   average line of the other services is on there (of its own, where there is no other). The log-likelihood ratio of the
   two Poisson rates is the evidence of an excess. A line's own rate elsewhere would not do: menu entries come back in
   every service alike and show no excess against it.
3. The false-discovery rate over all lines on two or more pages is held at ``fdr`` (Benjamini-Hochberg), so lines that
   come back by chance, with copies of a text, fail. ``line_steps`` counts what each step rejects.
4. Last, a reported line is on ``min_pages`` pages at least.

Defined results
  * rows with a null service, url or text take no part in counts and pass through removal unchanged;
  * line 1 and blank lines never count and are never removed;
  * a line's text is compared after trimming, squeezing white space and lower-casing;
  * repeats of a line on one page count once; empty tables give empty results; other columns are kept by removal;
  * the more lines repeat by chance, the more pages it takes to be significant, and it may be more than ``min_pages``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.urls import page
from ..session import materialise

#: -ln p is binned to 1/20 and capped; the histogram has at most this many rows whatever the corpus.
_BINS_PER_NAT, _CAP = 20, 1000


def exploded_lines(df: DataFrame, id_col: str = "chunk_no", service: str = "service", url: str = "source_url", text: str = "text") -> DataFrame:
    """id, svc, page (64-bit hash), line_no, h1, h2: one row per non-blank line after the first.

    Lines are known by a 128-bit hash from here on, so no text is shuffled.
    """
    lines = df.select(
        F.col(id_col).alias("id"),
        F.lower(T.strip(F.col(service))).alias("svc"),
        F.xxhash64(page(F.col(url))).alias("page"),
        F.col(url).alias("_u"),
        F.posexplode(F.split(F.lower(F.col(text)), "\n", -1)).alias("pos", "line"),
    ).filter("pos > 0 AND svc IS NOT NULL AND _u IS NOT NULL")
    norm = lines.select("id", "svc", "page", (F.col("pos") + 1).cast("bigint").alias("line_no"), T.squash(F.col("line")).alias("line")).filter("line <> ''")
    return norm.select("id", "svc", "page", "line_no", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def line_statistics(lines: DataFrame) -> DataFrame:
    """One row per service and line on two or more pages: those pages (a), pages expected (e), -ln p of the excess (nats).

    Counting goes (svc, line, page) -> (svc, line), both with map-side combining, so a line on a third of all rows is
    reduced before it is shuffled.
    """
    per_line = lines.select("svc", "h1", "h2", "page").distinct().groupBy("svc", "h1", "h2").agg(F.count(F.lit(1)).alias("a"))
    per_line = materialise(per_line, "line-pages")
    own = per_line.groupBy("svc").agg(F.sum("a").alias("pages"), F.count(F.lit(1)).alias("lines"))
    total = own.agg(F.sum("pages").alias("pages"), F.sum("lines").alias("lines")).withColumnsRenamed({"pages": "all_pages", "lines": "all_lines"})
    own = own.withColumn("all_pages", total.select("all_pages").scalar()).withColumn("all_lines", total.select("all_lines").scalar())
    alone = F.col("all_lines") == F.col("lines")
    outside = F.when(alone, F.col("pages") / F.col("lines")).otherwise((F.col("all_pages") - F.col("pages")) / (F.col("all_lines") - F.col("lines")))
    s = per_line.filter("a > 1").join(own.select("svc", outside.alias("e")), "svc")
    a, e = F.col("a").cast("double"), F.col("e")
    x = F.when(a > e, a * F.ln(a / e) - (a - e)).otherwise(F.lit(0.0))
    # p = erfc(sqrt(x)) for one degree of freedom, by its upper bound exp(-x) / sqrt(pi x).
    nats = F.when(x > 0.5, x + 0.5 * F.ln(F.lit(3.141592653589793) * x)).otherwise(F.lit(0.0))
    return s.select("svc", "h1", "h2", "a", "e", nats.alias("nats"))


def judged_lines(stats: DataFrame, fdr: float = 0.05, min_pages: int = 8) -> DataFrame:
    """``stats`` with significant (the excess passes the false-discovery limit) and reported (and is on enough pages)."""
    step = F.floor(F.least(F.col("nats"), F.lit(float(_CAP))) * _BINS_PER_NAT)
    hist = stats.groupBy(step.alias("bin")).agg(F.count(F.lit(1)).alias("k"))
    ranked = hist.select("bin", F.sum("k").over(Window.orderBy(F.desc("bin"))).alias("rank"), F.sum("k").over(Window.partitionBy(F.lit(0))).alias("m"))
    ok = ranked.filter(F.exp(-F.col("bin") / _BINS_PER_NAT) <= F.lit(fdr) * F.col("rank") / F.col("m"))
    cut = ok.agg(F.coalesce(F.min("bin"), F.lit(_CAP * _BINS_PER_NAT + 1)).alias("cut"))
    judged = stats.withColumn("significant", step >= cut.scalar())
    return judged.withColumn("reported", F.col("significant") & (F.col("a") >= min_pages))


def _flagged(lines: DataFrame, fdr: float, min_pages: int) -> DataFrame:
    stats = materialise(line_statistics(lines), "line-statistics")
    return judged_lines(stats, fdr, min_pages)


def repeated_lines(df: DataFrame, fdr: float = 0.05, min_pages: int = 8, id_col: str = "chunk_no", service: str = "service", url: str = "source_url", text: str = "text") -> DataFrame:
    """id, line_no of every line that its service repeats."""
    lines = materialise(exploded_lines(df, id_col, service, url, text), "lines")
    flagged = materialise(_flagged(lines, fdr, min_pages).filter("reported").select("svc", "h1", "h2"), "line-flagged")
    return lines.join(flagged, ["svc", "h1", "h2"], "left_semi").select("id", "line_no")


def line_steps(df: DataFrame, fdr: float = 0.05, min_pages: int = 8, id_col: str = "chunk_no", service: str = "service", url: str = "source_url", text: str = "text") -> DataFrame:
    """svc, tested, chance, few, reported: lines on two or more pages, and how many of them each step rejects."""
    judged = _flagged(exploded_lines(df, id_col, service, url, text), fdr, min_pages)
    few = F.col("significant") & ~F.col("reported")
    return judged.groupBy("svc").agg(F.count(F.lit(1)).alias("tested"), F.count_if(~F.col("significant")).alias("chance"), F.count_if(few).alias("few"), F.count_if("reported").alias("reported"))


def without_lines(df: DataFrame, drop: DataFrame, id_col: str = "chunk_no", text: str = "text") -> DataFrame:
    """``df`` with the lines (id, line_no) of ``drop`` taken out of ``text``; the rest keeps its order.

    The line numbers of one row are gathered, never its lines, and a row's own lines bound them.
    """
    bad = drop.groupBy(F.col("id").alias("_drop_id")).agg(F.collect_set("line_no").alias("_drop_lines"))
    lines = F.split(F.col(text), "\n", -1)
    numbers = F.array_except(F.sequence(F.lit(1).cast("bigint"), F.size(lines).cast("bigint")), F.col("_drop_lines"))
    # Both arrays are made once for each row and then put together by position, in time linear in its lines.
    both = F.array(F.struct(lines.alias("line"), numbers.alias("no")))
    kept = F.transform(both, lambda b: F.array_join(F.transform(b["no"], lambda n: F.get(b["line"], (n - 1).cast("int"))), "\n"))
    joined = df.join(bad, F.col(id_col) == F.col("_drop_id"), "left")
    return joined.withColumn(text, F.when(F.col("_drop_lines").isNull(), F.col(text)).otherwise(F.get(kept, F.lit(0)))).drop("_drop_id", "_drop_lines")
