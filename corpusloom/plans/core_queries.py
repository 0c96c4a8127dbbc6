"""Registered queries outside the llm subpackage, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..operators.answer import NO_TEXT, answered, prompt, responses
from ..operators.chunking import chunk_sections
from ..operators.dedupe import keep_first_ranked, keep_last
from ..operators.crawl import crawl, crawl_counts, crawl_urls
from ..operators.extract import page_chunks, page_sections, page_titles
from ..operators.queue import apply_discovery, apply_refresh, diff, latest, orphaned_ids, outcome, overdue, overdue_per_service, page_diff, url_map
from ..operators.requests import validated
from ..operators.retrieve import context, sources, top_k, with_text
from ..operators.runs import runs_of, with_total
from ..operators.snapshots import snapshot_changes
from ..operators.tables import delete_keys, insert_if_absent, upsert
from ..jobs import discover, seed, seed_counts
from ..session import shared_dir, table
from ..sources.chunk_files import fresh_path, read_chunk_files, write_chunk_files
from ..sources.pages import last_pages, read_through
from ..sources.progress import read_failed, read_progress, write_failed, write_progress
from ..sources.sitemaps import sitemap_files, sitemap_urls
from ..sources.versioned import VersionedTable
from ..streaming.refresh import read_fetches, run_refresh

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


# ---------------------------------------------------------------- problem 3: changes between full snapshots

_SNAP_CTE = r"""
WITH cur AS (
  SELECT snapshot_no, url, h FROM (
    SELECT snapshot_no, regexp_replace(regexp_replace(url, '^\s+', ''), '\s+$', '') AS url,
           list_sort(list_distinct(list_filter(coalesce(chunk_ids, []), lambda x: x IS NOT NULL))) AS h, load_no FROM url_snapshots WHERE url IS NOT NULL)
  QUALIFY row_number() OVER (PARTITION BY snapshot_no, url ORDER BY load_no DESC) = 1),
nums AS (SELECT snapshot_no, lead(snapshot_no) OVER (ORDER BY snapshot_no) AS next_no FROM (SELECT DISTINCT snapshot_no FROM url_snapshots))
"""
_SNAP_EVENTS = (
    _SNAP_CTE
    + """
, pairs AS (SELECT a.url, a.h, n.next_no FROM cur a JOIN nums n USING (snapshot_no) WHERE n.next_no IS NOT NULL),
ev AS (
SELECT coalesce(n.next_no, b.snapshot_no) AS snapshot_no, coalesce(n.url, b.url) AS url,
       CASE WHEN n.url IS NULL THEN 'added' WHEN b.url IS NULL THEN 'removed' WHEN n.h <> b.h THEN 'changed' END AS kind
FROM pairs n FULL JOIN (SELECT * FROM cur WHERE snapshot_no > (SELECT min(snapshot_no) FROM url_snapshots)) b
  ON n.next_no = b.snapshot_no AND n.url = b.url)
"""
)


@query("p3_found", _SNAP_EVENTS + "SELECT snapshot_no, url, kind FROM ev WHERE kind IS NOT NULL")
def p3_found(spark, d):
    return snapshot_changes(table(spark, d, "url_snapshots")).select("snapshot_no", F.col("key").alias("url"), "kind")


@query("p3_counts", _SNAP_EVENTS + "SELECT snapshot_no, kind, count(*) AS n FROM ev WHERE kind IS NOT NULL GROUP BY ALL")
def p3_counts(spark, d):
    return snapshot_changes(table(spark, d, "url_snapshots")).groupBy("snapshot_no", "kind").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- URL rules and cache names

_URLS = "(SELECT DISTINCT regexp_replace(regexp_replace(url, '^\\s+', ''), '\\s+$', '') AS url, service FROM url_snapshots WHERE url IS NOT NULL)"


def _urls(spark, d):
    return table(spark, d, "url_snapshots").filter("url IS NOT NULL").select(T.strip(F.col("url")).alias("url"), "service").distinct()


@query("url_scope", f"SELECT u.url, u.service, starts_with(u.url, s.prefix) AND ends_with(u.url, '.html') AS in_scope FROM {_URLS} u JOIN services s ON u.service = s.service")
def url_scope(spark, d):
    j = _urls(spark, d).join(table(spark, d, "services").select("service", "prefix"), "service")
    return j.select("url", "service", U.in_scope(F.col("url"), F.col("prefix")).alias("in_scope"))


@query(
    "url_exclude_crawl",
    f"""SELECT url, service, coalesce(regexp_matches(url, '/api/|-api-reference|doc-history|document-history|release-notes|release-history|/index\\.html$', 'i')
    OR (coalesce(service, '') = 'vmfleet' AND regexp_matches(url, 'instance-types|instance_types|/vmfleet/.*pricing', 'i')), FALSE) AS excluded FROM {_URLS}""",
)
def url_exclude_crawl(spark, d):
    return _urls(spark, d).select("url", "service", U.crawl_excluded(F.col("url"), F.coalesce("service", F.lit(""))).alias("excluded"))


@query(
    "url_exclude_discovery",
    f"""SELECT url, service, contains(url, 'doc-history') OR contains(url, 'document-history') OR contains(url, 'release-notes') OR contains(url, 'release-history') OR contains(url, '/index.html')
    OR (coalesce(service, '') = 'vmfleet' AND (contains(url, 'instance-types') OR contains(url, 'instance_types'))) AS excluded FROM {_URLS}""",
)
def url_exclude_discovery(spark, d):
    return _urls(spark, d).select("url", "service", U.discovery_excluded(F.col("url"), F.coalesce("service", F.lit(""))).alias("excluded"))


@query(
    "cache_keys",
    """SELECT DISTINCT source_url, CASE WHEN ends_with(seg, '.html') THEN seg ELSE seg || '.html' END AS cache_file
    FROM (SELECT source_url, string_split(rtrim(source_url, '/'), '/')[-1] AS seg FROM chunks WHERE source_url IS NOT NULL)""",
)
def cache_keys(spark, d):
    return table(spark, d, "chunks").filter("source_url IS NOT NULL").select("source_url", U.cache_name(F.col("source_url")).alias("cache_file")).distinct()


@query(
    "sitemap_urls",
    f"""SELECT u.service, u.url FROM {_URLS} u JOIN services s ON u.service = s.service WHERE u.url <> '' AND starts_with(u.url, s.prefix) AND ends_with(u.url, '.html')
    AND NOT regexp_matches(u.url, '/api/|-api-reference|doc-history|document-history|release-notes|release-history|/index\\.html$', 'i')
    AND NOT (u.service = 'vmfleet' AND regexp_matches(u.url, 'instance-types|instance_types|/vmfleet/.*pricing', 'i'))""",
)
def sitemap_scan(spark, d):
    """Sitemap documents of all snapshots, written and scanned: parse, scope, exclude."""
    files = sitemap_files(_urls(spark, d).filter("service IS NOT NULL"))
    found = sitemap_urls(files, ["service"]).join(table(spark, d, "services").select("service", "prefix"), "service")
    url = F.col("url")
    return found.filter(U.in_scope(url, F.col("prefix")) & ~U.crawl_excluded(url, F.col("service"))).select("service", "url")


# ---------------------------------------------------------------- pages, sections and chunks


_HEAD = r"regexp_extract(html, '(?is)<title(\s[^>]*)?>(.*?)</title', 2)"
_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&copy;", "©"), ("&amp;", "&"))


def _plain_sql(e: str) -> str:
    for a, b in _ENTITIES:
        e = f"replace({e}, '{a}', '{b}')"
    return rf"regexp_replace(regexp_replace({e}, '^\s+', ''), '\s+$', '')"


@query("page_titles", f"SELECT fetch_no, CASE WHEN regexp_matches(html, '(?i)<title[ >]') THEN {_plain_sql(_HEAD)} ELSE coalesce(url, '') END AS page_title FROM fetch_results WHERE html IS NOT NULL")
def page_titles_query(spark, d):
    return page_titles(table(spark, d, "fetch_results"), ["fetch_no"])


@query("page_sections")
def page_sections_query(spark, d):
    return page_sections(table(spark, d, "fetch_results"), ["fetch_no", "url"])


@query("page_chunks")
def page_chunks_query(spark, d):
    return page_chunks(table(spark, d, "fetch_results"), ["fetch_no"])


_WORDS = r"list_filter(string_split_regex(text, '[\s\x0b\x1c-\x1f\x{85}\p{Z}]+'), lambda x: x <> '')"
_WINDOWS_SQL = rf"""
WITH RECURSIVE s AS (SELECT doc_id, source || chr(10) || chr(10) AS prefix, text FROM documents WHERE text <> ''),
l AS (SELECT doc_id, prefix, ws, 2048 - length(prefix) AS eff, len(ws) AS n FROM (SELECT doc_id, prefix, {_WORDS} AS ws FROM s WHERE length(text) > 2048 - length(prefix)) WHERE len(ws) > 0),
u AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM l),
cs AS (SELECT doc_id, list(c ORDER BY i) AS cum FROM (SELECT doc_id, i, sum(length(word) + 1) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS c FROM u) GROUP BY doc_id),
b AS (SELECT l.*, cum FROM l JOIN cs USING (doc_id)),
r(doc_id, k, s, cnt) AS (
  SELECT doc_id, 0, 0::BIGINT, 0::BIGINT FROM b
  UNION ALL
  SELECT doc_id, k + 1, s2, cnt2 FROM (
    SELECT r.doc_id, r.k, b.n, r.s + CASE WHEN r.k = 0 THEN 0 ELSE greatest(1, r.cnt - least(200 // greatest(1, cc // greatest(1, r.cnt)), r.cnt // 4)) END AS s2,
           greatest(1, len(list_filter(b.cum, lambda x: x > coalesce(b.cum[s2], 0) AND x <= coalesce(b.cum[s2], 0) + b.eff))) AS cnt2
    FROM (SELECT r.*, coalesce(b0.cum[r.s + r.cnt], 0) - coalesce(b0.cum[r.s], 0) AS cc FROM r JOIN b b0 USING (doc_id)) r JOIN b USING (doc_id)) WHERE s2 < n),
c AS (SELECT doc_id, k, s, cnt, prefix || array_to_string(ws[s + 1:s + cnt], ' ') AS chunk_text FROM r JOIN b USING (doc_id) WHERE k > 0
  UNION ALL SELECT doc_id, 1, 0, len({_WORDS}), prefix || text FROM s WHERE length(text) <= 2048 - length(prefix))
"""


@query("chunk_windows", _WINDOWS_SQL + "SELECT doc_id, k, s::INTEGER AS start_word, cnt::INTEGER AS n_words, md5(chunk_text) AS chunk_id, (length(chunk_text) // 4)::INTEGER AS token_count FROM c")
def chunk_windows(spark, d):
    c = chunk_sections(table(spark, d, "documents"), ["doc_id"], heading="source")
    return c.select("doc_id", "k", "start_word", "n_words", "chunk_id", "token_count")


@query("token_counts", "SELECT chunk_no, (length(text) // 4)::INTEGER AS tokens, token_count IS NOT DISTINCT FROM (length(text) // 4)::INTEGER AS as_stored FROM chunks")
def token_counts(spark, d):
    t = T.token_estimate(F.col("text"))
    return table(spark, d, "chunks").select("chunk_no", t.alias("tokens"), F.col("token_count").eqNullSafe(t).alias("as_stored"))


@query("content_ids", "SELECT chunk_no, md5(text) AS content_id, coalesce(md5(text) = chunk_id, FALSE) AS id_fits, coalesce(md5(text) = chunk_hash, FALSE) AS hash_fits FROM chunks")
def content_ids(spark, d):
    m = T.content_id(F.col("text"))
    return table(spark, d, "chunks").select("chunk_no", m.alias("content_id"), F.coalesce(m == F.col("chunk_id"), F.lit(False)).alias("id_fits"), F.coalesce(m == F.col("chunk_hash"), F.lit(False)).alias("hash_fits"))


@query(
    "chunk_files",
    "SELECT chunk_id, service, source_url, page_title, heading, text, chunk_hash, token_count FROM chunks",
)
def chunk_files(spark, d):
    """All chunks written as chunk files and read back."""
    path = fresh_path(shared_dir(spark), "chunk-files")
    write_chunk_files(table(spark, d, "chunks"), path)
    return read_chunk_files(spark, [path, path + "-missing"])


# ---------------------------------------------------------------- duplicates, ingest bookkeeping

_LAST = "(SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY chunk_no DESC) = 1)"


@query("dedupe_keep_last", f"SELECT chunk_id, chunk_no, service, source_url, heading FROM {_LAST}")
def dedupe_keep_last(spark, d):
    return keep_last(table(spark, d, "chunks").select("chunk_id", "chunk_no", "service", "source_url", "heading"), ["chunk_id"], "chunk_no")


@query("dedupe_keep_first", "SELECT source_url, chunk_no, chunk_id FROM chunks WHERE source_url <> '' QUALIFY row_number() OVER (PARTITION BY source_url ORDER BY chunk_no) = 1")
def dedupe_keep_first(spark, d):
    return keep_first_ranked(table(spark, d, "chunks").select("source_url", "chunk_no", "chunk_id"), "source_url", "chunk_no")


@query("dedupe_stats", "SELECT count(*) AS n_rows, count(DISTINCT chunk_id) AS ids, count(*) - count(DISTINCT chunk_id) AS duplicates, count(DISTINCT text) AS texts FROM chunks")
def dedupe_stats(spark, d):
    n, ids = F.count(F.lit(1)), F.count_distinct("chunk_id")
    return table(spark, d, "chunks").agg(n.alias("n_rows"), ids.alias("ids"), (n - ids).alias("duplicates"), F.count_distinct("text").alias("texts"))


@query("text_upload", f"SELECT chunk_id, coalesce(text, '') AS text, n FROM {_LAST} JOIN (SELECT chunk_id, count(*) AS n FROM chunks GROUP BY chunk_id) USING (chunk_id)")
def text_upload(spark, d):
    """Last text per id and how many rows had the id."""
    c = table(spark, d, "chunks")
    g = c.groupBy("chunk_id").agg(F.max_by("text", "chunk_no").alias("text"), F.count(F.lit(1)).alias("n"))
    return g.withColumn("text", F.coalesce("text", F.lit("")))


def _ingested(spark, d):
    return table(spark, d, "vectors").select(F.col("key").alias("chunk_id")).distinct()


@query("ingest_pending", "SELECT chunk_no, chunk_id FROM chunks WHERE NOT EXISTS (SELECT 1 FROM vectors v WHERE v.key = chunks.chunk_id)")
def ingest_pending(spark, d):
    return table(spark, d, "chunks").select("chunk_no", "chunk_id").join(_ingested(spark, d), "chunk_id", "left_anti").select("chunk_no", "chunk_id")


@query("ingest_retry", "SELECT chunk_no, chunk_id FROM chunks WHERE EXISTS (SELECT 1 FROM failed_chunks f WHERE f.chunk_id = chunks.chunk_id)")
def ingest_retry(spark, d):
    return table(spark, d, "chunks").select("chunk_no", "chunk_id").join(table(spark, d, "failed_chunks").select("chunk_id"), "chunk_id", "left_semi").select("chunk_no", "chunk_id")


_FAILED = "(SELECT chunk_id, coalesce(message, '') AS message FROM failed_chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY updated_at DESC, coalesce(message, '') DESC) = 1)"


def _failed(spark, d):
    f = table(spark, d, "failed_chunks").select("chunk_id", F.struct("updated_at", F.coalesce("message", F.lit("")).alias("message")).alias("s"))
    return f.groupBy("chunk_id").agg(F.max("s")["message"].alias("message"))


@query("failed_by_type", f"SELECT CASE WHEN starts_with(message, 'embed:') THEN 'embed' ELSE 'put' END AS stage, count(*) AS n FROM {_FAILED} GROUP BY 1")
def failed_by_type(spark, d):
    return _failed(spark, d).groupBy(F.when(F.col("message").startswith("embed:"), "embed").otherwise("put").alias("stage")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "ingest_verify",
    f"""WITH c AS (SELECT DISTINCT chunk_id FROM chunks), v AS (SELECT DISTINCT key AS chunk_id FROM vectors), f AS {_FAILED}
    SELECT (SELECT count(*) FROM chunks) AS n_rows, count(*) AS ids, (SELECT count(*) FROM chunks) - count(*) AS duplicates, count(v.chunk_id) AS ingested,
      count(CASE WHEN v.chunk_id IS NULL AND f.chunk_id IS NOT NULL THEN 1 END) AS failed, count(CASE WHEN v.chunk_id IS NULL AND f.chunk_id IS NULL THEN 1 END) AS missing
    FROM c LEFT JOIN v USING (chunk_id) LEFT JOIN f USING (chunk_id)""",
)
def ingest_verify(spark, d):
    """Ids of the chunks by what became of them; ids ingested from elsewhere do not count."""
    c = table(spark, d, "chunks").groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n"))
    j = c.join(_ingested(spark, d).withColumn("v", F.lit(1)), "chunk_id", "left").join(_failed(spark, d).select("chunk_id", F.lit(1).alias("f")), "chunk_id", "left")
    ids = F.count(F.lit(1))
    return j.agg(
        F.sum("n").alias("n_rows"), ids.alias("ids"), (F.sum("n") - ids).alias("duplicates"), F.count("v").alias("ingested"),
        F.count_if(F.expr("v IS NULL AND f IS NOT NULL")).alias("failed"), F.count_if(F.expr("v IS NULL AND f IS NULL")).alias("missing"),
    )


@query(
    "ingest_dry_run",
    """SELECT coalesce(service, 'TOTAL') AS service, count(*) AS pending, CAST(sum(coalesce(token_count, 0)) AS BIGINT) AS tokens, count(*) // 100 + 1 AS batches
    FROM (SELECT coalesce(trim(lower(service)), '') AS service, token_count FROM chunks WHERE chunk_id NOT IN (SELECT key FROM vectors WHERE key IS NOT NULL)) GROUP BY ROLLUP (service)""",
)
def ingest_dry_run(spark, d):
    p = table(spark, d, "chunks").join(_ingested(spark, d), "chunk_id", "left_anti").select(F.coalesce(F.btrim(F.lower("service")), F.lit("")).alias("service"), "token_count")
    n = F.count(F.lit(1))
    return with_total(p, "service", pending=n, tokens=F.sum(F.coalesce("token_count", F.lit(0))), batches=F.floor(n / 100) + 1)


@query(
    "vector_records",
    f"""SELECT chunk_id AS key, to_json({{'service': service, 'source_url': source_url, 'heading': heading, 'chunk_hash': chunk_hash, 'page_title': page_title}})::VARCHAR AS metadata
    FROM {_LAST}""",
)
def vector_records(spark, d):
    """Key and metadata as they are put, last writer per key; text and token count are left out."""
    meta = ["service", "source_url", "heading", "chunk_hash", "page_title"]
    c = keep_last(table(spark, d, "chunks").select("chunk_id", "chunk_no", *meta), ["chunk_id"], "chunk_no")
    return c.select(F.col("chunk_id").alias("key"), F.to_json(F.struct(*meta), {"ignoreNullFields": "false"}).alias("metadata"))


# ---------------------------------------------------------------- the URL queue: seeding

_SEED = """seed AS (SELECT source_url AS url, arg_max(service, chunk_no) FILTER (service IS NOT NULL) AS any_service, max_by(service, chunk_no) AS service, list_sort(list(DISTINCT chunk_id)) AS chunk_ids
  FROM chunks WHERE coalesce(source_url, '') <> '' AND coalesce(chunk_id, '') <> '' AND chunk_id IN (SELECT key FROM vectors) GROUP BY source_url)"""
_NEWEST = "(SELECT max(snapshot_no) FROM url_snapshots)"
_BEFORE = f"(SELECT max(snapshot_no) FROM url_snapshots WHERE snapshot_no < {_NEWEST})"
_QUEUE = r"""queue AS (SELECT * EXCLUDE (url), url FROM (SELECT * REPLACE (regexp_replace(regexp_replace(url, '^\s+', ''), '\s+$', '') AS url) FROM url_snapshots WHERE snapshot_no = @N AND url IS NOT NULL)
  QUALIFY row_number() OVER (PARTITION BY url ORDER BY load_no DESC) = 1)"""


@query("seed_url_map", f"WITH {_SEED} SELECT url, any_service AS service, array_to_string(chunk_ids, ',') AS chunk_ids, len(chunk_ids) AS n FROM seed")
def seed_url_map(spark, d):
    m = url_map(table(spark, d, "chunks").withColumn("chunk_no", F.when(F.col("service").isNotNull(), F.col("chunk_no"))), _ingested(spark, d))
    return m.select("url", "service", F.array_join("chunk_ids", ",").alias("chunk_ids"), F.size("chunk_ids").cast("bigint").alias("n"))


def _seed(spark, d):
    return url_map(table(spark, d, "chunks"), _ingested(spark, d)).select("url", F.array_join("chunk_ids", ",").alias("ids"), F.lit("seed").alias("origin"))


def _queue_ids(spark, d):
    return latest(table(spark, d, "url_snapshots")).select("url", F.array_join(F.array_sort("chunk_ids"), ",").alias("ids"), F.lit("queue").alias("origin"))


_QUEUE_IDS = "q AS (SELECT url, array_to_string(list_sort(chunk_ids), ',') AS ids, 'queue' AS origin FROM queue), s AS (SELECT url, array_to_string(chunk_ids, ',') AS ids, 'seed' AS origin FROM seed)"


@query("seed_insert_if_absent", f"WITH {_SEED}, {_QUEUE.replace('@N', _NEWEST)}, {_QUEUE_IDS} SELECT * FROM q UNION ALL SELECT * FROM s WHERE url NOT IN (SELECT url FROM q)")
def seed_insert_if_absent(spark, d):
    return insert_if_absent(_queue_ids(spark, d), _seed(spark, d), ["url"])


@query("seed_overwrite", f"WITH {_SEED}, {_QUEUE.replace('@N', _NEWEST)}, {_QUEUE_IDS} SELECT * FROM s UNION ALL SELECT * FROM q WHERE url NOT IN (SELECT url FROM s)")
def seed_overwrite(spark, d):
    return upsert(_queue_ids(spark, d), _seed(spark, d), ["url"])


@query("seed_summary", f"WITH {_SEED}, x AS (SELECT coalesce(trim(lower(any_service)), '') AS service, len(chunk_ids) AS n FROM seed) SELECT service, count(*) AS urls, CAST(sum(n) AS BIGINT) AS ids FROM x GROUP BY service")
def seed_summary(spark, d):
    m = url_map(table(spark, d, "chunks").withColumn("chunk_no", F.when(F.col("service").isNotNull(), F.col("chunk_no"))), _ingested(spark, d))
    return m.groupBy(F.coalesce(F.btrim(F.lower("service")), F.lit("")).alias("service")).agg(F.count(F.lit(1)).alias("urls"), F.sum(F.size("chunk_ids")).alias("ids"))


@query(
    "seed_counts",
    f"""WITH {_SEED}, {_QUEUE.replace('@N', _NEWEST)}, c AS (SELECT DISTINCT chunk_id FROM chunks WHERE coalesce(source_url, '') <> '' AND coalesce(chunk_id, '') <> '')
    SELECT (SELECT count(*) FROM c WHERE chunk_id IN (SELECT key FROM vectors)) AS included, (SELECT count(*) FROM c WHERE chunk_id NOT IN (SELECT key FROM vectors WHERE key IS NOT NULL)) AS excluded,
      count(CASE WHEN url NOT IN (SELECT url FROM queue) THEN 1 END) AS written, count(CASE WHEN url IN (SELECT url FROM queue) THEN 1 END) AS skipped FROM seed""",
)
def seed_counts_query(spark, d):
    return seed_counts(table(spark, d, "chunks"), _ingested(spark, d), latest(table(spark, d, "url_snapshots")))


@query("job_seed", f"WITH {_SEED}, {_QUEUE.replace('@N', _NEWEST)} SELECT url, service, coalesce(array_to_string(list_sort(chunk_ids), ','), '-') AS ids FROM queue UNION ALL SELECT url, service, array_to_string(chunk_ids, ',') FROM seed WHERE url NOT IN (SELECT url FROM queue)")
def job_seed(spark, d):
    q = seed(table(spark, d, "chunks"), _ingested(spark, d), latest(table(spark, d, "url_snapshots")))
    return q.select("url", "service", F.coalesce(F.array_join(F.array_sort("chunk_ids"), ","), F.lit("-")).alias("ids"))


# ---------------------------------------------------------------- discovery: the last snapshot as sitemap, the one before as queue

_DISC = f"WITH {_QUEUE.replace('queue AS', 'found AS').replace('@N', _NEWEST)}, {_QUEUE.replace('@N', _BEFORE)}, st AS (SELECT coalesce(f.url, q.url) AS url, CASE WHEN q.url IS NULL THEN 'new' WHEN f.url IS NULL THEN 'removed' ELSE 'kept' END AS status FROM found f FULL JOIN queue q ON f.url = q.url)"


def _discovery(spark, d):
    s = table(spark, d, "url_snapshots")
    found, queue = latest(s), latest(s, back=1)
    return found, queue, diff(found, queue)


@query("discovery_diff", _DISC + " SELECT url, status FROM st")
def discovery_diff(spark, d):
    return _discovery(spark, d)[2]


@query(
    "discovery_stats",
    _DISC
    + " SELECT count(CASE WHEN status = 'new' THEN 1 END) AS added, count(CASE WHEN status = 'removed' THEN 1 END) AS removed, count(CASE WHEN status <> 'removed' THEN 1 END) AS total_found, count(CASE WHEN status <> 'new' THEN 1 END) AS total_queue FROM st",
)
def discovery_stats(spark, d):
    s = _discovery(spark, d)[2]
    c = lambda e: F.count_if(F.expr(e))
    return s.agg(c("status = 'new'").alias("added"), c("status = 'removed'").alias("removed"), c("status <> 'removed'").alias("total_found"), c("status <> 'new'").alias("total_queue"))


_IDS = "ids AS (SELECT url, unnest(chunk_ids) AS chunk_id FROM queue)"


@query("discovery_delete_all", _DISC + f", {_IDS} SELECT DISTINCT chunk_id FROM ids JOIN st USING (url) WHERE status = 'removed' AND chunk_id IS NOT NULL")
def discovery_delete_all(spark, d):
    """Every id of a removed URL, also those that other URLs still refer to."""
    _, queue, status = _discovery(spark, d)
    ids = queue.select("url", F.explode("chunk_ids").alias("chunk_id")).filter("chunk_id IS NOT NULL")
    return ids.join(status.filter("status = 'removed'"), "url", "left_semi").select("chunk_id").distinct()


@query(
    "discovery_delete_unreferenced",
    _DISC + f", {_IDS} SELECT DISTINCT chunk_id FROM ids JOIN st USING (url) WHERE status = 'removed' AND chunk_id IS NOT NULL AND chunk_id NOT IN (SELECT chunk_id FROM ids JOIN st USING (url) WHERE status <> 'removed' AND chunk_id IS NOT NULL)",
)
def discovery_delete_unreferenced(spark, d):
    _, queue, status = _discovery(spark, d)
    return orphaned_ids(queue, status.filter("status = 'removed'"))


@query(
    "discovery_vectors_left",
    _DISC + f", {_IDS}, gone AS (SELECT DISTINCT chunk_id FROM ids JOIN st USING (url) WHERE status = 'removed' AND chunk_id IS NOT NULL AND chunk_id NOT IN (SELECT chunk_id FROM ids JOIN st USING (url) WHERE status <> 'removed' AND chunk_id IS NOT NULL)) SELECT DISTINCT key FROM vectors WHERE key NOT IN (SELECT chunk_id FROM gone)",
)
def discovery_vectors_left(spark, d):
    _, queue, status = _discovery(spark, d)
    gone = orphaned_ids(queue, status.filter("status = 'removed'")).withColumnRenamed("chunk_id", "key")
    return delete_keys(table(spark, d, "vectors").select("key").distinct(), gone, ["key"])


@query(
    "discovery_apply",
    _DISC + " SELECT url, service, coalesce(len(chunk_ids), -1) AS n_ids, next_check FROM queue WHERE url IN (SELECT url FROM found) UNION ALL SELECT url, service, -1, '' FROM found WHERE url NOT IN (SELECT url FROM queue)",
)
def discovery_apply(spark, d):
    found, queue, status = _discovery(spark, d)
    q = apply_discovery(queue, status, found)
    return q.select("url", "service", F.coalesce(F.size("chunk_ids"), F.lit(-1)).cast("bigint").alias("n_ids"), "next_check")


@query(
    "job_discover",
    _DISC
    + f""", {_IDS}, gone AS (SELECT DISTINCT chunk_id FROM ids JOIN st USING (url) WHERE status = 'removed' AND chunk_id IS NOT NULL AND chunk_id NOT IN (SELECT chunk_id FROM ids JOIN st USING (url) WHERE status <> 'removed' AND chunk_id IS NOT NULL))
    SELECT 'url' AS kind, url AS name FROM st WHERE status <> 'removed' UNION ALL SELECT DISTINCT 'vector', key FROM vectors WHERE key NOT IN (SELECT chunk_id FROM gone)""",
)
def job_discover(spark, d):
    """Queue and vectors after a scan behind the all-or-nothing guard; no sitemap failed."""
    found, queue, _ = _discovery(spark, d)
    services = table(spark, d, "services").select("service", F.lit("").alias("error"))
    q, v = discover(found, services.filter("error <> ''"), queue, table(spark, d, "vectors").select("key").distinct())
    return q.select(F.lit("url").alias("kind"), F.col("url").alias("name")).unionByName(v.select(F.lit("vector").alias("kind"), F.col("key").alias("name")))


# ---------------------------------------------------------------- the crawl: sitemaps to chunks

_CRAWL = f"""u AS (SELECT u.service, u.url FROM {_URLS} u JOIN services s ON u.service = s.service WHERE u.url <> '' AND starts_with(u.url, s.prefix) AND ends_with(u.url, '.html')
    AND NOT regexp_matches(u.url, '/api/|-api-reference|doc-history|document-history|release-notes|release-history|/index\\.html$', 'i')
    AND NOT (u.service = 'vmfleet' AND regexp_matches(u.url, 'instance-types|instance_types|/vmfleet/.*pricing', 'i'))),
  h AS (SELECT DISTINCT url FROM fetch_results WHERE status = 200 AND html IS NOT NULL AND url IS NOT NULL)"""


def _crawled(spark, d):
    files = sitemap_files(_urls(spark, d).filter("service IS NOT NULL"))
    urls = crawl_urls(files, table(spark, d, "services"))
    f = table(spark, d, "fetch_results")
    return crawl(urls, last_pages(f.filter("fetch_no % 2 = 0")), last_pages(f))


@query("crawl_pages", f"WITH {_CRAWL} SELECT service, url, url NOT IN (SELECT url FROM h) AS failed FROM u")
def crawl_pages(spark, d):
    return _crawled(spark, d)[0].select("service", "url", (F.col("outcome") == "error").alias("failed"))


@query("job_crawl", f"WITH {_CRAWL} SELECT service, count(*) AS total, count(CASE WHEN url NOT IN (SELECT url FROM h) THEN 1 END) AS errors, count(CASE WHEN url IN (SELECT url FROM h) THEN 1 END) AS read FROM u GROUP BY service")
def job_crawl(spark, d):
    c = crawl_counts(_crawled(spark, d)[0])
    return c.select("service", "total", "errors", (F.col("processed") + F.col("skipped")).alias("read"))


@query("crawl_chunks")
def crawl_chunks(spark, d):
    return _crawled(spark, d)[1]


# ---------------------------------------------------------------- refresh

_NOW = "2031-03-04T00:00:00+00:00"


@query(
    "overdue_per_service",
    f"WITH {_QUEUE.replace('@N', _NEWEST)} SELECT service, url, next_check FROM queue WHERE next_check <= '{_NOW}' AND next_check <> '' QUALIFY row_number() OVER (PARTITION BY service ORDER BY next_check, url) <= 50",
)
def overdue_per_service_query(spark, d):
    return overdue_per_service(latest(table(spark, d, "url_snapshots")).select("service", "url", "next_check"), _NOW, 50)


@query("overdue_global", f"WITH {_QUEUE.replace('@N', _NEWEST)} SELECT service, url, next_check FROM queue WHERE next_check <= '{_NOW}' AND next_check <> '' ORDER BY next_check, url LIMIT 50")
def overdue_global(spark, d):
    return overdue(latest(table(spark, d, "url_snapshots")).select("service", "url", "next_check"), _NOW, 50)


_LASTF = "lastf AS (SELECT * FROM fetch_results WHERE url IS NOT NULL QUALIFY row_number() OVER (PARTITION BY url ORDER BY fetch_no DESC) = 1)"
_OUTCOME = "CASE status WHEN 200 THEN 'changed' WHEN 304 THEN 'unchanged' WHEN 0 THEN 'error' ELSE 'skipped' END"


@query("refresh_outcome", f"SELECT {_OUTCOME} AS outcome, count(*) AS n, count(DISTINCT url) AS urls FROM fetch_results GROUP BY 1")
def refresh_outcome(spark, d):
    return table(spark, d, "fetch_results").groupBy(outcome(F.col("status")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("url").alias("urls"))


_CIDS = "new AS (SELECT source_url AS url, list_sort(list(DISTINCT chunk_id)) AS ids FROM chunks WHERE source_url IS NOT NULL AND text IS NOT NULL GROUP BY source_url)"


def _fetched(spark, d):
    """Last fetch per URL with the ids of the chunks scraped from it."""
    last = keep_last(table(spark, d, "fetch_results").filter("url IS NOT NULL").select("url", "fetch_no", "status", "last_modified", "etag"), ["url"], "fetch_no")
    ids = table(spark, d, "chunks").filter("source_url IS NOT NULL AND text IS NOT NULL").groupBy(F.col("source_url").alias("url")).agg(F.array_sort(F.collect_set("chunk_id")).alias("chunk_ids"))
    return last.join(ids, "url", "left")


@query(
    "refresh_apply",
    f"""WITH {_QUEUE.replace('@N', _NEWEST)}, {_LASTF}, {_CIDS}
    SELECT q.url, q.service, coalesce(array_to_string(CASE WHEN f.status = 200 THEN n.ids ELSE q.chunk_ids END, ','), '-') AS chunk_ids,
      CASE WHEN f.url IS NULL OR f.status = 0 THEN q.next_check ELSE '2031-04-08T00:00:00+00:00' END AS next_check,
      CASE WHEN f.url IS NULL OR f.status = 0 THEN q.last_checked ELSE '2031-03-04T00:00:00+00:00' END AS last_checked,
      CASE WHEN f.status = 200 THEN f.last_modified ELSE q.last_modified END AS last_modified, CASE WHEN f.status = 200 THEN f.etag ELSE q.etag END AS etag
    FROM queue q LEFT JOIN lastf f ON q.url = f.url LEFT JOIN new n ON q.url = n.url""",
)
def refresh_apply(spark, d):
    now = F.lit("2031-03-04 00:00:00").cast("timestamp_ntz")
    q = apply_refresh(latest(table(spark, d, "url_snapshots")), _fetched(spark, d), now)
    return q.withColumn("chunk_ids", F.coalesce(F.array_join("chunk_ids", ","), F.lit("-")))


@query(
    "refresh_chunk_diff",
    f"""WITH {_QUEUE.replace('@N', _NEWEST)}, {_LASTF}, {_CIDS}, o AS (SELECT url, chunk_ids AS ids FROM queue), x AS (SELECT n.url, n.ids FROM new n JOIN lastf f USING (url) WHERE f.status = 200)
    SELECT x.url, array_to_string(list_sort(list_distinct(list_filter(coalesce(o.ids, []), lambda i: NOT list_contains(x.ids, i)))), ',') AS stale,
      array_to_string(list_sort(list_filter(x.ids, lambda i: NOT list_contains(coalesce(o.ids, []), i))), ',') AS added FROM x LEFT JOIN o USING (url)""",
)
def refresh_chunk_diff(spark, d):
    new = _fetched(spark, d).filter("status = 200 AND chunk_ids IS NOT NULL").select("url", "chunk_ids")
    old = latest(table(spark, d, "url_snapshots")).join(new.select("url"), "url", "left_semi")
    return page_diff(old, new).select("url", F.array_join("stale", ",").alias("stale"), F.array_join("added", ",").alias("added"))


@query(
    "read_through_cache",
    f"""WITH {_QUEUE.replace('@N', _NEWEST)}, ok AS (SELECT url, html FROM fetch_results WHERE status = 200 AND html IS NOT NULL AND url IS NOT NULL AND fetch_no % 2 = 0 QUALIFY row_number() OVER (PARTITION BY url ORDER BY fetch_no DESC) = 1),
    late AS (SELECT url, html FROM fetch_results WHERE status = 200 AND html IS NOT NULL AND url IS NOT NULL AND fetch_no % 2 = 1 QUALIFY row_number() OVER (PARTITION BY url ORDER BY fetch_no DESC) = 1)
    SELECT q.url, CASE WHEN ok.html IS NOT NULL THEN 'cache' WHEN late.html IS NOT NULL THEN 'fetch' ELSE 'none' END AS origin, md5(coalesce(ok.html, late.html)) AS page FROM queue q LEFT JOIN ok USING (url) LEFT JOIN late USING (url)""",
)
def read_through_cache(spark, d):
    """Fetches with even numbers stand for the cache, odd ones for the network."""
    f = table(spark, d, "fetch_results")
    r = read_through(latest(table(spark, d, "url_snapshots")), last_pages(f.filter("fetch_no % 2 = 0")), last_pages(f.filter("fetch_no % 2 = 1")))
    return r.select("url", "origin", F.md5("html").alias("page"))


@query(
    "crawl_dry_run",
    f"""WITH {_QUEUE.replace('@N', _NEWEST)}, c AS (SELECT DISTINCT url FROM fetch_results WHERE status = 200 AND html IS NOT NULL),
    g AS (SELECT CASE WHEN grouping(service) = 1 THEN 'TOTAL' ELSE service END AS service, count(*) AS pages, count(c.url) AS cached, (count(*) - count(c.url)) * 4 AS seconds FROM (SELECT coalesce(service, '') AS service, url FROM queue) q LEFT JOIN c USING (url) GROUP BY ROLLUP (service))
    SELECT *, CASE WHEN seconds >= 3600 THEN (seconds // 3600) || 'h ' || ((seconds % 3600) // 60) || 'm' WHEN seconds >= 60 THEN (seconds // 60) || 'm' ELSE seconds || 's' END AS duration FROM g""",
)
def crawl_dry_run(spark, d):
    q = latest(table(spark, d, "url_snapshots")).select("url", F.coalesce("service", F.lit("")).alias("service"))
    c = last_pages(table(spark, d, "fetch_results")).select("url", F.lit(1).alias("c"))
    n, have = F.count(F.lit(1)), F.count("c")
    return with_total(q.join(c, "url", "left"), "service", pages=n, cached=have, seconds=(n - have) * 4).withColumn("duration", T.duration(F.col("seconds")))


@query(
    "error_runs",
    """WITH e AS (SELECT url, fetch_no, status NOT IN (200, 304) AS bad FROM fetch_results WHERE url IS NOT NULL),
    i AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY fetch_no) - row_number() OVER (PARTITION BY url, bad ORDER BY fetch_no) AS g FROM e)
    SELECT url, min(fetch_no) AS first, max(fetch_no) AS last, count(*) AS length FROM i WHERE bad GROUP BY url, g HAVING count(*) >= 2""",
)
def error_runs(spark, d):
    f = table(spark, d, "fetch_results").filter("url IS NOT NULL").select("url", "fetch_no", (~F.col("status").isin(200, 304)).alias("bad"))
    return runs_of(f, "bad", ["url"], "fetch_no", 2)


@query(
    "event_error_runs",
    """WITH e AS (SELECT user_id, event_id, event_type = 'error' AS bad FROM events),
    i AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, bad ORDER BY event_id) AS g FROM e)
    SELECT user_id, min(event_id) AS first, max(event_id) AS last, count(*) AS length FROM i WHERE bad GROUP BY user_id, g HAVING count(*) >= 3""",
)
def event_error_runs(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", (F.col("event_type") == "error").alias("bad"))
    return runs_of(e, "bad", ["user_id"], "event_id", 3)


# ---------------------------------------------------------------- questions and retrieval

_QSQL = r"""
WITH q AS (SELECT event_no, CASE WHEN json_valid(body) THEN body::JSON END AS top FROM questions),
w AS (SELECT event_no, top, coalesce(json_type(top) = 'OBJECT', FALSE) AS obj,
      CASE WHEN coalesce(json_exists(top, '$.body'), FALSE) THEN coalesce(nullif(json_extract_string(top, '$.body'), ''), '{}') ELSE top::VARCHAR END AS inner_text FROM q),
n AS (SELECT event_no, top, obj, CASE WHEN json_valid(inner_text) THEN inner_text::JSON END AS j FROM w),
x AS (SELECT event_no, obj, coalesce(json_extract_string(top, '$.httpMethod') = 'OPTIONS', FALSE) AS opt, coalesce(json_type(j) = 'OBJECT', FALSE) AS ok,
      coalesce(json_type(j, '$.question'), '') AS qt, coalesce(json_type(j, '$.service'), '') AS st,
      regexp_replace(regexp_replace(coalesce(json_extract_string(j, '$.question'), ''), '^\s+', ''), '\s+$', '') AS question,
      trim(lower(coalesce(json_extract_string(j, '$.service'), 'all'))) AS service FROM n),
v AS (SELECT event_no, question, service, CASE WHEN NOT obj THEN 'invalid' WHEN opt THEN 'options' WHEN NOT ok OR qt NOT IN ('', 'VARCHAR') OR st NOT IN ('', 'VARCHAR') THEN 'invalid'
      WHEN question = '' THEN 'missing' WHEN length(question) > 2000 THEN 'too_long' ELSE 'ok' END AS outcome FROM x)
"""


@query(
    "question_validate",
    _QSQL + "SELECT event_no, outcome, CASE WHEN outcome = 'ok' THEN question END AS question, CASE WHEN outcome = 'ok' AND service IN (SELECT service FROM services) THEN service END AS service_filter FROM v",
)
def question_validate(spark, d):
    return validated(table(spark, d, "questions").select("event_no", "body"), services=table(spark, d, "services")).select("event_no", "outcome", "question", "service_filter")


@query("question_outcomes", _QSQL + "SELECT outcome, count(*) AS n FROM v GROUP BY outcome")
def question_outcomes(spark, d):
    return validated(table(spark, d, "questions").select("event_no", "body")).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def _question_vectors(spark, d, label: str | None):
    """Stored vectors with ids divisible by 50 as questions; ``label`` is what they filter on."""
    e = table(spark, d, "embeddings").filter("vec_id % 50 = 0")
    return e.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"), (F.expr(label) if label else F.lit(None)).cast("int").alias("qlabel"))


def _hits(spark, d, k: int, label: str | None = None):
    return top_k(table(spark, d, "embeddings"), _question_vectors(spark, d, label), k, "vec_id", "embedding", "label")


def _topk_sql(where: str, k: int) -> str:
    return f"""h AS (SELECT q.vec_id AS qid, e.vec_id AS key, e.label, 1 - list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS distance,
      row_number() OVER (PARTITION BY q.vec_id ORDER BY 1 - list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), e.vec_id) AS rank
      FROM (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q JOIN embeddings e ON {where} QUALIFY rank <= {k})"""


@query("retrieve_top_k", f"WITH {_topk_sql('TRUE', 10)} SELECT qid, key, rank::INTEGER AS rank, round(distance, 6) AS distance FROM h WHERE key <> qid")
def retrieve_top_k(spark, d):
    return _hits(spark, d, 10).filter("key <> qid").select("qid", "key", "rank", F.round("distance", 6).alias("distance"))


@query("retrieve_filtered", f"WITH {_topk_sql('e.label = q.label', 10)} SELECT qid, key, rank::INTEGER AS rank, round(distance, 6) AS distance FROM h WHERE key <> qid")
def retrieve_filtered(spark, d):
    return _hits(spark, d, 10, "label").filter("key <> qid").select("qid", "key", "rank", F.round("distance", 6).alias("distance"))


@query("retrieve_unknown_label", f"WITH {_topk_sql('TRUE', 5)} SELECT qid, key, rank::INTEGER AS rank FROM h WHERE key <> qid")
def retrieve_unknown_label(spark, d):
    """A filter value that no service has searches everything."""
    return _hits(spark, d, 5, "CASE WHEN label + 1000 IN (0, 1, 2, 3, 4, 5, 6, 7, 8, 9) THEN label + 1000 END").filter("key <> qid").select("qid", "key", "rank")


_DOCS = "(SELECT doc_id AS key, text, source AS service, 'doc ' || doc_id AS heading, 'doc://' || source || '/' || (doc_id % 20) AS source_url FROM documents)"


def _docs(spark, d):
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("key"), "text", F.col("source").alias("service"), F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("heading"),
        F.concat(F.lit("doc://"), F.col("source"), F.lit("/"), (F.col("doc_id") % 20).cast("string")).alias("source_url"),
    )


def _hits_with_text(spark, d, k: int):
    hits, docs = _hits(spark, d, k).filter("key <> qid"), _docs(spark, d)
    return with_text(hits, docs).join(docs.drop("text"), "key", "left")


@query(
    "retrieve_context",
    f"""WITH {_topk_sql('TRUE', 10)}, b AS (SELECT qid, rank, '[Source ' || rank || '] ' || upper(coalesce(service, '')) || ' — ' || coalesce(heading, '') || chr(10) || 'URL: ' || coalesce(source_url, '') || chr(10) || chr(10)
      || regexp_replace(regexp_replace(text, '^[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+', ''), '[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+$', '') AS block
      FROM h JOIN {_DOCS} t USING (key) WHERE key <> qid AND regexp_replace(text, '[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+', '', 'g') <> '')
    SELECT qid, md5(string_agg(block, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank)) AS context, count(*)::INTEGER AS n_blocks FROM b GROUP BY qid""",
)
def retrieve_context(spark, d):
    c = context(_hits_with_text(spark, d, 10))
    return c.select("qid", F.md5("context").alias("context"), "n_blocks")


@query(
    "retrieve_sources",
    f"""WITH {_topk_sql('TRUE', 10)}, f AS (SELECT qid, rank, service, heading, source_url, distance FROM h JOIN {_DOCS} t USING (key) WHERE key <> qid QUALIFY row_number() OVER (PARTITION BY qid, source_url ORDER BY rank) = 1)
    SELECT qid, (row_number() OVER (PARTITION BY qid ORDER BY rank))::INTEGER AS n, rank::INTEGER AS rank, service, heading, source_url, round(distance, 4) AS distance, round(1 - distance, 4) AS similarity FROM f""",
)
def retrieve_sources(spark, d):
    return sources(_hits_with_text(spark, d, 10))


@query(
    "retrieve_responses",
    f"""WITH {_topk_sql('TRUE', 10)}, f AS (SELECT qid, rank, service, heading, source_url, distance FROM h JOIN {_DOCS} t USING (key) WHERE key <> qid QUALIFY row_number() OVER (PARTITION BY qid, source_url ORDER BY rank) = 1),
    s AS (SELECT qid, string_agg(source_url || '#' || rank, ' ' ORDER BY rank) AS sources FROM f GROUP BY qid),
    t AS (SELECT DISTINCT qid FROM h JOIN {_DOCS} t USING (key) WHERE key <> qid AND regexp_replace(text, '[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+', '', 'g') <> '')
    SELECT vec_id AS qid, CASE WHEN t.qid IS NULL THEN '{NO_TEXT}' ELSE 'echo' END AS answer, coalesce(sources, '') AS sources
    FROM (SELECT vec_id FROM embeddings WHERE vec_id % 50 = 0) q LEFT JOIN s ON s.qid = q.vec_id LEFT JOIN t ON t.qid = q.vec_id""",
)
def retrieve_responses(spark, d):
    """Whole answers with a generator that always says the same, read back from their JSON."""
    hits = _hits_with_text(spark, d, 10)
    asked = _question_vectors(spark, d, None).select("qid")
    ready = asked.join(context(hits), "qid", "left").join(hits.groupBy("qid").agg(F.count(F.lit(1)).alias("n_hits")), "qid", "left")
    ready = ready.select("qid", F.coalesce("n_hits", F.lit(0)).alias("n_hits"), prompt(F.col("context"), F.lit("What is near?")).alias("prompt"))
    body = responses(answered(ready, lambda p, n: "echo"), sources(hits))
    j = F.from_json("body", "answer string, sources array<struct<source_url string, rank int>>")
    return body.select("qid", j.alias("j")).select("qid", "j.answer", F.array_join(F.transform("j.sources", lambda x: F.concat(x["source_url"], F.lit("#"), x["rank"].cast("string"))), " ").alias("sources"))


@query(
    "progress_files",
    f"""SELECT chunk_id, 'ingested' AS state, '' AS message FROM (SELECT DISTINCT key AS chunk_id FROM vectors WHERE key IS NOT NULL)
    UNION ALL SELECT chunk_id, CASE WHEN starts_with(message, 'embed:') THEN 'embed' ELSE 'put' END, message FROM {_FAILED} WHERE chunk_id IS NOT NULL""",
)
def progress_files(spark, d):
    """Progress and failures written as files and read back."""
    path = fresh_path(shared_dir(spark), "progress")
    write_progress(_ingested(spark, d), path + "/done", _NOW)
    write_failed(_failed(spark, d), path + "/failed", _NOW)
    done = read_progress(spark, path + "/done").unionByName(read_progress(spark, path + "/missing"))
    return done.select("chunk_id", F.lit("ingested").alias("state"), F.lit("").alias("message")).unionByName(read_failed(spark, path + "/failed").withColumnRenamed("stage", "state"))


# ---------------------------------------------------------------- streaming

_STATE = f"SELECT url, fetch_no, {_OUTCOME} AS outcome, etag FROM fetch_results WHERE url IS NOT NULL AND status <> 0 QUALIFY row_number() OVER (PARTITION BY url ORDER BY fetch_no DESC) = 1"


@query("stream_refresh_state", _STATE)
def stream_refresh_state(spark, d):
    base = fresh_path(shared_dir(spark), "stream")
    state = VersionedTable(spark, base + "/state")
    run_refresh(read_fetches(spark, _as_directory(spark, d, "fetch_results")), state, base + "/checkpoint")
    return state.read()


def _as_directory(spark, d, name):
    """A table in one file is read through its folder and name, a table of many files through its own folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/{name}.parquet")
    return str(path) if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory() else f"{d}/{name}.parque[t]"
