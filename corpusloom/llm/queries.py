"""Registered queries of the llm subpackage, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .copies import collapsed, copies
from .leaks import leaks
from .lines import line_steps, repeated_lines, without_lines
from .lookalikes import consistent_texts, lookalike_classes, lookalike_pairs
from .mainbody import page_bodies, surrounding_lines
from .pack import CAPACITY, pack, token_count
from .split import LIMIT, split_long, split_texts
from .vectors import current_vectors, similar_pairs, similar_vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


# ---------------------------------------------------------------- problem 2: lines repeated within one service

_LINES_SQL = r"""
WITH l AS (
  SELECT chunk_no, svc, page, i AS line_no, trim(regexp_replace(lower(line), '\s+', ' ', 'g')) AS line FROM (
    SELECT chunk_no, lower(regexp_replace(regexp_replace(service, '^\s+', ''), '\s+$', '')) AS svc,
           split_part(split_part(source_url, '?', 1), '#', 1) AS page,
           unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
    FROM chunks WHERE service IS NOT NULL AND source_url IS NOT NULL AND text IS NOT NULL)),
k AS (SELECT * FROM l WHERE line_no > 1 AND line <> ''),
r AS (SELECT svc, line FROM k GROUP BY svc, line HAVING count(DISTINCT page) >= 8)
"""


@query("p2_found", _LINES_SQL + "SELECT chunk_no, line_no::BIGINT AS line_no FROM k SEMI JOIN r USING (svc, line)")
def p2_found(spark, d):
    return repeated_lines(table(spark, d, "chunks")).select(F.col("id").alias("chunk_no"), "line_no")


@query(
    "p2_cleaned",
    _LINES_SQL
    + """, b AS (SELECT chunk_no, list(line_no) AS bad FROM k SEMI JOIN r USING (svc, line) GROUP BY chunk_no)
SELECT chunk_no, CASE WHEN bad IS NULL THEN text ELSE array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: NOT list_contains(bad, i)), chr(10)) END AS text
FROM chunks LEFT JOIN b USING (chunk_no)""",
)
def p2_cleaned(spark, d):
    chunks = table(spark, d, "chunks")
    return without_lines(chunks.select("chunk_no", "text"), repeated_lines(chunks))


@query("p2_steps")
def p2_steps(spark, d):
    return line_steps(table(spark, d, "chunks")).withColumnRenamed("svc", "service")


# ---------------------------------------------------------------- problem 5: copies that differ in formatting

_COPIES_SQL = r"""
WITH t AS (
  SELECT chunk_no, text, translate(regexp_replace(lower(text), '[^\p{L}\p{N}]+', '', 'g'), 'ς', 'σ') AS plain,
         regexp_replace(chr(10) || text, '(?s)^(.*?)\n[^\S\n]*\n.*$', '\1') AS head,
         CASE WHEN regexp_matches(chr(10) || text, '\n[^\S\n]*\n')
              THEN list_filter(list_transform(regexp_split_to_array(regexp_replace(chr(10) || text, '(?s)^.*?\n[^\S\n]*\n', ''), '[\n;|]'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') END AS f
  FROM chunks WHERE text IS NOT NULL),
k AS (
  SELECT chunk_no, plain, CASE WHEN len(f) >= 2 AND len(list_filter(f, lambda x: NOT regexp_matches(x, '^[^:=]*[\p{L}\p{N}][^:=]*[:=].*[\p{L}\p{N}]'))) = 0
    THEN translate(regexp_replace(lower(head), '[^\p{L}\p{N}]+', '', 'g'), 'ς', 'σ') || '/' || array_to_string(list_sort(list_transform(f, lambda x: translate(regexp_replace(lower(x), '[^\p{L}\p{N}]+', '', 'g'), 'ς', 'σ'))), '/') END AS ordered
  FROM t WHERE plain <> ''),
g AS (SELECT chunk_no, coalesce(max(ordered) OVER (PARTITION BY plain), plain) AS cls FROM k),
m AS (SELECT chunk_no, min(chunk_no) OVER (PARTITION BY cls) AS rep, count(*) OVER (PARTITION BY cls) AS n FROM g)
"""


@query("p5_found", _COPIES_SQL + "SELECT rep AS chunk_no_a, chunk_no AS chunk_no_b FROM m WHERE chunk_no <> rep")
def p5_found(spark, d):
    c = copies(table(spark, d, "chunks"))
    return c.filter("id <> rep").select(F.col("rep").alias("chunk_no_a"), F.col("id").alias("chunk_no_b"))


@query("p5_records", _COPIES_SQL + "SELECT rep AS chunk_no, any_value(n) AS n_copies FROM m GROUP BY rep")
def p5_records(spark, d):
    return collapsed(table(spark, d, "chunks")).select(F.col("id").alias("chunk_no"), "n_copies")


# ---------------------------------------------------------------- problem 1: most similar vectors for every vector

_VECTORS_SQL = """
WITH cur AS (SELECT key, data.float32::DOUBLE[] AS v FROM vectors WHERE key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY key ORDER BY put_no DESC) = 1),
good AS (SELECT key, v FROM cur WHERE len(v) = 64 AND len(list_filter(v, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
top AS (SELECT a.key, b.key AS other FROM good a JOIN good b ON a.key <> b.key
        QUALIFY row_number() OVER (PARTITION BY a.key ORDER BY list_cosine_similarity(a.v, b.v) DESC, b.key) <= 5)
"""


@query("p1_found", _VECTORS_SQL + "SELECT DISTINCT least(key, other) AS key_a, greatest(key, other) AS key_b FROM top")
def p1_found(spark, d):
    return similar_pairs(similar_vectors(current_vectors(table(spark, d, "vectors"))))


@query("p1_neighbours")
def p1_neighbours(spark, d):
    return similar_vectors(current_vectors(table(spark, d, "vectors"))).withColumn("similarity", F.round("similarity", 6))


# ---------------------------------------------------------------- problem 6: oversized texts cut at natural boundaries


@query("p6_found", "SELECT chunk_no FROM chunks WHERE length(text) > 2048")
def p6_found(spark, d):
    return split_long(table(spark, d, "chunks")).filter("piece_no = 2").select(F.col("id").alias("chunk_no"))


@query("p6_pieces")
def p6_pieces(spark, d):
    return split_texts(table(spark, d, "chunks")).withColumnRenamed("id", "chunk_no")


@query(
    "p6_kept",
    "SELECT chunk_no, length(text)::BIGINT AS covered, TRUE AS within_limit FROM chunks WHERE text IS NOT NULL",
)
def p6_kept(spark, d):
    """How many characters of each text its pieces cover, the prefix and overlaps counted once: as many as it has.

    Null where the pieces put together are not the text.
    """
    chunks = table(spark, d, "chunks")
    p = split_texts(chunks).withColumnRenamed("id", "chunk_no")
    g = p.groupBy("chunk_no").agg(F.array_sort(F.collect_list(F.struct("piece_no", "piece", "body_start", "body_end"))).alias("p"), F.bool_and(F.length("piece") <= LIMIT).alias("within_limit"))
    # Of each piece after the first, what lies beyond the end of the one before it.
    new = F.expr("transform(p, (x, i) -> CASE WHEN i = 0 THEN x.piece ELSE right(x.piece, cast(x.body_end - greatest(x.body_start, p[i - 1].body_end) AS int)) END)")
    whole = g.select("chunk_no", F.array_join(new, "").alias("whole"), "within_limit").select("chunk_no", F.length("whole").cast("bigint").alias("n"), F.md5("whole").alias("got"), "within_limit")
    texts = chunks.filter("text IS NOT NULL").select("chunk_no", F.md5("text").alias("want"))
    return texts.join(whole, "chunk_no", "left").select("chunk_no", F.when(F.col("got") == F.col("want"), F.col("n")).alias("covered"), "within_limit")


@query(
    "p6_joints",
    r"""SELECT chunk_no, least(1792, CASE WHEN starts_with(text, coalesce(heading, '') || chr(10) || chr(10)) THEN length(coalesce(heading, '')) + 2
      ELSE length(regexp_extract(text, '^[^\n]*\n[^\S\n]*\n')) END)::BIGINT AS prefix_chars, TRUE AS prefixed, TRUE AS joined, TRUE AS within_overlap
    FROM chunks WHERE length(text) > 2048""",
)
def p6_joints(spark, d):
    """Of each row that is cut: the length of its prefix, whether all pieces start with it and how neighbours meet."""
    p = split_long(table(spark, d, "chunks"))
    g = p.groupBy(F.col("id").alias("chunk_no")).agg(F.array_sort(F.collect_list(F.struct("piece_no", "piece", "body_start", "body_end"))).alias("p"))
    g = g.withColumn("n", F.expr("p[0].body_start")).withColumn("head", F.expr("left(p[0].piece, cast(n AS int))"))
    pairs = "transform(sequence(1, size(p) - 1), i -> {})"
    return g.select(
        "chunk_no",
        F.col("n").alias("prefix_chars"),
        F.expr("forall(p, x -> startswith(x.piece, head))").alias("prefixed"),
        F.expr(f"forall({pairs.format('p[i].body_start <= p[i-1].body_end AND p[i].body_start > p[i-1].body_start AND p[i].body_end > p[i-1].body_end')}, x -> x)").alias("joined"),
        F.expr(f"forall({pairs.format('p[i-1].body_end - p[i].body_start <= 200')}, x -> x)").alias("within_overlap"),
    )


# ---------------------------------------------------------------- problem 7: packing into containers

_TOKENS_SQL = r"len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x0b\x1c-\x1f\x85\p{Z}]+'))"


@query("p7_found", f"SELECT doc_id FROM documents WHERE {_TOKENS_SQL} > 2048")
def p7_found(spark, d):
    return pack(table(spark, d, "documents")).filter("part_no = 2").select(F.col("id").alias("doc_id"))


@query("p7_containers")
def p7_containers(spark, d):
    return pack(table(spark, d, "documents")).select(F.col("id").alias("doc_id"), "part_no", "container", "first_token", "n_tokens")


@query("p7_placed", f"SELECT doc_id, {_TOKENS_SQL}::BIGINT AS n_tokens, greatest(1, ceil({_TOKENS_SQL} / 2048))::BIGINT AS parts, FALSE AS overfull FROM documents")
def p7_placed(spark, d):
    """Every document's tokens and parts as packed, and whether a container of its is over the capacity."""
    p = pack(table(spark, d, "documents"))
    full = p.groupBy("container").agg(F.sum("n_tokens").alias("fill")).filter(F.col("fill") > CAPACITY).select("container", F.lit(True).alias("over"))
    g = p.join(full, "container", "left").groupBy(F.col("id").alias("doc_id"))
    return g.agg(F.sum("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("parts"), F.coalesce(F.bool_or("over"), F.lit(False)).alias("overfull"))


@query("p7_token_counts", f"SELECT doc_id, {_TOKENS_SQL}::BIGINT AS n FROM documents")
def p7_token_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", token_count(F.col("text")).alias("n"))


# ---------------------------------------------------------------- problem 8: evaluation passages in documents

_LEAKS_SQL = r"""
WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
iw AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM eval_items WHERE text IS NOT NULL),
ig AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS g
       FROM (SELECT *, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS i FROM iw WHERE len(w) > 0)),
dg AS (SELECT DISTINCT doc_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM dw CROSS JOIN (SELECT DISTINCT n FROM ig) WHERE len(w) >= n))
"""


@query("p8_found", _LEAKS_SQL + "SELECT DISTINCT item_id, doc_id FROM ig JOIN dg USING (n, g)")
def p8_found(spark, d):
    r = leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return r.filter("exact").select(F.col("item").alias("item_id"), F.col("doc").alias("doc_id"))


@query("p8_leaks")
def p8_leaks(spark, d):
    r = leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return r.select(F.col("item").alias("item_id"), F.col("doc").alias("doc_id"), "words", "longest", "covered", "exact")


# ---------------------------------------------------------------- problem 9: look-alike characters

# The listed letters, the code points that NFKC of single characters keeps as drawn, and NFC; enough for the test data.
_FORM_SQL = r"""nfc_normalize(translate(regexp_replace(replace(replace(replace(replace(replace(
  nfc_normalize(regexp_replace(text, '[\x{AD}\x{200B}-\x{200F}\x{2060}-\x{2064}\x{FEFF}]', '', 'g')),
  'ﬃ', 'ffi'), 'ﬄ', 'ffl'), 'ﬀ', 'ff'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), '[\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]', ' ', 'g'),
  'АВЕКМНОРСТХЅІЈаеорсухѕіјΑΒΕΖΗΙΚΜΝΟΡΤΥΧοK‐‑ёЁ' || FULL, 'ABEKMHOPCTXSIJaeopcyxsijABEZHIKMNOPTYXoK--ëË' || HALF))"""


def _form_sql() -> str:
    full = "".join(chr(o) for o in range(0xFF01, 0xFF5F))
    half = "".join(chr(o - 0xFEE0) for o in range(0xFF01, 0xFF5F))
    return _FORM_SQL.replace("FULL", f"'{full}'").replace("HALF", "'" + half.replace("'", "''") + "'")


@query(
    "p9_found",
    f"WITH f AS (SELECT doc_id, text, {_form_sql()} AS form FROM documents WHERE trim(regexp_replace(text, '\\s+', ' ', 'g')) <> '') "
    "SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM f a JOIN f b ON a.form = b.form AND a.text <> b.text AND a.doc_id < b.doc_id",
)
def p9_found(spark, d):
    return lookalike_pairs(table(spark, d, "documents")).select(F.col("doc_a").alias("doc_id_a"), F.col("doc_b").alias("doc_id_b"))


@query(
    "p9_classes",
    f"WITH f AS (SELECT doc_id, text, {_form_sql()} AS form FROM documents WHERE trim(regexp_replace(text, '\\s+', ' ', 'g')) <> ''), "
    "c AS (SELECT form, min(doc_id) AS class_id, count(DISTINCT text) AS spellings FROM f GROUP BY form) SELECT doc_id, class_id, spellings FROM f JOIN c USING (form)",
)
def p9_classes(spark, d):
    return lookalike_classes(table(spark, d, "documents")).withColumnRenamed("id", "doc_id")


@query("p9_texts")
def p9_texts(spark, d):
    return consistent_texts(table(spark, d, "documents")).select(F.col("id").alias("doc_id"), F.col("form").alias("text"))


# ---------------------------------------------------------------- problem 4: main body of a page


@query("p4_found")
def p4_found(spark, d):
    return surrounding_lines(table(spark, d, "chunks"), table(spark, d, "fetch_results")).select(F.col("id").alias("chunk_no"), "line_no")


@query("p4_main")
def p4_main(spark, d):
    chunks = table(spark, d, "chunks")
    return without_lines(chunks.select("chunk_no", "text"), surrounding_lines(chunks, table(spark, d, "fetch_results")))


@query("p4_pages")
def p4_pages(spark, d):
    return page_bodies(table(spark, d, "fetch_results")).withColumnRenamed("id", "fetch_no")
