"""Records that differ in formatting only: case, white space, punctuation and the order of ``name: value`` fields.

A text's letters and digits, lower-cased, are hashed to 128 bits; a text whose body is a list of two or more fields is
also hashed with its fields sorted. Equal hashes of either kind join records; the few field hashes that tie several
plain hashes together are resolved on the distinct hashes, not on the records.

Defined results
  * null and blank texts are left out, and so is a text without any letter or digit;
  * the same text in several rows is as many copies; empty tables give empty results; other columns are ignored;
  * final and medial sigma are one letter, as they differ by position only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import materialise

_DROP = r"[^\p{L}\p{N}]+"
_BLANK_LINE = r"\n[^\S\n]*\n"
_FIELD = r"(?s)^[^:=]*[\p{L}\p{N}][^:=]*[:=].*[\p{L}\p{N}].*$"


def canonical(c: Column) -> Column:
    return F.translate(F.regexp_replace(F.lower(c), _DROP, ""), "ς", "σ")


def fields_of(text: Column) -> Column:
    """The fields that make up everything after the first empty line, or null if it holds anything else."""
    body = F.split(F.concat(F.lit("\n"), text), _BLANK_LINE, 2)
    pieces = F.filter(F.transform(F.split(F.get(body, F.lit(1)), r"[\n;|]"), T.squash), lambda x: x != "")
    return F.when((F.size(pieces) >= 2) & F.forall(pieces, lambda x: x.rlike(_FIELD)), pieces)


def _hash(c: Column) -> Column:
    """128 bits, then 64 bits of another family and the length: records that collide on the first stay apart."""
    return F.concat(F.unhex(F.md5(c)), F.unhex(F.lpad(F.hex(F.xxhash64(c)), 16, "0")), F.unhex(F.lpad(F.hex(F.length(c)), 8, "0")))


def keyed(df: DataFrame, id_col: str = "chunk_no", text: str = "text") -> DataFrame:
    """id, plain (hash of letters and digits), ordered (hash with sorted fields, null without fields)."""
    t = df.select(F.col(id_col).alias("id"), F.col(text).alias("t")).withColumn("c", canonical(F.col("t"))).filter("c <> ''")
    t = t.withColumn("f", F.when(F.col("t").rlike("[:=]"), fields_of(F.col("t"))))
    head = F.element_at(F.split(F.concat(F.lit("\n"), F.col("t")), _BLANK_LINE, 2), 1)
    ordered = F.concat_ws("\x1f", canonical(head), F.array_join(F.array_sort(F.transform("f", canonical)), "\x1f"))
    return t.select("id", _hash(F.col("c")).alias("plain"), F.when(F.col("f").isNotNull(), _hash(ordered)).alias("ordered"))


def copy_classes(keys: DataFrame) -> DataFrame:
    """plain, cls: for each plain hash that shares a field hash, the smallest plain hash it is tied to.

    Labels go back and forth between plain and field hashes until none changes; a second round is needed only where
    one plain hash was read as two different field lists.
    """
    ties = materialise(keys.filter("ordered IS NOT NULL").select("plain", "ordered").distinct(), "copy-ties")
    label = ties.select("plain", F.col("plain").alias("cls")).distinct()
    while True:
        by_field = ties.join(label, "plain").groupBy("ordered").agg(F.min("cls").alias("cls"))
        new = materialise(ties.join(by_field, "ordered").groupBy("plain").agg(F.min("cls").alias("cls")), "copy-labels")
        moved = new.join(label.withColumnRenamed("cls", "old"), "plain").filter("cls <> old").limit(1).count()
        label = new
        # Labels that moved in a round where no plain hash has two field hashes are final.
        if not moved or not ties.groupBy("plain").count().filter("count > 1").limit(1).count():
            return label


def copies(df: DataFrame, id_col: str = "chunk_no", text: str = "text") -> DataFrame:
    """id, rep, n_copies: every record of a class of two or more, with the smallest id of its class.

    Counts combine map-side; only hashes and ids are shuffled.
    """
    keys = materialise(keyed(df, id_col, text), "copy-keys")
    label = copy_classes(keys)
    rows = keys.join(label, "plain", "left").select("id", F.coalesce("cls", "plain").alias("cls"))
    reps = rows.groupBy("cls").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n_copies")).filter("n_copies > 1")
    return rows.join(reps, "cls").select("id", "rep", "n_copies")


def collapsed(df: DataFrame, id_col: str = "chunk_no", text: str = "text") -> DataFrame:
    """One row per record: its smallest id and how many copies it had (1 for a record without copies)."""
    keys = materialise(keyed(df, id_col, text), "copy-keys")
    rows = keys.join(copy_classes(keys), "plain", "left").select("id", F.coalesce("cls", "plain").alias("cls"))
    return rows.groupBy("cls").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n_copies")).select("id", "n_copies")
