"""Validation of question events as one expression over their JSON, bare or wrapped in a request."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

MAX_CHARS = 2000


def validated(df: DataFrame, body: str = "body", services: DataFrame | None = None) -> DataFrame:
    """Adds outcome, question and service_filter.

    outcome: 'options' (nothing to answer), 'invalid' (broken JSON, not an object, or a value of the wrong type),
    'missing' (no question or a blank one), 'too_long', 'ok'. The question is stripped; both are null unless ok. A
    service that is not in ``services`` (service) searches everything, so service_filter is null then, and for 'all'.
    """
    top = F.try_parse_json(F.col(body))
    df = df.withColumn("_top", top)
    kind = lambda c, path: F.schema_of_variant(F.try_variant_get(c, path, "variant"))
    text = lambda c, path: F.try_variant_get(c, path, "string")
    is_object = F.coalesce(F.schema_of_variant("_top").startswith("OBJECT"), F.lit(False))
    wrapped = F.coalesce(F.schema_of_variant("_top").rlike(r"^OBJECT<(?:.*, )?body: "), F.lit(False))
    inner_text = F.when(F.coalesce(kind(F.col("_top"), "$.body") == "VOID", F.lit(False)), F.lit("{}")).otherwise(F.coalesce(F.nullif(text(F.col("_top"), "$.body"), F.lit("")), F.lit("{}")))
    df = df.withColumn("_in", F.when(wrapped, F.try_parse_json(inner_text)).otherwise(F.col("_top")))
    inner_ok = F.coalesce(F.schema_of_variant("_in").startswith("OBJECT"), F.lit(False))
    q, s = text(F.col("_in"), "$.question"), text(F.col("_in"), "$.service")
    q_kind, s_kind = F.coalesce(kind(F.col("_in"), "$.question"), F.lit("")), F.coalesce(kind(F.col("_in"), "$.service"), F.lit(""))
    df = df.withColumn("_q", T.strip(F.coalesce(q, F.lit(""))))
    outcome = (
        F.when(~is_object, "invalid")
        .when(F.coalesce(text(F.col("_top"), "$.httpMethod") == "OPTIONS", F.lit(False)), "options")
        .when(~inner_ok | ~q_kind.isin("", "STRING") | ~s_kind.isin("", "STRING"), "invalid")
        .when(F.col("_q") == "", "missing")
        .when(F.length("_q") > MAX_CHARS, "too_long")
        .otherwise("ok")
    )
    df = df.withColumn("outcome", outcome)
    service = T.strip(F.lower(F.coalesce(s, F.lit("all"))))
    ok = F.col("outcome") == "ok"
    out = df.withColumn("question", F.when(ok, F.col("_q"))).withColumn("service_filter", F.when(ok & (service != "all"), service)).drop("_top", "_in", "_q")
    if services is None:
        return out
    known = services.select(F.col("service").alias("service_filter"), F.lit(True).alias("_known")).distinct()
    joined = out.join(known, "service_filter", "left").withColumn("service_filter", F.when(F.col("_known"), F.col("service_filter")))
    return joined.select(*out.columns)
