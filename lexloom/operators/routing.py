"""Routing of source sentences: each takes the first route that fits."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Patterns of sentences that need no translator.
PLACEHOLDER_ONLY = r"^(#\{[^}]*\})+$"
SINGLE_LETTER = r"^[A-Za-z]$"
CONTROL_ONLY = r"^(\\[A-Za-z]+)+$"
PATH_LIKE = r"^[\w./-]+\.(png|ogg|txt|rb|json)$"


def route(rows: DataFrame, cached: DataFrame, reference: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(src, doc_id, line_no, route) for each distinct sentence, at its first place.

    One CASE keeps the routes exclusive; the lookups are left joins on the sentence.
    """
    first = rows.where("src <> ''").groupBy("src").agg(F.min(F.struct("doc_id", "line_no")).alias("at"))
    known = first.join(cached.select("src").withColumn("is_cached", F.lit(True)), "src", "left")
    known = known.join(reference.select("src").withColumn("is_known", F.lit(True)), "src", "left")
    if terms is not None:
        known = known.join(terms.select("src").withColumn("is_term", F.lit(True)), "src", "left")
    else:
        known = known.withColumn("is_term", F.lit(None).cast("boolean"))
    src = F.col("src")
    way = (
        F.when(F.col("is_cached"), "cached")
        .when(src.rlike(PLACEHOLDER_ONLY), "placeholder")
        .when(F.col("is_term"), "term")
        .when(src.rlike(SINGLE_LETTER), "letter")
        .when(src.rlike(CONTROL_ONLY), "control")
        .when(src.rlike(PATH_LIKE), "path")
        .when(~src.rlike(r"\p{L}"), "no_text")
        .when(F.col("is_known"), "reference")
        .otherwise("todo")
    )
    return known.select("src", "at.*", way.alias("route"))
