"""Terms and significant-terms aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .index import Index
from .scoring import with_stats


def top_terms(index: Index, name: str, n: int, ids: DataFrame | None = None) -> DataFrame:
    """(term, n): the n commonest terms, by occurrences; within ``ids``, by documents."""
    if ids is None:
        counted = index.table("terms", name).select("term", F.col("cf").alias("n"))
    else:
        inside = index.table("tfs", name).join(ids.select("doc_id").distinct(), "doc_id", "left_semi")
        counted = inside.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.desc("n"), "term").limit(n)


def significant_terms(index: Index, name: str, n: int, ids: DataFrame) -> DataFrame:
    """(term, score, n): share of the ids with the term over its occurrences per document of the corpus."""
    ids = ids.select("doc_id").distinct()
    inside = index.table("tfs", name).join(ids, "doc_id", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    whole = index.table("terms", name).select("term", "cf")
    sizes = F.broadcast(ids.agg(F.count(F.lit(1)).alias("n_ids")))
    told = with_stats(index, name, inside.withColumnRenamed("n", "n_in").join(whole, "term").crossJoin(sizes))
    scored = told.select("term", (F.col("n_in") / F.col("n_ids") / (F.col("cf") / F.col("n"))).alias("score"), F.col("n_in").alias("n"))
    return scored.orderBy(F.desc("score"), "term").limit(n)
