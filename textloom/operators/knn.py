"""Nearest vectors: exact, or among the vectors that share a hash bucket with the query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors
from .index import Index


def nearest(index: Index, name: str, vector: list[float], k: int, ids: DataFrame | None = None, exact: bool = True, digits: int | None = None) -> DataFrame:
    """(doc_id, vec_idx, similarity): a row per vector, so a document can come more than once.

    ``digits``: similarities are rounded before they are ranked; ties go by id.
    """
    probe = F.lit([float(x) for x in vector])
    if exact:
        rows = index.table("vectors", name)
    else:
        mine = F.array(*(F.struct(F.lit(t).alias("table"), vectors.sign_hash(probe, F.lit(p)).alias("hash")) for t, p in enumerate(index.field(name).planes())))
        asked = index.spark.range(1).select(F.inline(mine))
        rows = index.table("buckets", name).join(F.broadcast(asked), ["table", "hash"], "left_semi").dropDuplicates(["doc_id", "vec_idx"]).select("doc_id", "vec_idx", "v")
    if ids is not None:
        rows = rows.join(ids.select("doc_id").distinct(), "doc_id", "left_semi")
    similarity = vectors.cosine(F.col("v"), probe)
    similarity = similarity if digits is None else F.round(similarity, digits)
    return rows.select("doc_id", "vec_idx", similarity.alias("similarity")).orderBy(F.desc("similarity"), "doc_id", "vec_idx").limit(k)


def bucket_lists(buckets: DataFrame) -> DataFrame:
    """(table, hash, members): for looking at the hash tables."""
    return buckets.groupBy("table", "hash").agg(F.collect_list(F.struct("doc_id", "vec_idx")).alias("members"))
