"""Ranking of matched occurrences by TF-IDF or BM25."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .index import BM25, Index


def formula(cfg, tf: Column, df: Column, dl: Column, n: Column, avgdl: Column) -> Column:
    if cfg.ranking == BM25:
        idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
        return idf * (tf * (cfg.k1 + 1)) / (tf + cfg.k1 * (1 - cfg.b + cfg.b * dl / avgdl))
    return tf / dl * F.log10(n / df)


def with_stats(index: Index, name: str, rows: DataFrame) -> DataFrame:
    """Add ``n`` and ``avgdl``: constants of a persisted field, else one broadcast row."""
    if name in index.facts:
        n, avgdl = index.facts[name]
        return rows.withColumns({"n": F.lit(n), "avgdl": F.lit(avgdl)})
    return rows.crossJoin(F.broadcast(index.table("stats", name)))


def score_terms(index: Index, name: str, rows: DataFrame) -> DataFrame:
    """Scores of (doc_id, tf, dl, df, ...) rows of the term table; other columns stay."""
    cfg = index.field(name)
    told = with_stats(index, name, rows)
    return told.withColumn("score", formula(cfg, F.col("tf"), F.col("df"), F.col("dl"), F.col("n"), F.col("avgdl"))).drop("n", "avgdl")


def score(index: Index, name: str, tfs: DataFrame, key: str | None = None) -> DataFrame:
    """Scores of (doc_id, tf) rows, or of (key, doc_id, tf) rows with frequencies per ``key``.

    ``df`` counts the matched documents, so the same code serves prefix unions and phrases. The
    statistics are single rows (one per query term), joined by broadcast. Rows that have their ``dl``
    need no join for it, and both uses of them then stay alike, so that Spark makes them once.
    """
    keys, known = [key] if key else [], "dl" in tfs.columns
    # the count names tf, and the test for an id names df: otherwise one use loses a column or gains a filter
    dfs = tfs.groupBy(*keys).agg(F.count(F.when(F.col("tf") > 0, 1) if known else F.lit(1)).alias("df"))
    told = tfs if known else tfs.join(index.table("lengths", name), "doc_id")
    told = told.join(F.broadcast(dfs), key) if key else told.crossJoin(F.broadcast(dfs))
    if known:
        told = told.where(F.col("doc_id").isNotNull() | (F.col("df") < 0))
    return score_terms(index, name, told).select(*keys, "doc_id", "df", "score")
