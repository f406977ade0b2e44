"""Prefix lookups in a field's dictionary of terms.

The dictionary is scanned once per lookup, with one aggregate of fixed size; on persisted terms, sorted,
the conditions reach the file statistics.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _some(condition):
    return F.coalesce(F.bool_or(condition), F.lit(False))


def facts(terms: DataFrame, text: str) -> DataFrame:
    """One row on a text: is it a term, does a term start with it, and the prefix to fall back on.

    The fallback is the longest proper prefix that starts a term, if that is itself a term and no later
    character of the text, past the next, continues it to a term; else null.
    """
    t = F.col("term")
    cols = [_some(t == text).alias("exact"), _some(t.startswith(text) if text else F.lit(False)).alias("starts")]
    for k in range(1, len(text)):
        head = text[:k]
        cols += [_some(t.startswith(head)).alias(f"p{k}"), _some(t == head).alias(f"t{k}")]
        more = sorted({head + c for c in text[k + 1 :]})
        bad = F.lit(False)
        for m in more:
            bad = bad | t.startswith(m)
        cols.append(_some(bad).alias(f"b{k}"))
    row = terms.agg(*cols)
    back = F.lit(None).cast("string")
    for k in range(1, len(text)):
        back = F.when(F.col(f"p{k}"), F.when(F.col(f"t{k}") & ~F.col(f"b{k}"), F.lit(text[:k]))).otherwise(back)
    return row.select("exact", "starts", back.alias("back"))


def possible(text: str):
    """What every term that a prefix can stand for fulfils, as plain comparisons that reach a file's statistics."""
    hit = F.col("term").isin([text[:k] for k in range(1, len(text) + 1)])
    return hit | F.col("term").startswith(text) if text else F.lit(False)


def matching_terms(terms: DataFrame, text: str, exact_first: bool = False) -> DataFrame:
    """(term) that a prefix stands for."""
    fact = F.broadcast(facts(terms, text))
    exact = F.col("exact") & F.lit(exact_first)
    starts = F.col("term").startswith(text) if text else F.lit(False)
    hit = F.when(exact, F.col("term") == text).when(F.col("starts"), starts).otherwise(F.col("term").eqNullSafe(F.col("back")))
    heads = F.lit(False)
    for k in range(1, len(text)):
        heads = heads | (F.col("term") == text[:k])
    return terms.where(starts | heads).crossJoin(fact).where(hit).select("term")


def longest_prefix(terms: DataFrame, text: str) -> DataFrame:
    """One row: the longest prefix of the text that starts a term, if it is a term, else null."""
    t = F.col("term")
    cols = []
    for k in range(1, len(text) + 1):
        cols += [_some(t.startswith(text[:k])).alias(f"p{k}"), _some(t == text[:k]).alias(f"t{k}")]
    out = F.lit(None).cast("string")
    for k in range(1, len(text) + 1):
        out = F.when(F.col(f"p{k}"), F.when(F.col(f"t{k}"), F.lit(text[:k]))).otherwise(out)
    return terms.agg(*cols).select(F.lit(text).alias("input"), out.alias("found")) if cols else terms.agg(F.lit(text).alias("input"), F.lit(None).cast("string").alias("found"))


def terms_of(df: DataFrame, column: str) -> DataFrame:
    """A dictionary from the values of any column."""
    return df.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("term")).distinct()
