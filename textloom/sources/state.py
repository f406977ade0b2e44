"""Saving and loading an index: a directory of Parquet tables and a small description.

Of a text field, one row per document is written with its tokens, and the dictionary of terms; where the postings are
given (those of a stream), the tables of occurrences in ranges of (term, doc_id). Rankings come back from the description;
analyzers are code and come from the mapping given on loading. Only fields in that mapping are restored; one without
saved state is empty.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.index import GeoField, Index, TextField, VectorField

_OF_POSTINGS = ("postings", "lengths", "tfs", "terms")
_TABLES = {TextField: ("forms", "terms"), GeoField: ("geometries", "cells"), VectorField: ("vectors",)}
_KIND = {TextField: "text", GeoField: "geo", VectorField: "vector"}


def _text_file(spark: SparkSession, path: str, content: str | None = None) -> str | None:
    if content is not None:
        spark.createDataFrame([(content,)], "value string").coalesce(1).write.mode("overwrite").text(path)
        return None
    return "\n".join(r["value"] for r in spark.read.text(path).collect())


def _tables(index: Index, name: str, cfg) -> tuple:
    given = isinstance(cfg, TextField) and ("postings", name) in index.tables and ("forms", name) not in index.tables
    return _OF_POSTINGS if given else _TABLES[type(cfg)]


def _one_each(docs: DataFrame, names: list[str]) -> DataFrame:
    """One row per id: an id's rows become one with all their values, if any id comes again."""
    most = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    if (most or 0) < 2:
        return docs
    lists = {n: F.col(n) if dict(docs.dtypes)[n].startswith("array") else F.when(F.col(n).isNotNull(), F.array(n)) for n in names}
    return docs.groupBy("doc_id").agg(*(F.flatten(F.collect_list(c)).alias(n) for n, c in lists.items()))


def save(index: Index, path: str) -> None:
    meta = {}
    names = [c for c in index.docs.columns if c != "doc_id"]
    index.docs.write.mode("overwrite").parquet(f"{path}/docs")
    docs = index.spark.read.schema(index.docs.schema).parquet(f"{path}/docs")
    formed = [n for n in names if "forms" in _tables(index, n, index.field(n)) and ("forms", n) not in index.tables]
    once = Index(_one_each(docs, formed) if formed else docs, index.mapping)
    saved = Index(docs, index.mapping)
    for name in names:
        cfg = index.field(name)
        meta[name] = {"kind": _KIND[type(cfg)]}
        if isinstance(cfg, TextField):
            meta[name] |= {"ranking": cfg.ranking, "k1": cfg.k1, "b": cfg.b}
        elif isinstance(cfg, GeoField):
            meta[name] |= {"precision": cfg.precision}
        else:
            meta[name] |= {"dimensions": cfg.dimensions, "projections": cfg.planes()}
        meta[name]["tables"] = _tables(index, name, cfg)
        for table in meta[name]["tables"]:
            df = (index if (table, name) in index.tables else once if table == "forms" else saved).table(table, name)
            if table == "terms":
                df = df.sortWithinPartitions("term")
            elif "term" in df.columns:  # a common word's rows spread over files
                keys = [c for c in ("term", "doc_id") if c in df.columns]
                df = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
            df.write.mode("overwrite").option("parquet.block.size", 8 << 20).parquet(f"{path}/{name}/{table}")
            # what follows is made from what is written
            saved.tables[table, name] = index.spark.read.schema(df.schema).parquet(f"{path}/{name}/{table}")
        if isinstance(cfg, TextField):
            row = saved.table("stats", name).first()
            meta[name] |= {"n": row["n"], "avgdl": row["avgdl"]}
    _text_file(index.spark, f"{path}/meta", json.dumps(meta))


def load(spark: SparkSession, path: str, mapping: dict | None = None) -> Index:
    meta = json.loads(_text_file(spark, f"{path}/meta"))
    docs = spark.read.parquet(f"{path}/docs")
    mapping = dict(mapping) if mapping is not None else {n: TextField() for n, m in meta.items() if m["kind"] == "text"}
    out = Index(docs, {})
    for name, cfg in mapping.items():
        saved = meta.get(name)
        out.mapping[name] = cfg
        if saved is None:
            continue
        if saved["kind"] != _KIND[type(cfg)]:
            raise ValueError(f"field {name} was saved as {saved['kind']}")
        if isinstance(cfg, TextField):
            out.mapping[name] = TextField(cfg.analyzer, cfg.query_analyzer, saved["ranking"], saved["k1"], saved["b"])
            if saved.get("n"):
                out.facts[name] = saved["n"], saved["avgdl"]
        elif isinstance(cfg, GeoField):
            out.mapping[name] = GeoField(saved["precision"])
        else:
            out.mapping[name] = VectorField(saved["dimensions"], projections=tuple(saved["projections"]))
        for table in saved.get("tables") or (_OF_POSTINGS if isinstance(cfg, TextField) else _TABLES[type(cfg)]):
            out.tables[table, name] = spark.read.parquet(f"{path}/{name}/{table}")
    return out


def persist(index: Index, path: str) -> Index:
    """Write an index and read it back: built once, queried often."""
    save(index, path)
    return load(index.spark, path, {n: index.field(n) for n in [*index.docs.columns, *index.mapping] if n != "doc_id"})


def documents(df: DataFrame, id_col: str = "id", fields_col: str = "fields", names: list[str] | None = None) -> DataFrame:
    """Rows (id, map of field to values) as one array column per field name."""
    return df.selectExpr(f"{id_col} AS doc_id", *(f"{fields_col}['{n}'] AS `{n}`" for n in names or []))
