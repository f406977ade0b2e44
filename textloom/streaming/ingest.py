"""Incremental indexing: new documents of a stream are analysed and appended to saved tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.index import GeoField, Index, TextField, VectorField

#: The table that each kind of field appends; the others follow from it.
_APPENDED = {TextField: ("postings",), GeoField: ("geometries", "cells"), VectorField: ("vectors",)}


def append_stream(docs: DataFrame, path: str, mapping: dict, checkpoint: str) -> StreamingQuery:
    """Append each micro-batch's documents and field tables, one directory per batch.

    A batch that is run again after a failure overwrites its own directory, so nothing counts twice. Of an id that
    comes again, the latest batch counts; within a batch ids are unique.
    """

    def write(batch: DataFrame, number: int) -> None:
        index = Index(batch, dict(mapping))
        batch.write.mode("overwrite").parquet(f"{path}/docs/batch={number}")
        for name, cfg in mapping.items():
            for table in _APPENDED[type(cfg)]:
                index.table(table, name).write.mode("overwrite").parquet(f"{path}/{name}/{table}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def open_stream_index(spark, path: str, mapping: dict) -> Index:
    """An index over what the stream has written so far: of each id, what its latest batch holds."""
    written = spark.read.parquet(f"{path}/docs")
    latest = written.groupBy("doc_id").agg(F.max("batch").alias("batch"))
    now = lambda df: df.join(latest, ["doc_id", "batch"], "left_semi").drop("batch")
    out = Index(now(written), dict(mapping))
    for name, cfg in mapping.items():
        for table in _APPENDED[type(cfg)]:
            out.tables[table, name] = now(spark.read.parquet(f"{path}/{name}/{table}"))
    return out
