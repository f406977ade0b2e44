"""Field configurations and the index tables they are built into.

An ``Index`` is a set of lazy DataFrames. A text field has postings, one row per occurrence (doc_id,
value_idx, pos, term), positions restarting at every value; a geo field has its last geometry and that
geometry's cells; a vector field one row per vector. Ids are unique per build: deduplicate upstream.
``tfs`` holds one row per (term, doc_id) with its frequency and the document's length, ``terms`` one per term with
its counts. Tables are computed when they are read; ``sources.state.persist`` writes a text field's ``forms``, one row
per document with its tokens, and the terms: the other tables are views of the forms, so a build neither shuffles nor
sorts occurrences, and a filter on terms works before anything is grouped. Statistics are constants then. A mapped field
without a column is empty. What is made by an expression is exploded by the outer form: for the inner one, Spark infers a
filter on its size, which works the expression out a second time.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, vectors
from ..functions.analysis import Analyzer

TFIDF, BM25 = "TFIDF", "BM25"


@dataclass(frozen=True)
class TextField:
    """Setting only ``analyzer`` leaves the query analyzer at its default."""

    analyzer: Analyzer = Analyzer()
    query_analyzer: Analyzer = Analyzer()
    ranking: str = TFIDF
    k1: float = 1.2
    b: float = 0.75


@dataclass(frozen=True)
class GeoField:
    precision: int = 5


@dataclass(frozen=True)
class VectorField:
    dimensions: int
    tables: int = 4
    bits: int | None = None
    seed: int = 42
    projections: tuple = ()

    def planes(self) -> list[list[list[float]]]:
        """The projections of each table: given ones, or as many unit vectors as dimensions."""
        if self.projections:
            return [list(map(list, t)) for t in self.projections]
        return [vectors.random_unit_vectors(self.bits or self.dimensions, self.dimensions, self.seed + 7919 * t) for t in range(self.tables)]


@dataclass
class Index:
    """``docs``: doc_id and one string or array<string> column per text or geo field (array of double
    arrays, or one, per vector field). Columns that the mapping does not name are text fields."""

    docs: DataFrame
    mapping: dict = field(default_factory=dict)
    tables: dict = field(default_factory=dict)
    #: Of persisted text fields: (documents with tokens, their mean length).
    facts: dict = field(default_factory=dict)

    def with_field(self, name: str, cfg) -> Index:
        """The same tables under another configuration of a field: its ranking, or its query analyzer."""
        return Index(self.docs, self.mapping | {name: cfg}, self.tables, self.facts)

    @property
    def spark(self) -> SparkSession:
        return self.docs.sparkSession

    def field(self, name: str):
        if name in self.mapping:
            return self.mapping[name]
        return TextField() if name in self.docs.columns and name != "doc_id" else None

    def is_text(self, name: str) -> bool:
        return isinstance(self.field(name), TextField)

    def ids(self) -> DataFrame:
        return self.docs.select("doc_id")

    def get(self, doc_id) -> DataFrame:
        return self.docs.where(F.col("doc_id") == F.lit(doc_id))

    def table(self, kind: str, name: str) -> DataFrame:
        key = (kind, name)
        if key not in self.tables:
            self.tables[key] = getattr(self, f"_{kind}")(name)
        return self.tables[key]

    def _values(self, name: str) -> DataFrame:
        kind = dict(self.docs.dtypes).get(name)
        if kind is None:
            return self.docs.where(F.lit(False)).select("doc_id", F.lit(0).alias("value_idx"), F.lit("").alias("value"))
        values = F.col(name) if kind.startswith("array") else F.when(F.col(name).isNotNull(), F.array(name))
        return self.docs.select("doc_id", F.posexplode(values).alias("value_idx", "value"))

    def _forms(self, name: str) -> DataFrame:
        """(doc_id, dl, values): the number of a document's tokens, and the tokens value by value. Ids are unique."""
        kind, tokens = dict(self.docs.dtypes).get(name), self.field(name).analyzer.tokens
        if kind is None:
            found = F.lit(None).cast("array<array<string>>")
        elif kind.startswith("array"):
            found = F.transform(name, lambda v: F.when(v.isNotNull(), tokens(v)).otherwise(F.array().cast("array<string>")))
        else:
            found = F.when(F.col(name).isNotNull(), F.array(tokens(F.col(name))))
        length = F.aggregate(F.coalesce("values", F.array().cast("array<array<string>>")), F.lit(0).cast("long"), lambda n, v: n + F.size(v))
        return self.docs.select("doc_id", found.alias("values")).select("doc_id", length.alias("dl"), "values")

    def _formed(self, name: str) -> bool:
        return ("forms", name) in self.tables

    def _postings(self, name: str) -> DataFrame:
        if self._formed(name):
            values = self.table("forms", name).select("doc_id", F.posexplode("values").alias("value_idx", "value"))
            return values.select("doc_id", "value_idx", F.posexplode("value").alias("pos", "term"))
        tokens = self.field(name).analyzer.tokens(F.col("value"))
        return self._values(name).where("value is not null").select("doc_id", "value_idx", F.posexplode(tokens).alias("pos", "term"))

    def _placed(self, name: str) -> DataFrame:
        """(doc_id, pos, term): occurrences, with their document's length ``dl`` where the rows they come from have it."""
        if self._formed(name):
            values = self.table("forms", name).select("doc_id", "dl", F.explode("values").alias("value"))
            return values.select("doc_id", "dl", F.posexplode("value").alias("pos", "term"))
        return self.table("postings", name).select("doc_id", "pos", "term")

    def _lengths(self, name: str) -> DataFrame:
        if self._formed(name):
            return self.table("forms", name).select("doc_id", "dl").where("dl > 0")
        return self.table("postings", name).groupBy("doc_id").agg(F.count(F.lit(1)).alias("dl"))

    def _stats(self, name: str) -> DataFrame:
        """One row: documents with tokens, and their mean length."""
        return self.table("lengths", name).agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))

    def _tfs(self, name: str) -> DataFrame:
        if self._formed(name):
            long = self.table("forms", name).where("doc_id is not null").select("doc_id", "dl", F.explode_outer(F.flatten("values")).alias("term")).where("term is not null")
            return long.groupBy("term", "doc_id", "dl").agg(F.count(F.lit(1)).alias("tf")).select("term", "doc_id", "tf", "dl")
        found = self.table("postings", name).groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("tf"))
        return found.join(self.table("lengths", name), "doc_id").select("term", "doc_id", "tf", "dl")

    def _terms(self, name: str) -> DataFrame:
        """(term, df, cf): documents with the term, and its occurrences."""
        if self._formed(name):  # behind a document's tokens, its different ones again, which count the document
            words = self.table("forms", name).where("doc_id is not null").select(F.flatten("values").alias("words"))
            both = words.select(F.size("words").alias("cf"), F.concat("words", F.array_distinct("words")).alias("both"))
            each = both.select("cf", F.posexplode_outer("both").alias("pos", "term")).where("term is not null")
            own = F.col("pos") < F.col("cf")
            return each.groupBy("term").agg(F.count(F.when(~own, 1)).alias("df"), F.count(F.when(own, 1)).alias("cf"))
        return self.table("tfs", name).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))

    def _geometries(self, name: str) -> DataFrame:
        last = self._values(name).groupBy("doc_id").agg(F.max(F.struct("value_idx", "value")).alias("v"))
        return last.select("doc_id", geo.parse(F.col("v.value")).alias("g")).select("doc_id", "g.*")

    def _cells(self, name: str) -> DataFrame:
        p = self.field(name).precision
        point = F.when(F.col("type") == "Point", F.array(geo.geohash(F.col("point")[1], F.col("point")[0], p)))
        rings = F.when(F.col("type") == "Polygon", geo.cover(F.col("rings"), p))
        many = F.when(F.col("type") == "MultiPolygon", F.array_distinct(F.flatten(F.transform("polygons", lambda q: geo.cover(q, p)))))
        return self.table("geometries", name).select("doc_id", F.explode(F.coalesce(point, rings, many)).alias("cell"))

    def _vectors(self, name: str) -> DataFrame:
        kind = dict(self.docs.dtypes).get(name)
        if kind is None:
            return self.docs.where(F.lit(False)).select("doc_id", F.lit(0).alias("vec_idx"), F.array(F.lit(0.0)).alias("v"))
        many = F.col(name) if kind.startswith("array<array") else F.array(name)
        return self.docs.where(F.col(name).isNotNull()).select("doc_id", F.posexplode(many).alias("vec_idx", "v"))

    def _buckets(self, name: str) -> DataFrame:
        """(table, hash, doc_id, vec_idx, v): each vector in each hash table."""
        planes = self.field(name).planes()
        hashes = F.array(*(F.struct(F.lit(t).alias("table"), vectors.sign_hash(F.col("v"), F.lit(p)).alias("hash")) for t, p in enumerate(planes)))
        return self.table("vectors", name).select("doc_id", "vec_idx", "v", F.inline(hashes))


def build(docs: DataFrame, mapping: dict | None = None, id_col: str = "doc_id") -> Index:
    return Index(docs.withColumnRenamed(id_col, "doc_id"), dict(mapping or {}))


def latest(docs: DataFrame, id_col: str, order_col: str) -> DataFrame:
    """One row per id, the last by ``order_col``: what re-indexing leaves in the store."""
    newest = docs.groupBy(id_col).agg(F.max_by(F.struct(*docs.columns), order_col).alias("r"))
    return newest.select("r.*")
