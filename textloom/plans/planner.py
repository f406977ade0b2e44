"""Query values to lazy DataFrames of hits (doc_id, score).

``semantics="reference"`` follows the documented surprising rules (a match with AND keeps the documents of
its rarest term, must-not acts on filters alone, should is required beside must); "strict" follows the
evident intent. Planning runs no job but the analysis of query texts, which is a constant expression.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import prefix
from ..operators.index import GeoField, Index
from ..operators.scoring import score, score_terms
from .query import OR, Bool, GeoPoint, GeoPolygon, Match, MatchAll, Phrase, Query, Range, Term


class Planner:
    def __init__(self, index: Index, semantics: str = "reference"):
        if semantics not in ("reference", "strict"):
            raise ValueError(semantics)
        self.index, self.strict = index, semantics == "strict"

    # --- entry points ---

    def hits(self, q: Query) -> DataFrame:
        """(doc_id, score); a term or point query can hold an id more than once.

        A query of another kind brings its own ``plan(planner)``, which returns such rows.
        """
        if hasattr(q, "plan"):
            out = q.plan(self)
            return out if q.boost is None else out.withColumn("score", F.col("score") * F.lit(float(q.boost)))
        out = getattr(self, f"_{type(q).__name__.lower()}")(q)
        return out if q.boost is None or isinstance(q, Phrase) else out.withColumn("score", F.col("score") * F.lit(float(q.boost)))

    def empty(self) -> DataFrame:
        return self._everything().where(F.lit(False))

    def analyse(self, name: str, text: str) -> list[str]:
        # over a row of the plan itself: evaluated by the optimizer, without a job
        row = self.index.spark.sql("SELECT * FROM VALUES (1)").select(self.index.field(name).query_analyzer.tokens(F.lit(text)).alias("t")).first()
        return list(row["t"])

    # --- leaves ---

    def _everything(self) -> DataFrame:
        return self.index.docs.select("doc_id", F.lit(1.0).alias("score"))

    def _matchall(self, q: MatchAll) -> DataFrame:
        return self._everything()

    def _term(self, q: Term) -> DataFrame:
        if not self.index.is_text(q.field):
            return self.empty()
        return self.index.table("postings", q.field).where(F.col("term") == q.text).select("doc_id", F.lit(1.0).alias("score"))

    def _range(self, q: Range) -> DataFrame:
        if not self.index.is_text(q.field):
            return self.empty()
        t, keep = F.col("term"), F.lit(True)
        low, high = q.gt if q.gt is not None else q.gte, q.lt if q.lt is not None else q.lte
        if low is not None:
            keep = keep & (t >= low if q.gte is not None else t > low)
        if high is not None:
            keep = keep & (t <= high if q.lte is not None else t < high)
        return self.index.table("postings", q.field).where(keep).select("doc_id").distinct().withColumn("score", F.lit(1.0))

    def _match(self, q: Match) -> DataFrame:
        if not self.index.is_text(q.field):
            return self.empty()
        tokens = self.analyse(q.field, q.text)
        if not tokens:
            if q.operation == OR:
                raise ValueError("a match with OR needs a token")
            return self.empty()
        return self.match_tokens(q.field, tokens, q.operation, q.prefix)

    def match_tokens(self, name: str, tokens: list[str], operation: str, expand: bool) -> DataFrame:
        """All tokens in one scan of the term table; one aggregation per document if there are several."""
        distinct = list(dict.fromkeys(tokens))
        times = lambda c: F.coalesce(*(F.when(c == i, F.lit(float(tokens.count(t)))) for i, t in enumerate(distinct)))
        if expand:
            postings, parts = self.index.table("placed", name), []
            for i, t in enumerate(distinct):
                terms = prefix.matching_terms(self.index.table("terms", name), t, exact_first=True)
                own = postings.where(prefix.possible(t)).join(F.broadcast(terms), "term", "left_semi").select(F.lit(i).alias("idx"), *(c for c in postings.columns if c != "term"))
                parts.append(own.distinct())
            each = reduce(DataFrame.union, parts)
            tfs = each.groupBy(*(c for c in each.columns if c != "pos")).agg(F.count(F.lit(1)).alias("tf"))
            dfs = tfs.groupBy("idx").agg(F.count(F.lit(1)).alias("df"))
            scored = score(self.index, name, tfs, "idx")
        else:
            number = F.coalesce(*(F.when(F.col("term") == t, F.lit(i)) for i, t in enumerate(distinct)))
            asked = F.col("term").isin(distinct)
            dfs = self.index.table("terms", name).where(asked).select(number.alias("idx"), "df")
            rows = self.index.table("tfs", name).where(asked).select(number.alias("idx"), "doc_id", "tf", "dl")
            scored = score_terms(self.index, name, rows.join(F.broadcast(dfs), "idx")).select("idx", "doc_id", "score")
        if len(distinct) == 1:  # one row a document already
            return scored.select("doc_id", (F.col("score") * times(F.col("idx"))).alias("score"))
        per_doc = scored.groupBy("doc_id").agg(F.sum(F.col("score") * times(F.col("idx"))).alias("score"), F.collect_set("idx").alias("has"))
        if operation == OR:
            return per_doc.select("doc_id", "score")
        if self.strict:
            return per_doc.where(F.size("has") == len(distinct)).select("doc_id", "score")
        # the documents of the token with the fewest hits, if all have some
        least = dfs.agg(F.min(F.struct("df", "idx")).alias("least"), F.count(F.lit(1)).alias("hit"))
        kept = per_doc.crossJoin(F.broadcast(least)).where((F.col("hit") == len(distinct)) & F.array_contains("has", F.col("least.idx")))
        return kept.select("doc_id", "score")

    def search_prefix(self, name: str, text: str) -> DataFrame:
        """Documents with a term of the prefix, scored with frequency 1."""
        terms = prefix.matching_terms(self.index.table("terms", name), text)
        postings = self.index.table("placed", name)
        found = postings.where(prefix.possible(text)).join(F.broadcast(terms), "term", "left_semi")
        docs = found.select(*(c for c in postings.columns if c not in ("term", "pos"))).distinct()
        return score(self.index, name, docs.withColumn("tf", F.lit(1))).select("doc_id", "score")

    def _phrase(self, q: Phrase) -> DataFrame:
        """Anchors of the first token, kept while each later token stands within the band; boost has no effect."""
        if not self.index.is_text(q.field):
            return self.empty()
        tokens = self.analyse(q.field, q.text)
        if not tokens:
            return self.empty()
        postings = self.index.table("postings", q.field)
        anchors = postings.where(F.col("term") == tokens[0]).select("doc_id", F.col("pos").alias("start"), F.col("value_idx").alias("anchor_value"))
        for i, t in enumerate(tokens[1:], 1):
            other = postings.where(F.col("term") == t).select(F.col("doc_id").alias("d"), "pos")
            band = F.col("pos") == F.col("start") + i if q.slop == 0 else F.abs(F.col("pos") - F.col("start") - i) <= q.slop
            anchors = anchors.join(other, (F.col("doc_id") == F.col("d")) & band, "left_semi")
        tfs = anchors.groupBy("doc_id").agg(F.count(F.lit(1)).alias("tf"))
        return score(self.index, q.field, tfs).select("doc_id", "score")

    def _geopoint(self, q: GeoPoint) -> DataFrame:
        cfg = self.index.field(q.field)
        if not isinstance(cfg, GeoField):
            return self.empty()
        lat, lon = F.lit(float(q.latitude)), F.lit(float(q.longitude))
        mine = geo.beginnings(geo.geohash(lat, lon, cfg.precision), cfg.precision)
        cells = self.index.table("cells", q.field).where(F.array_contains(mine, F.col("cell"))).select("doc_id").distinct()
        near = self.index.table("geometries", q.field).join(cells, "doc_id", "left_semi")
        same = (F.col("point")[0] == lon) & (F.col("point")[1] == lat)
        ok = F.when(F.col("type") == "Point", same).when(F.col("type") == "Polygon", geo.contains_point(F.col("rings"), lon, lat)).when(F.col("type") == "MultiPolygon", geo.multi_contains_point(F.col("polygons"), lon, lat))
        return near.where(ok).select("doc_id", F.lit(1.0).alias("score"))

    def _geopolygon(self, q: GeoPolygon) -> DataFrame:
        cfg = self.index.field(q.field)
        if not isinstance(cfg, GeoField):
            return self.empty()
        rings = F.lit([[[float(x), float(y)] for x, y in ring] for ring in q.rings])
        row = self.index.spark.sql("SELECT * FROM VALUES (1)").select(geo.cover(rings, cfg.precision).alias("c")).first()
        size = len(row["c"][0])
        asked = sorted({c[:k] for c in row["c"] for k in range(1, size + 1)})  # at most COVER hashes and their beginnings
        cells = self.index.table("cells", q.field).where(F.substring("cell", 1, size).isin(asked)).select("doc_id").distinct()
        near = self.index.table("geometries", q.field).join(cells, "doc_id", "left_semi")
        mine = F.col("rings")
        ok = (
            F.when(F.col("type") == "Point", geo.contains_point(rings, F.col("point")[0], F.col("point")[1]))
            .when(F.col("type") == "Polygon", geo.overlaps(mine, rings) | geo.outer_holds(rings, mine) | geo.outer_holds(mine, rings))
            .when(F.col("type") == "MultiPolygon", F.exists("polygons", lambda p: geo.overlaps(p, rings)))
        )
        return near.where(ok).select("doc_id", F.lit(1.0).alias("score"))

    # --- combinations ---

    def all_of(self, parts: list[DataFrame]) -> DataFrame:
        """Inner join on the id, scores added; a running sum must stay above 0 from the second on.

        One union and one aggregation, however many parts. A single part is left as it is.
        """
        if len(parts) == 1:
            return parts[0]
        tagged = reduce(DataFrame.union, (p.dropDuplicates(["doc_id"]).select("doc_id", "score", F.lit(i).alias("k")) for i, p in enumerate(parts)))
        grouped = tagged.groupBy("doc_id").agg(*(F.max(F.when(F.col("k") == i, F.col("score"))).alias(f"s{i}") for i in range(len(parts))))
        total, keep = F.col("s0"), F.lit(True)
        for i in range(1, len(parts)):
            total = total + F.col(f"s{i}")
            keep = keep & (total > 0)
        return grouped.where(total.isNotNull() & keep).select("doc_id", total.alias("score"))

    def any_of(self, parts: list[DataFrame]) -> DataFrame:
        """Union, scores added; sums must stay above 0 at each step. Repeats of the first part count once."""
        if len(parts) == 1:
            return parts[0]
        first = parts[0].dropDuplicates(["doc_id"])
        tagged = reduce(DataFrame.union, (p.select("doc_id", "score", F.lit(i).alias("k")) for i, p in enumerate([first, *parts[1:]])))
        grouped = tagged.groupBy("doc_id").agg(*(F.sum(F.when(F.col("k") == i, F.col("score"))).alias(f"s{i}") for i in range(len(parts))))
        total = F.col("s0")
        for i in range(1, len(parts)):
            added = F.when(total.isNull() & F.col(f"s{i}").isNull(), None).otherwise(F.coalesce(total, F.lit(0.0)) + F.coalesce(F.col(f"s{i}"), F.lit(0.0)))
            total = F.when(added > 0, added)
        return grouped.select("doc_id", total.alias("score")).where("score is not null")

    def _bool(self, q: Bool) -> DataFrame:
        if not (q.should or q.must or q.filter):
            raise ValueError("a bool query needs a should, must or filter clause")
        excluded = reduce(DataFrame.union, (self.hits(x).select("doc_id") for x in q.must_not)).distinct() if q.must_not else None
        without = lambda df: df if excluded is None else df.join(excluded, "doc_id", "left_anti")
        base = None
        if q.filter:
            kept = self.all_of([self.hits(x) for x in q.filter]).select("doc_id").distinct()
            base = (kept if self.strict else without(kept)).withColumn("score", F.lit(1.0))
        musts = ([base] if base is not None else []) + [self.hits(x) for x in q.must]
        main = self.all_of(musts) if musts else None
        some = self.any_of([self.hits(x) for x in q.should]) if q.should else None
        if self.strict:
            if main is None:
                return without(some)
            if some is None:
                return without(main)
            extra = some.groupBy("doc_id").agg(F.sum("score").alias("more"))
            return without(main.join(extra, "doc_id", "left").select("doc_id", (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score")))
        if some is None:
            return main
        if main is None:
            return some
        if base is None:
            return self.all_of([main, some])
        # an empty should leaves the rest as it is: its count is one broadcast row
        both = self.all_of([main, some]).select("doc_id", F.col("score").alias("sum"))
        n = F.broadcast(some.agg(F.count(F.lit(1)).alias("n_some")))
        joined = main.join(both, "doc_id", "left").crossJoin(n)
        return joined.where((F.col("n_some") == 0) | F.col("sum").isNotNull()).select("doc_id", F.when(F.col("n_some") == 0, F.col("score")).otherwise(F.col("sum")).alias("score"))


def search(index: Index, query: Query | None = None, from_: int = 0, limit: int = 200, semantics: str = "reference") -> DataFrame:
    """Rows [from_, limit) of the hits by score, ties by id; ``limit`` is an end, not a page size."""
    if from_ > limit:
        raise ValueError("from_ lies beyond limit")
    hits = Planner(index, semantics).hits(query or MatchAll())
    return hits.orderBy(F.col("score").desc(), F.col("doc_id")).limit(limit).offset(from_)


def count(index: Index, query: Query | None = None, from_: int = 0, limit: int = 200, semantics: str = "reference") -> int:
    """The size of the page, so at most ``limit``."""
    return search(index, query, from_, limit, semantics).count()
