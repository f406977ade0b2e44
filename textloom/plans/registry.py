"""The registered queries over the supplied tables, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import analysis, geo, vectors
from ..operators import aggs, index, knn, prefix
from ..operators.index import BM25, GeoField, TextField, VectorField
from ..sources import state
from .planner import Planner, search
from .query import OR, Bool, GeoPoint, GeoPolygon, Match, MatchAll, Phrase, Range, Term

_Q: dict = {}
_SQL: dict[str, str] = {}


_BUILT: dict = {}


def _new_path(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or "/tmp/checkpoints"
    return f"{base.rstrip('/')}/index-{uuid.uuid4().hex}"


def _built(spark: SparkSession, sf: str, name: str, make) -> index.Index:
    """The persisted index of a session and a data directory: built once, at the first query that needs it."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key in _BUILT:
        path, ix = _BUILT[key]
        there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/meta")
        if there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there):
            return ix
    path = _new_path(spark)
    _BUILT[key] = path, state.persist(make(), path)
    return _BUILT[key][1]


def _text_now(spark: SparkSession, sf: str) -> index.Index:
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    return index.build(docs, {"text": TextField(ranking=BM25), "lang": TextField(analysis.KEYWORD, analysis.KEYWORD)})


def _text(spark: SparkSession, sf: str, ranking: str = BM25, **more) -> index.Index:
    return _built(spark, sf, "documents", lambda: _text_now(spark, sf)).with_field("text", TextField(ranking=ranking, **more))


def _talks(spark: SparkSession, sf: str) -> index.Index:
    rows = spark.read.parquet(f"{sf}/conversations.parquet").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("v"))
    made = index.build(rows.select("conv_id", F.col("v.text").alias("text")), {"text": TextField(ranking=BM25)}, "conv_id")
    return _built(spark, sf, "conversations", lambda: made)


def build_indexes(spark: SparkSession, sf: str) -> None:
    """Build what the queries over documents, conversations and places read."""
    for make in (_text, _talks, _places):
        make(spark, sf)


def _page(hits: DataFrame, limit: int | None = None) -> DataFrame:
    out = hits.select("doc_id", F.round("score", 6).alias("score"))
    return out.orderBy(F.desc("score"), "doc_id").limit(limit) if limit else out


def _add(name: str, sql: str | None = None):
    def put(f):
        _Q[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return put


# --- SQL building blocks ---

_TOKENS = r"""list_filter(regexp_split_to_array(trim(regexp_replace(regexp_replace(lower({c}), '[''’]', '', 'g'), '[\\\]\[''"!,.@#$%^&*()_+\-={{}}|><`~±§?;:/]', ' ', 'g')), '\s+'), lambda x: x <> '')"""


def _postings(source: str = "SELECT doc_id, 0 AS vi, text AS v FROM documents") -> str:
    return f"""src AS ({source}), tk AS (SELECT doc_id, vi, {_TOKENS.format(c='v')} AS t FROM src WHERE v IS NOT NULL),
p AS (SELECT doc_id, vi, unnest(t) AS term, unnest(range(len(t))) AS pos FROM tk),
dl AS (SELECT doc_id, count(*) AS dl FROM p GROUP BY doc_id), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl)"""


def _scored(tfs: str, ranking: str = BM25, key: str = "", k1: float = 1.2, b: float = 0.75) -> str:
    """SQL for (key, doc_id, s) from a relation (key, doc_id, tf)."""
    by = f"PARTITION BY {key}" if key else ""
    k = f"{key}, " if key else ""
    if ranking == BM25:
        f = f"ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * {k1 + 1}) / (tf + {k1} * (1 - {b} + {b} * dl / avgdl))"
    else:
        f = "tf / dl::DOUBLE * log10(n / df::DOUBLE)"
    return f"SELECT {k}doc_id, df, {f} AS s FROM (SELECT {k}doc_id, tf, count(*) OVER ({by}) AS df FROM {tfs}) JOIN dl USING (doc_id), st"


def _one(tfs: str, ranking: str = BM25, **more) -> str:
    return f"WITH {_postings()}, tf AS ({tfs}) SELECT doc_id, round(s, 6) AS score FROM ({_scored('tf', ranking, **more)})"


def _words(*terms: str) -> str:
    return f"SELECT term, doc_id, count(*) AS tf FROM p WHERE term IN ({', '.join(repr(t) for t in terms)}) GROUP BY ALL"


# --- analysis ---


@_add("analyze_default", f"SELECT doc_id, unnest(t) AS term, unnest(range(len(t)))::INT AS pos FROM (SELECT doc_id, {_TOKENS.format(c='text')} AS t FROM documents)")
def analyze_default(spark, sf):
    return _text(spark, sf).table("postings", "text").select("doc_id", "term", "pos")


@_add("analyze_keyword", "SELECT lang AS term, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def analyze_keyword(spark, sf):
    return _text(spark, sf).table("postings", "lang").groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@_add("elision_filter", "SELECT doc_id, regexp_replace(text, '[''’]', '', 'g') AS text FROM documents")
def elision_filter(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", analysis.elision(F.col("text")).alias("text"))


@_add("interpunction_filter", r"""SELECT page_id, regexp_replace(regexp_replace(html, '[\\\]\[''"!,.@#$%^&*()_+\-={}|><`~±§?;:/]', ' ', 'g'), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS text FROM pages""")
def interpunction_filter(spark, sf):
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", analysis.interpunction(F.col("html")).alias("text"))


_JOINED = f"SELECT p_partkey, array_to_string({_TOKENS.format(c='p_name')}, '') AS j FROM part"


@_add("ngram_tokens", f"SELECT p_partkey, CASE WHEN j = '' THEN '' ELSE array_to_string(list_distinct_ordered, ' ') END AS grams FROM (SELECT p_partkey, j, list_filter(g, lambda x, i: list_position(g, x) = i) AS list_distinct_ordered FROM (SELECT p_partkey, j, list_transform(range(1, greatest(1, length(j) - 2) + 1), lambda i: substr(j, i, 3)) AS g FROM ({_JOINED})))")
def ngram_tokens(spark, sf):
    a = analysis.Analyzer(token_filters=(analysis.ngrams(3),))
    return spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", F.array_join(a.tokens(F.col("p_name")), " ").alias("grams"))


@_add("edge_ngram_tokens", f"SELECT p_partkey, array_to_string(list_filter(g, lambda x, i: list_position(g, x) = i), ' ') AS grams FROM (SELECT p_partkey, flatten(list_transform(t, lambda w: CASE WHEN length(w) <= 2 THEN [w] ELSE flatten(list_transform(range(2, least(4, length(w)) + 1), lambda k: [substr(w, 1, k), substr(w, length(w) - k + 1, k)])) END)) AS g FROM (SELECT p_partkey, {_TOKENS.format(c='p_name')} AS t FROM part))")
def edge_ngram_tokens(spark, sf):
    a = analysis.Analyzer(token_filters=(analysis.edge_ngrams(2, 4),))
    return spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", F.array_join(a.tokens(F.col("p_name")), " ").alias("grams"))


# --- leaves ---


@_add("match_all_page", "SELECT doc_id, 1.0::DOUBLE AS score FROM documents ORDER BY doc_id LIMIT 20 OFFSET 10")
def match_all_page(spark, sf):
    return search(_text(spark, sf), MatchAll(), 10, 30)


@_add("count_default", "SELECT least(200, count(*))::BIGINT AS n FROM documents")
def count_default(spark, sf):
    return search(_text(spark, sf)).agg(F.count(F.lit(1)).alias("n"))


@_add("term_occurrences", f"WITH {_postings()} SELECT doc_id, 1.0::DOUBLE AS score FROM p WHERE term = 'the'")
def term_occurrences(spark, sf):
    return Planner(_text(spark, sf)).hits(Term("text", "the"))


for _name, _bounds, _where in (
    ("range_gt_lt", {"gt": "the", "lt": "thf"}, "term > 'the' AND term < 'thf'"),
    ("range_gte_lte", {"gte": "was", "lte": "with"}, "term >= 'was' AND term <= 'with'"),
    ("range_both_bounds", {"gt": "the", "gte": "a", "lt": "thea"}, "term >= 'the' AND term < 'thea'"),
    ("range_open", {}, "true"),
):
    _add(_name, f"WITH {_postings()} SELECT DISTINCT doc_id, 1.0::DOUBLE AS score FROM p WHERE {_where}")(lambda spark, sf, b=_bounds: Planner(_text(spark, sf)).hits(Range("text", **b)))


@_add("term_bm25", _one("SELECT doc_id, count(*) AS tf FROM p WHERE term = 'in' GROUP BY doc_id"))
def term_bm25(spark, sf):
    return _page(Planner(_text(spark, sf)).match_tokens("text", ["in"], "AND", False))


@_add("term_tfidf", _one("SELECT doc_id, count(*) AS tf FROM p WHERE term = 'in' GROUP BY doc_id", "TFIDF"))
def term_tfidf(spark, sf):
    return _page(Planner(_text(spark, sf, "TFIDF")).match_tokens("text", ["in"], "AND", False))


@_add("bm25_custom_params", _one("SELECT doc_id, count(*) AS tf FROM p WHERE term = 'de' GROUP BY doc_id", k1=2.0, b=0.6))
def bm25_custom_params(spark, sf):
    return _page(Planner(_text(spark, sf, k1=2.0, b=0.6)).match_tokens("text", ["de"], "AND", False))


_SUMS = f"WITH {_postings()}, tf AS ({_words('of', 'the', 'in')}), sc AS ({_scored('tf', key='term')})"


@_add("match_and_reference", f"{_SUMS}, least AS (SELECT term FROM sc GROUP BY term, df ORDER BY df, list_position(['of', 'the', 'in'], term) LIMIT 1) SELECT doc_id, round(sum(s), 6) AS score FROM sc WHERE doc_id IN (SELECT doc_id FROM sc WHERE term = (SELECT term FROM least)) GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 10")
def match_and_reference(spark, sf):
    return _page(Planner(_text(spark, sf)).hits(Match("text", "of the in")), 10)


@_add("match_and_strict", f"{_SUMS} SELECT doc_id, round(sum(s), 6) AS score FROM sc GROUP BY doc_id HAVING count(*) = 3")
def match_and_strict(spark, sf):
    return _page(Planner(_text(spark, sf), "strict").hits(Match("text", "of the in")))


@_add("match_or", f"{_SUMS} SELECT doc_id, round(sum(s * CASE WHEN term = 'the' THEN 2 ELSE 1 END), 6) AS score FROM sc GROUP BY doc_id")
def match_or(spark, sf):
    return _page(Planner(_text(spark, sf)).hits(Match("text", "of the in the", OR)))


def _prefixed(where: str) -> str:
    return _one(f"SELECT doc_id, count(*) AS tf FROM (SELECT DISTINCT doc_id, pos FROM p WHERE {where}) GROUP BY doc_id")


for _name, _text_query, _where in (("match_prefix", "ent", "starts_with(term, 'ent')"), ("match_prefix_exact_first", "wh", "term = 'wh'"), ("match_prefix_backward", "andq", "term = 'and'")):
    _add(_name, _prefixed(_where))(lambda spark, sf, q=_text_query: _page(Planner(_text(spark, sf)).hits(Match("text", q, prefix=True))))


@_add("search_prefix", _one("SELECT DISTINCT doc_id, 1 AS tf FROM p WHERE starts_with(term, 'wh')"))
def search_prefix(spark, sf):
    return _page(Planner(_text(spark, sf)).search_prefix("text", "wh"))


@_add("phrase_exact", _one("SELECT a.doc_id, count(*) AS tf FROM p a WHERE a.term = 'of' AND EXISTS (FROM p b WHERE b.doc_id = a.doc_id AND b.term = 'the' AND b.pos = a.pos + 1) GROUP BY a.doc_id"))
def phrase_exact(spark, sf):
    return _page(Planner(_text(spark, sf)).hits(Phrase("text", "of the")))


@_add("phrase_slop", _one("SELECT a.doc_id, count(*) AS tf FROM p a WHERE a.term = 'of' AND EXISTS (FROM p b WHERE b.doc_id = a.doc_id AND b.term = 'the' AND abs(b.pos - a.pos - 1) <= 2) GROUP BY a.doc_id"))
def phrase_slop(spark, sf):
    return _page(Planner(_text(spark, sf)).hits(Phrase("text", "of the", 2)))


@_add("phrase_multivalue", f"WITH {_postings('SELECT conv_id AS doc_id, turn AS vi, text AS v FROM conversations')}, tf AS (SELECT a.doc_id, count(*) AS tf FROM p a WHERE a.term = 'of' AND EXISTS (FROM p b WHERE b.doc_id = a.doc_id AND b.term = 'the' AND b.pos = a.pos + 1) GROUP BY a.doc_id) SELECT doc_id, round(s, 6) AS score FROM ({_scored('tf')})")
def phrase_multivalue(spark, sf):
    return _page(Planner(_talks(spark, sf)).hits(Phrase("text", "of the")))


# --- bool ---

_LEAF = f"WITH {_postings()}, tf AS ({_words('of', 'the', 'in', 'is')}), sc AS ({_scored('tf', key='term')}), o AS (SELECT doc_id, s FROM sc WHERE term = 'of'), t AS (SELECT doc_id, s FROM sc WHERE term = 'the'), i AS (SELECT doc_id, s FROM sc WHERE term = 'in'), z AS (SELECT doc_id, s FROM sc WHERE term = 'is')"
_O, _T, _I, _Z = (Match("text", w) for w in ("of", "the", "in", "is"))
for _name, _query, _sem, _sql in (
    ("bool_must", Bool(must=(_O, _T)), "reference", "SELECT doc_id, round(o.s + t.s, 6) AS score FROM o JOIN t USING (doc_id)"),
    ("bool_should", Bool(should=(_O, _T)), "reference", "SELECT doc_id, round(sum(s), 6) AS score FROM (FROM o UNION ALL FROM t) GROUP BY doc_id"),
    ("bool_filter", Bool(filter=(_O,), must=(_T,)), "reference", "SELECT doc_id, round(1 + t.s, 6) AS score FROM o JOIN t USING (doc_id)"),
    ("bool_filter_must_not", Bool(filter=(_T,), must_not=(_I, _Z)), "reference", "SELECT doc_id, 1.0::DOUBLE AS score FROM t WHERE doc_id NOT IN (SELECT doc_id FROM i) AND doc_id NOT IN (SELECT doc_id FROM z)"),
    ("bool_must_not_without_filter", Bool(must=(_T,), must_not=(_I,)), "reference", "SELECT doc_id, round(s, 6) AS score FROM t"),
    ("bool_must_should", Bool(must=(_O,), should=(_I, _Z)), "reference", "SELECT doc_id, round(o.s + x.s, 6) AS score FROM o JOIN (SELECT doc_id, sum(s) AS s FROM (FROM i UNION ALL FROM z) GROUP BY doc_id) x USING (doc_id)"),
    ("bool_filter_should_empty", Bool(filter=(_O,), should=(Term("text", "no such term"),)), "reference", "SELECT doc_id, 1.0::DOUBLE AS score FROM o"),
    ("bool_strict_must_not", Bool(must=(_T,), must_not=(_I,), should=(_Z,)), "strict", "SELECT t.doc_id, round(t.s + coalesce(z.s, 0), 6) AS score FROM t LEFT JOIN z USING (doc_id) WHERE t.doc_id NOT IN (SELECT doc_id FROM i)"),
    ("bool_nested", Bool(must=(Bool(should=(_O, _I)), _T)), "reference", "SELECT doc_id, round(x.s + t.s, 6) AS score FROM t JOIN (SELECT doc_id, sum(s) AS s FROM (FROM o UNION ALL FROM i) GROUP BY doc_id) x USING (doc_id)"),
    ("boosted_should", Bool(should=(Match("text", "of", boost=0.5), Match("text", "in", boost=20.0)), boost=2.0), "reference", "SELECT doc_id, round(2 * sum(s), 6) AS score FROM (SELECT doc_id, 0.5 * s AS s FROM o UNION ALL SELECT doc_id, 20 * s FROM i) GROUP BY doc_id"),
):
    _add(_name, f"{_LEAF} {_sql}")(lambda spark, sf, q=_query, m=_sem: _page(Planner(_text(spark, sf), m).hits(q)))


# --- aggregations ---


@_add("terms_agg", f"WITH {_postings()} SELECT term, count(*) AS n FROM p GROUP BY term ORDER BY n DESC, term LIMIT 10")
def terms_agg(spark, sf):
    return aggs.top_terms(_text(spark, sf), "text", 10)


@_add("terms_agg_subset", f"WITH {_postings()} SELECT term, count(DISTINCT doc_id) AS n FROM p WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'fr') GROUP BY term ORDER BY n DESC, term LIMIT 10")
def terms_agg_subset(spark, sf):
    ix = _text(spark, sf)
    return aggs.top_terms(ix, "text", 10, ix.docs.where("lang = 'fr'").select("doc_id"))


@_add("significant_terms", f"WITH {_postings()}, ids AS (SELECT doc_id FROM documents WHERE lang = 'de'), a AS (SELECT term, count(DISTINCT doc_id) AS n FROM p WHERE doc_id IN (FROM ids) GROUP BY term), c AS (SELECT term, count(*) AS cf FROM p GROUP BY term) SELECT term, round(a.n / (SELECT count(*) FROM ids)::DOUBLE / (cf / st.n::DOUBLE), 6) AS score, a.n AS n FROM a JOIN c USING (term), st ORDER BY score DESC, term LIMIT 20")
def significant_terms(spark, sf):
    ix = _text(spark, sf)
    every = aggs.significant_terms(ix, "text", 1 << 30, ix.docs.where("lang = 'de'").select("doc_id"))
    return every.select("term", F.round("score", 6).alias("score"), "n").orderBy(F.desc("score"), "term").limit(20)


# --- trie ---


@_add("trie_longest_prefix", f"""WITH terms AS (SELECT DISTINCT unnest({_TOKENS.format(c='p_name')}) AS term FROM part), w AS (SELECT unnest(['smallish', 'ring', 'xyz', 'bolted']) AS input),
k AS (SELECT input, substr(input, 1, unnest(range(1, length(input) + 1))) AS h FROM w), l AS (SELECT input, max(h) AS h FROM k WHERE EXISTS (FROM terms WHERE starts_with(term, h)) GROUP BY input)
SELECT w.input, CASE WHEN l.h IN (FROM terms) THEN l.h END AS found FROM w LEFT JOIN l USING (input)""")
def trie_longest_prefix(spark, sf):
    words = spark.read.parquet(f"{sf}/part.parquet").select(F.explode(analysis.Analyzer().tokens(F.col("p_name"))).alias("term")).distinct()
    out = prefix.longest_prefix(words, "smallish")
    for w in ("ring", "xyz", "bolted"):
        out = out.union(prefix.longest_prefix(words, w))
    return out


# --- vectors ---

_PROBE = [((7 * i) % 13 - 6) / 10 for i in range(64)]
_SIM = f"round(list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), {_PROBE}::DOUBLE[]), 6)"


def _embeddings(spark, sf):
    return index.build(spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "label", "embedding"), {"embedding": VectorField(64, tables=4, bits=4)}, "vec_id")


@_add("knn_exact", f"SELECT vec_id AS doc_id, {_SIM} AS similarity FROM embeddings ORDER BY similarity DESC, doc_id LIMIT 10")
def knn_exact(spark, sf):
    return knn.nearest(_embeddings(spark, sf), "embedding", _PROBE, 10, digits=6).select("doc_id", "similarity")


@_add("knn_filtered", f"SELECT vec_id AS doc_id, {_SIM} AS similarity FROM embeddings WHERE label = 1 ORDER BY similarity DESC, doc_id LIMIT 10")
def knn_filtered(spark, sf):
    ix = _embeddings(spark, sf)
    return knn.nearest(ix, "embedding", _PROBE, 10, ix.docs.where("label = 1").select("doc_id"), digits=6).select("doc_id", "similarity")


@_add("knn_lsh")
def knn_lsh(spark, sf):
    return knn.nearest(_embeddings(spark, sf), "embedding", _PROBE, 10, exact=False)


_BIGRAMS = f"SELECT {{id}}, unnest(flatten(list_transform(list_transform({_TOKENS.format(c='text')}, lambda w: regexp_replace(w, '[^a-z0-9]', '', 'g')), lambda w: list_transform(range(1, length(w)), lambda i: (strpos('0123456789abcdefghijklmnopqrstuvwxyz', substr(w, i, 1)) - 1) * 36 + strpos('0123456789abcdefghijklmnopqrstuvwxyz', substr(w, i + 1, 1)) - 1)))) AS g FROM {{t}}"


@_add("bigram_counts", f"SELECT doc_id, g::INT AS bigram, count(*) AS n FROM ({_BIGRAMS.replace('{id}', 'doc_id').replace('{t}', 'documents')}) GROUP BY doc_id, g")
def bigram_counts(spark, sf):
    # counted within each row first, so that only a document's different bigrams are dealt out
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    runs = docs.select("doc_id", F.explode(vectors.bigram_runs(analysis.Analyzer().tokens(F.col("text")))).alias("run"))
    each = runs.select("doc_id", vectors.bigram_code(F.col("run")).alias("bigram"), F.expr("length(run) div 3").alias("n"))
    return each.groupBy("doc_id", "bigram").agg(F.sum("n").alias("n"))


_PROBE_TEXT = "that of the and in reth thin"


@_add("bigram_knn", f"""WITH b AS ({_BIGRAMS.replace('{id}', 'item_id').replace('{t}', 'benchmark')}), c AS (SELECT item_id, g, count(*)::DOUBLE AS n FROM b GROUP BY ALL),
q AS (SELECT g, count(*)::DOUBLE AS m FROM ({_BIGRAMS.replace('{id}', '0 AS i').replace('{t}', "(SELECT '" + _PROBE_TEXT + "' AS text)")}) GROUP BY g),
d AS (SELECT item_id, sum(n * m) AS dot FROM c JOIN q USING (g) GROUP BY item_id), z AS (SELECT item_id, sqrt(sum(n * n)) AS size FROM c GROUP BY item_id)
SELECT item_id AS doc_id, 0 AS vec_idx, round(coalesce(dot, 0) / (size * (SELECT sqrt(sum(m * m)) FROM q)), 6) AS similarity FROM z LEFT JOIN d USING (item_id) ORDER BY similarity DESC, doc_id LIMIT 5""")
def bigram_knn(spark, sf):
    items = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", vectors.bigram_vector(analysis.Analyzer().tokens(F.col("text"))).alias("v"))
    ix = index.build(items, {"v": VectorField(vectors.BIGRAMS)}, "item_id")
    probe = spark.range(1).select(vectors.bigram_vector(analysis.Analyzer().tokens(F.lit(_PROBE_TEXT))).alias("v")).first()["v"]
    return knn.nearest(ix, "v", probe, 5, digits=6)


# --- geo ---

_LON, _LAT = "((c_custkey * 37) % 3600) / 10.0 - 180 + 0.05", "((c_custkey * 53) % 1700) / 10.0 - 85 + 0.05"


def _places(spark, sf):
    text = F.expr(f"concat('{{\"type\":\"Point\",\"coordinates\":[', cast({_LON} as double), ',', cast({_LAT} as double), ']}}')")
    rows = spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", text.alias("loc"))
    return _built(spark, sf, "places", lambda: index.build(rows, {"loc": GeoField(3)}, "c_custkey"))


@_add("geo_point", f"SELECT c_custkey AS doc_id, 1.0::DOUBLE AS score FROM customer WHERE ({_LON})::DOUBLE = (SELECT ({_LON})::DOUBLE FROM customer WHERE c_custkey = 5) AND ({_LAT})::DOUBLE = (SELECT ({_LAT})::DOUBLE FROM customer WHERE c_custkey = 5)")
def geo_point(spark, sf):
    return Planner(_places(spark, sf)).hits(GeoPoint("loc", 26.5 - 85 + 0.05, 18.5 - 180 + 0.05))


@_add("geo_polygon_points", f"SELECT c_custkey AS doc_id, 1.0::DOUBLE AS score FROM customer WHERE {_LON} > -20 AND {_LON} < 30 AND {_LAT} > -10 AND {_LAT} < 40")
def geo_polygon_points(spark, sf):
    return Planner(_places(spark, sf)).hits(GeoPolygon("loc", (((-20, -10), (30, -10), (30, 40), (-20, 40), (-20, -10)),)))


@_add("geo_polygon_overlap", "SELECT s_suppkey AS doc_id, 1.0::DOUBLE AS score FROM (SELECT s_suppkey, (s_suppkey * 37) % 340 - 170 AS x, (s_suppkey * 53) % 160 - 80 AS y FROM supplier) WHERE x <= 60 AND x + 4 >= -60 AND y <= 40 AND y + 4 >= -40")
def geo_polygon_overlap(spark, sf):
    box = F.expr(f"concat('{{\"type\":\"Polygon\",\"coordinates\":[[[', x, ',', y, '],[', x + 4, ',', y, '],[', x + 4, ',', y + 4, '],[', x, ',', y + 4, '],[', x, ',', y, ']]]}}')")
    rows = spark.read.parquet(f"{sf}/supplier.parquet").selectExpr("s_suppkey", "(s_suppkey * 37) % 340 - 170 AS x", "(s_suppkey * 53) % 160 - 80 AS y")
    return Planner(index.build(rows.select("s_suppkey", box.alias("area")), {"area": GeoField(2)}, "s_suppkey")).hits(GeoPolygon("area", (((-60, -40), (60, -40), (60, 40), (-60, 40), (-60, -40)),)))


@_add("state_roundtrip", _SQL["term_bm25"])
def state_roundtrip(spark, sf):
    path = _new_path(spark)
    state.save(_text_now(spark, sf), path)
    return _page(Planner(state.load(spark, path)).match_tokens("text", ["in"], "AND", False))


def queries():
    return dict(_Q)


def oracle_sql():
    return dict(_SQL)
