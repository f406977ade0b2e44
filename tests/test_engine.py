"""The search engine on small corpora: documented facts and the surprising rules, in both modes."""

import math

import pytest
from pyspark.sql import functions as F

from textloom.functions import analysis, geo, vectors
from textloom.operators import aggs, index, knn, prefix
from textloom.operators.index import BM25, GeoField, TextField, VectorField
from textloom.plans.planner import Planner, count, search
from textloom.plans.query import OR, Bool, GeoPoint, GeoPolygon, Match, MatchAll, Phrase, Range, Term
from textloom.sources import state
from textloom.streaming import ingest


def corpus(spark, texts, **cfg):
    rows = [(i + 1, t) for i, t in enumerate(texts)]
    return index.build(spark.createDataFrame(rows, "doc_id long, t string"), {"t": TextField(**cfg)})


def ids(df):
    return sorted(r["doc_id"] for r in df.collect())


@pytest.fixture(scope="module")
def words(spark):
    return corpus(spark, ["foo", "bar", "foobar", "foo bar", "bar foo", "barfoo", "bar foo baz"])


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_analysis(spark):
    a = analysis.Analyzer()
    assert one(spark, a.tokens(F.lit(" Rotor, don't   Spin! "))) == ["rotor", "dont", "spin"]
    assert one(spark, a.tokens(F.lit("?!"))) == []
    assert one(spark, analysis.interpunction(F.lit("7;:/8"))) == "7   8"
    # the typographic apostrophe is for elision alone
    assert one(spark, analysis.interpunction(F.lit("l\u2019eau, 'ici'"))) == "l\u2019eau   ici"
    assert one(spark, a.tokens(F.lit("l\u2019eau"))) == ["leau"]
    assert one(spark, analysis.KEYWORD.tokens(F.lit(""))) == [""]
    assert one(spark, analysis.Analyzer(token_filters=(analysis.ngrams(3),)).tokens(F.lit("rotor to"))) == ["rot", "oto", "tor", "ort", "rto"]
    assert one(spark, analysis.Analyzer(token_filters=(analysis.ngrams(3),)).tokens(F.lit("ab"))) == ["ab"]
    assert one(spark, analysis.Analyzer(token_filters=(analysis.edge_ngrams(2, 4),)).tokens(F.lit("rotor to"))) == ["ro", "or", "rot", "tor", "roto", "otor", "to"]


def test_match_modes_and_bool_rules(words):
    assert ids(Planner(words).hits(Match("t", "foo bar"))) == [1, 4, 5, 7]
    assert ids(Planner(words, "strict").hits(Match("t", "foo bar"))) == [4, 5, 7]
    assert ids(Planner(words).hits(Match("t", "foo bar", OR))) == [1, 2, 4, 5, 7]
    foo, bar, baz = (Match("t", w) for w in ("foo", "bar", "baz"))
    assert ids(Planner(words).hits(Bool(must=(foo, bar)))) == [4, 5, 7]
    assert ids(Planner(words).hits(Bool(filter=(foo, bar), must=(baz,)))) == [7]
    assert ids(Planner(words).hits(Bool(must=(foo,), must_not=(bar,)))) == [1, 4, 5, 7]
    assert ids(Planner(words).hits(Bool(filter=(foo,), must_not=(bar,)))) == [1]
    assert ids(Planner(words, "strict").hits(Bool(must=(foo,), must_not=(bar,)))) == [1]
    assert ids(Planner(words).hits(Bool(must=(bar,), should=(baz,)))) == [7]
    assert ids(Planner(words, "strict").hits(Bool(must=(bar,), should=(baz,)))) == [2, 4, 5, 7]
    assert ids(Planner(words).hits(Bool(filter=(bar,), should=(Match("t", "none"),)))) == [2, 4, 5, 7]
    with pytest.raises(ValueError):
        Planner(words).hits(Bool(must_not=(foo,)))
    with pytest.raises(ValueError):
        Planner(words).hits(Match("t", "?!", OR))
    assert ids(Planner(words).hits(Match("t", "?!"))) == [] == ids(Planner(words).hits(Match("no field", "foo")))


def test_queries_on_empty_mapped_fields(spark):
    ix = index.build(spark.createDataFrame([(1, "foo")], "doc_id long, t string"), {"t": TextField(), "none": TextField(), "g": GeoField(), "v": VectorField(2)})
    plan = Planner(ix)
    for q in (Term("none", "foo"), Range("none"), Match("none", "foo"), Match("none", "foo", OR), Match("none", "fo", prefix=True), Phrase("none", "foo bar"), GeoPoint("g", 1, 2)):
        assert plan.hits(q).count() == 0
    assert knn.nearest(ix, "v", [1, 2], 3).count() == 0
    assert ids(ix.ids()) == [1] and ix.get(1).count() == 1 and ix.get(2).count() == 0


def test_query_of_ones_own(words):
    from dataclasses import dataclass

    from textloom.plans.query import Query

    @dataclass(frozen=True)
    class Odd(Query):
        def plan(self, planner):
            return planner.hits(MatchAll()).where("doc_id % 2 = 1")

    assert ids(Planner(words).hits(Bool(must=(Odd(), Match("t", "bar"))))) == [5, 7]
    assert {r["score"] for r in Planner(words).hits(Odd(boost=3.0)).collect()} == {3.0}


def test_query_analyzer_apart(spark):
    ix = corpus(spark, ["Foo Bar", "foo"], analyzer=analysis.KEYWORD)
    assert ids(Planner(ix).hits(Match("t", "foo"))) == [2]
    assert ids(Planner(corpus(spark, ["Foo Bar", "foo"], analyzer=analysis.KEYWORD, query_analyzer=analysis.KEYWORD)).hits(Match("t", "Foo Bar"))) == [1]


def test_paging_and_boost(words):
    assert search(words, MatchAll(), 0, 3).count() == 3 and ids(search(words, MatchAll(), 2, 3)) == [3]
    assert count(words) == 7 and count(words, limit=4) == 4
    with pytest.raises(ValueError):
        search(words, MatchAll(), 5, 3)
    assert {r["score"] for r in Planner(words).hits(MatchAll(boost=2.5)).collect()} == {2.5}


def test_ranking_golden_numbers(spark):
    texts = ["foo foo foo bar", "foo bar bar bar", "bar bar bar bar"]
    got = [(r["doc_id"], r["score"]) for r in search(corpus(spark, texts, ranking=BM25), Match("t", "foo")).collect()]
    assert got[0][0] == 1 and abs(got[0][1] - 0.7385771316718703) < 1e-6 and abs(got[1][1] - 0.4700036292457356) < 1e-6
    got = {r["doc_id"]: r["score"] for r in Planner(corpus(spark, texts)).hits(Match("t", "foo")).collect()}
    assert abs(got[1] - 3 / 4 * math.log10(3 / 2)) < 1e-12
    everywhere = Planner(corpus(spark, texts))
    assert {r["score"] for r in everywhere.hits(Match("t", "bar")).collect()} == {0.0}
    assert ids(everywhere.hits(Bool(must=(Match("t", "bar"), Match("t", "bar"))))) == []


def test_terms_ranges_and_phrases(spark):
    ix = index.build(spark.createDataFrame([(1, ["foo foo foo"]), (2, ["foo", "x bar"]), (3, ["a b c d"]), (4, [""]), (5, []), (6, None)], "doc_id long, t array<string>"), {"t": TextField()})
    plan = Planner(ix)
    assert ids(plan.hits(Term("t", "foo"))) == [1, 1, 1, 2]
    assert ids(plan.hits(Range("t"))) == [1, 2, 3]
    assert ids(plan.hits(Phrase("t", "foo bar"))) == [2]
    assert ids(plan.hits(Phrase("t", "a c"))) == [] and ids(plan.hits(Phrase("t", "a c", 1))) == [3] and ids(plan.hits(Phrase("t", "c a", 3))) == [3]
    assert ix.table("stats", "t").first()["n"] == 3
    numbers = corpus(spark, [str(n) for n in range(100, 201)])
    for bounds, want in (({"gt": "150", "lt": "152"}, [151]), ({"gte": "150", "lt": "152"}, [150, 151]), ({"gt": "150", "lte": "152"}, [151, 152]), ({"gte": "152", "lte": "150"}, []), ({"gt": "150", "gte": "0", "lt": "152"}, [150, 151])):
        assert ids(Planner(numbers).hits(Range("t", **bounds))) == [n - 99 for n in want]


def test_prefixes(spark, words):
    assert ids(Planner(words).hits(Match("t", "foob", prefix=True))) == [3]
    assert ids(Planner(words).hits(Match("t", "foo", prefix=True))) == [1, 4, 5, 7]
    assert ids(Planner(words).search_prefix("t", "foo")) == [1, 3, 4, 5, 7]
    assert ids(Planner(words).hits(Match("t", "bazz", prefix=True))) == [7]
    terms = spark.createDataFrame([("foo",), ("foobar",)], "term string")
    find = lambda t: prefix.longest_prefix(terms, t).first()["found"]
    assert (find("foobarz"), find("fooz"), find("foobx"), find("x"), find("")) == ("foobar", "foo", None, None, None)


def test_aggregations(spark, words):
    assert [(r["term"], r["n"]) for r in aggs.top_terms(words, "t", 2).collect()] == [("bar", 4), ("foo", 4)]
    some = words.docs.where("doc_id in (5, 7)")
    assert [(r["term"], r["n"]) for r in aggs.top_terms(words, "t", 3, some).collect()] == [("bar", 2), ("foo", 2), ("baz", 1)]
    top = aggs.significant_terms(words, "t", 1, some).first()
    assert (top["term"], top["score"], top["n"]) == ("baz", 0.5 / (1 / 7), 1)


def test_vectors(spark):
    ix = index.build(spark.createDataFrame([("a", [[1.0, 2.0, 3.0]]), ("b", [[3.0, -2.0, 1.0], [1.0, 2.0, 2.9]]), ("z", [[0.0, 0.0, 0.0]])], "doc_id string, v array<array<double>>"), {"v": VectorField(3, tables=2)})
    got = knn.nearest(ix, "v", [1, 2, 3], 4).collect()
    assert math.isnan(got[0]["similarity"]) and [(r["doc_id"], r["vec_idx"]) for r in got[1:]] == [("a", 0), ("b", 1), ("b", 0)]
    assert "a" in {r["doc_id"] for r in knn.nearest(ix, "v", [1, 2, 3], 4, exact=False).collect()}
    assert ids(knn.nearest(ix, "v", [1, 2, 3], 4, spark.createDataFrame([("b",)], "doc_id string"))) == ["b", "b"]
    assert knn.bucket_lists(ix.table("buckets", "v")).agg(F.sum(F.size("members"))).first()[0] == 8
    v = one(spark, vectors.bigram_vector(F.array(F.lit("aéb"), F.lit("abc"))))
    assert v[10 * 36 + 11] == 2 and sum(v) == 3 and len(v) == 1296
    with pytest.raises(Exception):
        one(spark, vectors.cosine(F.lit([1.0]), F.lit([1.0, 2.0])))


def test_geo(spark):
    box = '{"type":"Polygon","coordinates":[[[13.3,52.4],[13.5,52.4],[13.5,52.6],[13.3,52.6],[13.3,52.4]]]}'
    multi = '{"type":"MultiPolygon","coordinates":[[[[0,0],[1,0],[1,1],[0,1],[0,0]]],[[[5,5],[6,5],[6,6],[5,6],[5,5]]]]}'
    rows = [("berlin", '{"type":"Point","coordinates":[13.4,52.5]}'), ("paris", '{"type":"Point","coordinates":[2.35,48.85]}'), ("box", box), ("multi", multi), ("line", '{"type":"LineString","coordinates":[[0,0],[1,1]]}')]
    ix = index.build(spark.createDataFrame(rows, "doc_id string, loc string"), {"loc": GeoField(3)})
    around = lambda w, s, e, n: (((w, s), (e, s), (e, n), (w, n), (w, s)),)
    assert ids(Planner(ix).hits(GeoPoint("loc", 52.5, 13.4))) == ["berlin", "box"]
    assert ids(Planner(ix).hits(GeoPoint("loc", 5.5, 5.5))) == ["multi"]
    assert ids(Planner(ix).hits(GeoPolygon("loc", around(12, 52, 14, 53)))) == ["berlin", "box"]
    assert ids(Planner(ix).hits(GeoPolygon("loc", around(13.45, 52.55, 13.6, 52.7)))) == ["box"]
    assert ids(Planner(ix).hits(GeoPolygon("loc", around(0.5, 0.5, 2, 2)))) == ["multi"]
    assert one(spark, geo.geohash(F.lit(57.64911), F.lit(10.40744), 6)) == "u4pruy"


def test_polygons_meet_wherever_their_rings_start(spark):
    square = [(0, 0), (4, 0), (4, 4), (0, 4)]
    others = {"same": square, "edge": [(4, 0), (8, 0), (8, 4), (4, 4)], "corner": [(4, 4), (6, 4), (6, 6), (4, 6)], "inside": [(1, 1), (2, 1), (2, 2), (1, 2)], "across": [(-1, 1), (5, 1), (5, 2), (-1, 2)], "apart": [(5, 5), (6, 5), (6, 6), (5, 6)]}
    rows = []
    for name, ring in others.items():
        for k in range(4):
            turned = ring[k:] + ring[:k]
            rows.append((f"{name}{k}", '{"type":"Polygon","coordinates":[%s]}' % [list(p) for p in [*turned, turned[0]]]))
    ix = index.build(spark.createDataFrame(rows, "doc_id string, loc string"), {"loc": GeoField(3)})
    for k in range(4):
        ring = square[k:] + square[:k]
        assert ids(Planner(ix).hits(GeoPolygon("loc", (tuple(ring) + (ring[0],),)))) == sorted(f"{n}{i}" for n in others if n != "apart" for i in range(4))


def test_covers_of_large_and_small_polygons_meet(spark):
    world = '{"type":"Polygon","coordinates":[[[-170,-80],[170,-80],[170,80],[-170,80],[-170,-80]]]}'
    speck = '{"type":"Polygon","coordinates":[[[13.3,52.4],[13.31,52.4],[13.31,52.41],[13.3,52.41],[13.3,52.4]]]}'
    ix = index.build(spark.createDataFrame([("world", world), ("speck", speck), ("broken", None)], "doc_id string, loc string"), {"loc": GeoField(5)})
    assert ix.table("cells", "loc").where("doc_id = 'world'").count() <= geo.COVER
    box = lambda w, s, e, n: GeoPolygon("loc", (((w, s), (e, s), (e, n), (w, n), (w, s)),))
    assert ids(Planner(ix).hits(box(-100, -50, 100, 60))) == ["speck", "world"]
    assert ids(Planner(ix).hits(box(13.305, 52.405, 13.306, 52.406))) == ["speck", "world"]
    assert ids(Planner(ix).hits(GeoPoint("loc", 10.0, 20.0))) == ["world"]
    bad = index.build(spark.createDataFrame([(1, "{no json")], "doc_id long, loc string"), {"loc": GeoField(3)})
    with pytest.raises(Exception):
        bad.table("geometries", "loc").collect()


def test_index_search_recall(spark):
    """Among near copies the bucket search finds those that the whole search finds; far ones are approximate."""
    import random

    r = random.Random(4)
    base = [[r.gauss(0, 1) for _ in range(16)] for _ in range(60)]
    rows = [(10 * i + k, [x + r.gauss(0, 0.02) for x in v]) for i, v in enumerate(base) for k in range(5)]
    ix = index.build(spark.createDataFrame(rows, "doc_id long, v array<double>"), {"v": VectorField(16, tables=6, bits=4)})
    hit = 0
    for i in range(0, 60, 12):
        hit += len(set(ids(knn.nearest(ix, "v", base[i], 5))) & set(ids(knn.nearest(ix, "v", base[i], 5, exact=False))))
    assert hit >= 0.9 * 25
    planes = VectorField(16).planes()
    assert len(planes) == 4 and all(abs(sum(x * x for x in p) - 1) < 1e-9 and min(p) >= 0 for p in planes[0])
    assert [round(x, 6) for x in one(spark, vectors.normalize(F.lit([3.0, 4.0])))] == [0.6, 0.8]
    assert one(spark, vectors.sign_hash(F.lit([1.0, -1.0]), F.lit([[1.0, 0.0], [0.0, 1.0], [1.0, 0.5]]))) == 0b101


def test_bigram_search_finds_the_text(spark):
    texts = ["the tide comes in at noon", "seven grey geese fly south", "a kettle sings on the stove"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, t string").select("doc_id", vectors.bigram_vector(analysis.Analyzer().tokens(F.col("t"))).alias("v"))
    ix = index.build(rows, {"v": VectorField(vectors.BIGRAMS)})
    for i, t in enumerate(["tide at noon", "grey geese", "kettle on a stove"]):
        assert knn.nearest(ix, "v", one(spark, vectors.bigram_vector(analysis.Analyzer().tokens(F.lit(t)))), 1).first()["doc_id"] == i
    assert sum(one(spark, vectors.bigram_vector(F.array(F.lit("a"))))) == 0


def test_state_of_geo_and_vector_fields(spark, tmp_path):
    rows = [("p", '{"type":"Point","coordinates":[13.4,52.5]}', [1.0, 2.0], "foo bar"), ("q", '{"type":"Point","coordinates":[2.0,48.0]}', [2.0, -1.0], "bar")]
    mapping = {"loc": GeoField(4), "v": VectorField(2, tables=3), "t": TextField(ranking=BM25)}
    ix = index.build(spark.createDataFrame(rows, "doc_id string, loc string, v array<double>, t string"), mapping)
    back = state.persist(ix, str(tmp_path / "p"))
    assert back.facts["t"] == (2, 1.5) and back.mapping["v"].planes() == mapping["v"].planes()
    assert ids(Planner(back).hits(GeoPoint("loc", 52.5, 13.4))) == ["p"]
    assert knn.nearest(back, "v", [1, 2], 1).first()["doc_id"] == "p" and knn.nearest(back, "v", [1, 2], 1, exact=False).first()["doc_id"] == "p"
    hits = lambda i: sorted(map(tuple, Planner(i).hits(Match("t", "foo bar")).collect()))
    assert hits(back) == hits(ix)
    again = state.load(spark, str(tmp_path / "p"), {"t": TextField(), "later": TextField()})
    assert Planner(again).hits(Match("later", "foo")).count() == 0


def test_stream_of_all_kinds_with_an_id_that_comes_again(spark, tmp_path):
    schema = "doc_id long, t string, loc string, v array<double>"
    mapping = {"t": TextField(), "loc": GeoField(3), "v": VectorField(2)}
    for rows in ([(1, "foo", '{"type":"Point","coordinates":[1.0,2.0]}', [1.0, 0.0]), (2, "foo", None, None)], [(1, "bar bar", '{"type":"Point","coordinates":[3.0,4.0]}', [0.0, 1.0])]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        ingest.append_stream(stream, str(tmp_path / "out"), mapping, str(tmp_path / "ck")).awaitTermination()
    ix = ingest.open_stream_index(spark, str(tmp_path / "out"), mapping)
    plan = Planner(ix)
    assert ids(ix.ids()) == [1, 2] and ids(plan.hits(Term("t", "foo"))) == [2] and ids(plan.hits(Term("t", "bar"))) == [1, 1]
    assert ids(plan.hits(GeoPoint("loc", 4.0, 3.0))) == [1] and plan.hits(GeoPoint("loc", 2.0, 1.0)).count() == 0
    assert [r["similarity"] for r in knn.nearest(ix, "v", [0, 1], 5).collect()] == [1.0]


def test_state_and_stream(spark, tmp_path):
    ix = corpus(spark, ["foo bar", "bar foo baz"], ranking=BM25, k1=2.0, b=0.6)
    state.save(ix, str(tmp_path / "s"))
    back = state.load(spark, str(tmp_path / "s"), {"t": TextField()})
    assert (back.mapping["t"].ranking, back.mapping["t"].k1, back.mapping["t"].b) == (BM25, 2.0, 0.6)
    hits = lambda i: sorted(map(tuple, Planner(i).hits(Match("t", "foo")).collect()))
    assert hits(back) == hits(ix)
    with pytest.raises(ValueError):
        state.load(spark, str(tmp_path / "s"), {"t": GeoField()})
    spark.createDataFrame([(1, "foo bar"), (2, "bar")], "doc_id long, t string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, t string").parquet(str(tmp_path / "in"))
    ingest.append_stream(stream, str(tmp_path / "out"), {"t": TextField()}, str(tmp_path / "ck")).awaitTermination()
    assert ids(Planner(ingest.open_stream_index(spark, str(tmp_path / "out"), {"t": TextField()})).hits(Match("t", "foo"))) == [1]
    newest = index.latest(spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "doc_id long, t string, o int"), "doc_id", "o")
    assert [r["t"] for r in newest.collect()] == ["b"]


def test_saved_index_neither_shuffles_nor_loses_occurrences(spark, tmp_path):
    rows = [(1, ["of the of the", None, "the"], "a b"), (2, ["", "of"], ""), (3, None, None), (4, ["of x the"], "a b"), (4, ["the of", "of the"], "c")]
    mapping = {"t": TextField(ranking=BM25), "k": TextField(analysis.KEYWORD, analysis.KEYWORD)}
    for these in (rows, rows[:4]):  # with an id that comes twice, and without
        ix = index.build(spark.createDataFrame(these, "doc_id long, t array<string>, k string"), mapping)
        back = state.persist(index.build(ix.docs, mapping), str(tmp_path / f"p{len(these)}"))
        for name in mapping:
            for table, cols in (("postings", ("doc_id", "pos", "term")), ("lengths", ("doc_id", "dl")), ("tfs", ("term", "doc_id", "tf", "dl")), ("terms", ("term", "df", "cf"))):
                assert sorted(map(tuple, back.table(table, name).select(*cols).collect())) == sorted(map(tuple, ix.table(table, name).select(*cols).collect())), (name, table)
        for q in (Phrase("t", "of the"), Phrase("t", "of the", 1), Range("t", gte="of", lt="thf"), Match("t", "of the"), Match("t", "thex", prefix=True)):
            assert dict(map(tuple, Planner(back).hits(q).collect())) == pytest.approx(dict(map(tuple, Planner(ix).hits(q).collect())))
    # built within each document's row
    plan = back._forms("t")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan
    assert (tmp_path / "p4" / "t" / "forms").exists() and not (tmp_path / "p4" / "t" / "postings").exists()


def test_bigram_counts_are_counted_within_rows(spark, tmp_path):
    from textloom.plans import registry

    texts = [(1, "Abab a b'a 7é7 ab"), (2, ""), (3, None), (4, "x"), (1, "ab"), (5, "aaaa " * 3000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    plain = docs.select("doc_id", F.explode(vectors.bigrams(analysis.Analyzer().tokens(F.col("text")))).alias("bigram")).groupBy("doc_id", "bigram").agg(F.count(F.lit(1)).alias("n"))
    found = registry.bigram_counts(spark, str(tmp_path))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.collect())) and found.dtypes[1:] == [("bigram", "int"), ("n", "bigint")]
    assert "sum(n" in found._jdf.queryExecution().executedPlan().toString()


def test_default_analysis_is_one_pass_with_the_words_of_its_steps(spark):
    import random

    r = random.Random(5)
    pool = [*" \t\n\x0b\x1c\x85\u00a0\u2028\u3000\u180e\u200b!-\\][\"'’^+/§±aBé\u0130ß\U0001f600", "the", "Of"]
    texts = ["".join(r.choice(pool) for _ in range(r.randrange(14))) for _ in range(2000)] + ["", " \u00a0 ", "a \u00a0 \u00a0b \u00a0!", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    old = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower("t"), "['’]", ""), analysis._PUNCTUATION_CLASS, " "), r"^[\s\p{Z}]+|[\s\p{Z}]+\z", "")
    words = F.filter(F.split(old, r"\s+"), lambda t: t.rlike(r"[^\s\p{Z}]"))
    assert [x["t"] for x in df.where(~words.eqNullSafe(analysis.Analyzer().tokens(F.col("t")))).collect()] == []
    # as the SQL has it: a next-line character is no white space, and a blank before it parts words
    assert one(spark, analysis.Analyzer().tokens(F.lit("foo \x85"))) == ["foo", "\x85"]
    plan = df.select(analysis.Analyzer().tokens(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and "regexp_replace" not in plan


def test_dictionary_works_each_rows_tokens_out_once(spark, tmp_path):
    rows = [(1, "b a b"), (2, "a"), (3, ""), (4, None), (None, "z")]
    back = state.persist(index.build(spark.createDataFrame(rows, "doc_id long, t string"), {"t": TextField()}), str(tmp_path / "p"))
    terms = back._terms("t")
    assert sorted(map(tuple, terms.collect())) == [("a", 2, 2), ("b", 1, 2)]
    for made in (terms, back.table("tfs", "t")):
        assert made._jdf.queryExecution().optimizedPlan().toString().count("flatten(values") == 1
    assert "sort_array" not in terms._jdf.queryExecution().optimizedPlan().toString()


def test_prefix_matches_of_a_saved_index_read_its_tokens_once(spark, tmp_path):
    rows = [(1, ["and or and", "andy an"]), (2, ["a and"]), (3, [""]), (4, None), (5, ["the"]), (None, ["and"])]
    ix = index.build(spark.createDataFrame(rows, "doc_id long, t array<string>"), {"t": TextField(ranking=BM25)})
    back = state.persist(index.build(ix.docs, ix.mapping), str(tmp_path / "p"))
    assert sorted(back.table("placed", "t").where("doc_id = 1").select("pos", "term", "dl").collect()) == [(0, "and", 5), (0, "andy", 5), (1, "an", 5), (1, "or", 5), (2, "and", 5)]
    for q in (Match("t", "andq", prefix=True), Match("t", "an", prefix=True), Match("t", "andq orx", OR, prefix=True)):
        assert dict(map(tuple, Planner(back).hits(q).collect())) == pytest.approx(dict(map(tuple, Planner(ix).hits(q).collect())))
    assert dict(map(tuple, Planner(back).search_prefix("t", "and").collect())) == pytest.approx(dict(map(tuple, Planner(ix).search_prefix("t", "and").collect())))
    for found in (Planner(back).hits(Match("t", "andq", prefix=True)), Planner(back).search_prefix("t", "and")):
        found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert "ReusedExchange" in plan and "SortMergeJoin" not in plan and plan.count("explode(values") == 1, plan
