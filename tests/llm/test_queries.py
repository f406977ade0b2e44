"""Each registered query and the pipeline on a small directory of edge rows, and on empty tables."""

import random

import pytest

import corpus_pipeline
from textloom.llm import queries

r = random.Random(41)
WORDS = ["".join(r.choice("abcdefghij") for _ in range(r.randint(3, 8))) for _ in range(500)]


def prose(n):
    return " ".join(r.choice(WORDS) for _ in range(n))


BASE = [prose(r.randint(20, 80)) + "\n" + prose(r.randint(5, 30)) for _ in range(60)]
ITEM = prose(30)
TEXTS = [*BASE, BASE[0], BASE[1], prose(9), None, "", " \n\t", "…", prose(9000), f"{prose(10)} {ITEM} {prose(10)}", f"mail {prose(3)} a.b@mail.com", *(prose(30) + " scoundrel vermin" * 2 for _ in range(30))]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("tables"))
    docs = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(TEXTS)] + [(5, BASE[5], "en", "s", 1), (None, prose(25), None, None, None)]
    rows = {
        "documents": (docs, "doc_id long, text string, lang string, source string, n_chars long"),
        "labels": ([(i, 1, int("scoundrel" in (t or ""))) for i, t in enumerate(TEXTS)] + [(None, 0, 1), (3, None, None)], "doc_id long, quality int, toxic int"),
        "benchmark": ([(1, ITEM), (2, None), (None, "")], "item_id long, text string"),
        "pages": ([(1, "u", "<a>"), (2, "u", "<a>"), (3, None, None), (4, "v", ""), (5, "w", "x" * 700000)], "page_id long, url string, html string"),
        "conversations": ([(1, 0, "user", "hi"), (1, 1, "assistant", "</s>"), (2, 0, None, None), (3, 0, "user", "a")], "conv_id long, turn long, role string, text string"),
    }
    for part, keep in (("full", 1 << 30), ("none", 0)):
        for name, (some, schema) in rows.items():
            spark.createDataFrame(some[:keep], schema).coalesce(2).write.parquet(f"{where}/{part}/{name}.parquet")
    return where, len(docs)


#: Rows of the full tables' results, where they follow from the rows alone.
PER_DOCUMENT = ("op1_pii_surrogates", "op3_kd_shards", "op8_simhash_pivots", "op9_compression_toxicity", "op10_media_columns")


@pytest.mark.parametrize("name", list(queries.queries()))
def test_query_on_edge_rows_and_empty_tables(spark, tables, name):
    where, n = tables
    query = queries.queries()[name]
    got = query(spark, f"{where}/full").collect()
    if name in PER_DOCUMENT:
        assert sorted(x["doc_id"] if x["doc_id"] is not None else -1 for x in got) == sorted([*range(len(TEXTS)), 5, -1])
    elif name == "op2_warc_chunks":
        assert {(x["page_id"], x["record_type"], x["refers_to"]) for x in got} == {(1, "revisit", 2), (2, "response", None), (3, "revisit", 4), (4, "response", None), (5, "response", None)}
    elif name == "op4_reply_trees":
        assert {x["conv_id"] for x in got} == {-1, 1, 2, 3}
    elif name == "op6_latent_decontamination":
        assert [(x["doc_id"], x["item_id"]) for x in got] == [(TEXTS.index(next(t for t in TEXTS if t and ITEM in t)), 1)]
    elif name == "op7_best_fit_packing":
        assert len(got) == n + 1  # the long text is in two pieces
    empty = query(spark, f"{where}/none")
    assert empty.count() == (1 if name == "op4_reply_trees" else 0)
    assert empty.dtypes == query(spark, f"{where}/none").dtypes


def test_pipeline_on_edge_rows_and_empty_tables(spark, tables):
    where, _ = tables
    got = corpus_pipeline.run(spark, f"{where}/full").collect()
    kept = {x["doc_id"] for x in got}
    leak = TEXTS.index(next(t for t in TEXTS if t and ITEM in t))
    blank = {i for i, t in enumerate(TEXTS) if not (t or "").split()}
    # exact copies are emptied by line dedup, and of the texts without words one stays
    assert leak not in kept and len(kept & (blank | {60, 61})) == 1
    assert None in kept and len(kept & set(range(60))) >= 55
    for b in {x["bin_id"] for x in got}:
        mine = sorted((x["offset"], x["tokens"], x["bin_size"]) for x in got if x["bin_id"] == b)
        assert sum(t for _, t, _ in mine) <= mine[0][2]
    assert corpus_pipeline.run(spark, f"{where}/none").count() == 0
