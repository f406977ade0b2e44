"""The training-data operators against brute force, round trips and defined edge cases."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from textloom.llm import kdtree, latent, lines, media, packing, pii, reply_trees, simhash, toxicity, toxicity_selection, warc
from textloom.llm.common import connected_components, ordered_slots

rnd = random.Random(3)
WORDS = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(3, 7))) for _ in range(800)]


def prose(n, r=rnd):
    return " ".join(r.choice(WORDS) for _ in range(n))


def docs(spark, texts, **more):
    rows = [(i, t, *(v[i] for v in more.values())) for i, t in enumerate(texts)]
    kinds = "".join(f", {k} string" for k in more)
    return spark.createDataFrame(rows, f"doc_id long, text string{kinds}")


EDGES = [None, "", " ", "\n\n", "one", "…", "x" * 70000, prose(6000)]


# --- shared helpers ---


def test_components_against_union_find(spark):
    r = random.Random(1)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(300)] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, i) for i in range(5001, 5100)]
    root = {}

    def find(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
    want = {x: find(x) for e in edges if e[0] != e[1] for x in e}
    got = connected_components(spark.createDataFrame(edges, "a long, b long"), "test")
    assert sorted(map(tuple, got.collect())) == sorted(want.items())
    assert connected_components(spark.createDataFrame([], "a long, b long"), "test").count() == 0


def test_ordered_slots_are_gapless(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), (1000 - F.col("id")).alias("o")).union(spark.createDataFrame([(None, 5), (None, 4)], "g long, o long"))
    got = defaultdict(list)
    for r in ordered_slots(df, "g", ["o"], "slot", "test").collect():
        got[r["g"]].append((r["o"], r["slot"]))
    for rows in got.values():
        assert [s for _, s in sorted(rows)] == list(range(len(rows)))


# --- 1: PII ---


def test_pii_formats_and_coreference(spark):
    a = "Write to Ann.Lee@mail3.example.com or ann.lee@MAIL3.example.com, call +1 (017) 555-7713 or (017) 555-7713."
    b = 'Card 9807915762804490 and 4111 1111 1111 1111, host 97.51.17.173, local 192.168.3.4, token = "cf1d64a9a4cd9723e1f4eafc27395915e6868ffa", TOKEN = "CF1D64A9A4CD9723E1F4EAFC27395915E6868FFA", 123-45-6789.'
    c = "Mr. Paul Smith met Mary Jones and MARY JONES; Иван Петров said so. In 1999, 12 of 4,000 came at 10.30."
    rows = pii.replace_pii(docs(spark, [a, b, c, None, "", "plain text, 3.14 and 2024-01-02"], source=["s"] * 6), key=pii.QUERY_KEY).orderBy("doc_id").collect()
    x, y, z = (r["text"] for r in rows[:3])
    for old in ("nn.Lee", "555-7713", "mail3", "9807915762804490", "4111 1111", "97.51.17.173", "cf1d64a9", "CF1D64", "123-45", "192.168.3.4", "Smith", "Jones", "JONES", "Петров"):
        assert old not in x + y + z
    mails = re.findall(r"\S+@[\w.]+\w", x)
    assert mails[0].lower() == mails[1].lower() and mails[0][0].isupper() and mails[1][0].islower() and ".example.com" in mails[0]
    phones = re.findall(r"\(\d{3}\) \d{3}-\d{4}", x)
    assert len(phones) == 2 and phones[0] == phones[1] and "+1 (" in x
    cards = re.search(r"Card (\d{16}) and ((?:\d{4} ){3}\d{4}),", y)
    luhn = lambda s: pii.luhn(s[:-1]) == int(s[-1])
    assert luhn(cards[2].replace(" ", "")) and luhn(cards[1]) == luhn("9807915762804490")
    assert re.search(r"host \d+\.\d+\.\d+\.\d+, local 192\.168\.\d+\.\d+", y)
    tokens = re.findall(r'"([0-9a-fA-F]{40})"', y)
    assert tokens[0].upper() == tokens[1] and tokens[0].islower()
    m = re.match(r"Mr\. (\w+) (\w+) met (\w+) (\w+) and (\w+) (\w+); (\w+) (\w+) said", z)
    assert m[1] in pii.GIVEN["latin", "m"] and m[3] in pii.GIVEN["latin", "f"] and m[7] in pii.GIVEN["cyrillic", "m"]
    assert (m[3].upper(), m[4].upper()) == (m[5], m[6])
    assert z.endswith("In 1999, 12 of 4,000 came at 10.30.")
    assert rows[3]["text"] is None and rows[4]["text"] == "" and rows[5]["text"] == "plain text, 3.14 and 2024-01-02"
    assert rows[0]["source"] == "s" and rows[5]["n_entities"] == 0


def test_pii_other_scripts_and_whole_domains(spark):
    text = "иван.петров@mail.ru j.doe@hr.smith-family.com a.b@firm.co.uk müller@post.example.org"
    out = pii.replace_pii(docs(spark, [text]), key=b"another key").first()["text"].split()
    assert all(x not in " ".join(out) for x in ("иван", "петров", "mail", "hr.", "smith", "family", "firm", "müller", "post"))
    assert re.fullmatch(r"[а-яё\u0450-\u047f]{4}\.[а-яё\u0450-\u047f]{6}@[a-z]{4}\.ru", out[0])
    assert re.fullmatch(r"[a-z]\.[a-z]{3}@[a-z]{2}\.[a-z]{5}-[a-z]{6}\.com", out[1])
    assert re.fullmatch(r"[a-z]\.[a-z]@[a-z]{4}\.co\.uk", out[2]) and out[3].endswith(".example.org")
    assert len({pii.reshape(chr(c), b"k", "t") for c in range(0x430, 0x450)}) == 32
    with pytest.raises(TypeError):
        pii.replace_pii(docs(spark, [text]))


def test_pii_distinct_and_coreferent_over_a_table(spark):
    r = random.Random(31)
    mails = [f"{r.choice('abcdefgh')}{i}@{r.choice(['mail', 'post', 'web'])}.{r.choice(['com', 'org'])}" for i in range(80)]
    phones = [f"({r.randint(100, 999)}) {r.randint(100, 999)}-{r.randint(1000, 9999)}" for _ in range(60)]
    people = [f"Mr. {g} {s}" for g in ("James", "John", "Paul") for s in ("Reed", "Stone", "Marsh", "Field")]
    known = mails + phones + people
    texts = [" ; ".join(r.choice(known) for _ in range(12)) for _ in range(200)]
    rows = pii.replace_pii(docs(spark, texts), key=pii.QUERY_KEY).collect()
    became = defaultdict(set)
    for x in rows:
        for old, new in zip(texts[x["doc_id"]].split(" ; "), x["text"].split(" ; "), strict=True):
            became[old].add(new)
    assert all(len(v) == 1 for v in became.values())  # one surrogate for all mentions
    new = [next(iter(v)) for v in became.values()]
    assert len(set(new)) == len(new) and not set(new) & set(became)  # no two alike, and none a real one


def test_pii_clashing_columns_long_texts_and_empty_tables(spark):
    df = docs(spark, ["mail a@b.com", None], kinds=["x", "y"], n_entities=["1", "2"], _later=["p", "q"], _id=["r", "s"])
    out = pii.replace_pii(df, key=pii.QUERY_KEY)
    rows = out.orderBy("doc_id").collect()
    assert out.columns[:6] == df.columns and len(out.columns) == 8
    assert (rows[0]["kinds"], rows[0]["n_entities"], rows[0]["_later"], rows[0]["_id"]) == ("x", "1", "p", "r") and rows[0][6] == 1 and rows[0][7] == ["email"]
    assert pii.replace_pii(df.limit(0), key=pii.QUERY_KEY).count() == 0
    spans = pii.detect(" ".join(f"u{i}@mail.com" for i in range(30000)))
    assert len(spans) == 30000 and spans == sorted(spans)


def test_pii_permutations_are_bijections():
    for kind, values in {"phone": [f"{i:03d}" for i in range(1000)], "card": [f"{i:04d}" for i in range(10000)], "ipv4": [f"10.0.{i}.{j}" for i in range(40) for j in range(40)]}.items():
        assert len({pii.surrogate(v, kind, key=pii.QUERY_KEY) for v in values}) == len(values)


def test_pii_collisions_are_resolved(spark, monkeypatch):
    real = pii.surrogate
    people = [f"Mr. {g} {s}" for g in ("Paul", "John") for s in ("Alder", "Birch", "Cedar", "Daley")]
    found = pii.entities(docs(spark, [", ".join(people)]), "doc_id", "text")
    # names drawn at attempt 0 fall on two values only
    module = pii

    def narrow(canon, kind, attempt=0, key=module.QUERY_KEY):
        return real(canon, kind, attempt, key=key) if attempt else "m|paul|" + "ab"[len(canon) % 2]

    drawn = {}
    monkeypatch.setattr(pii, "_drawn", lambda rows, key: rows.sparkSession.createDataFrame([(r["kind"], r["canon"], r["attempt"], narrow(r["canon"], r["kind"], r["attempt"], key)) for r in rows.collect()] or [], "kind string, canon string, attempt int, new string"))
    drawn = pii.resolve(found, pii.QUERY_KEY).collect()
    assert len(drawn) == 8 == len({r["new"] for r in drawn}) and any(r["attempt"] for r in drawn)


def test_pii_later_attempts_reach_the_text(spark, monkeypatch):
    later = [("name", "m|paul|alder", 2, "")]
    monkeypatch.setattr(pii, "resolve", lambda found, key: found.sparkSession.createDataFrame(later, "kind string, canon string, attempt int, new string"))
    got = [r["text"] for r in pii.replace_pii(docs(spark, ["Mr. Paul Alder", "Mr. Paul Birch"]), key=pii.QUERY_KEY).orderBy("doc_id").collect()]
    assert got[0] == pii.render("Mr. Paul Alder", "name", pii.surrogate("m|paul|alder", "name", 2, key=pii.QUERY_KEY))
    assert got[1] == pii.render("Mr. Paul Birch", "name", pii.surrogate("m|paul|birch", "name", 0, key=pii.QUERY_KEY))


def test_pii_names_stay_distinct_when_the_lists_are_used_up(spark, monkeypatch):
    monkeypatch.setattr(pii, "MAX_ATTEMPTS", 2)
    people = [f"Mr. {g}" for g in pii.GIVEN["latin", "m"]] + [f"Госпожа {g}" for g in pii.GIVEN["cyrillic", "f"]] + ["Mr. Barbarbarbarden", "Mr. Paul Smith"]
    found = pii.entities(docs(spark, [", ".join(people)]), "doc_id", "text")
    drawn = pii.resolve(found, pii.QUERY_KEY).collect()
    canons = {r["canon"] for r in drawn}
    shown = {r["new"].replace("||", "|").rstrip("|") for r in drawn}
    assert len(drawn) == len(people) == len(shown) and not {c.replace("||", "|").rstrip("|") for c in canons} & shown
    out = pii.replace_pii(docs(spark, [", ".join(people)]), key=pii.QUERY_KEY).first()["text"].split(", ")
    assert len(set(out)) == len(people) and not set(out) & set(people)
    assert all(o.split()[0] == p.split()[0] for o, p in zip(out, people, strict=True))


# --- 2: WARC ---


def test_warc_chunks_and_revisits(spark):
    big = "é" * 1000 + "\r\n\r\nWARC/1.1\r\n\r\n" * 50
    rows = [(1, "http://a/ b\r\nc", "same", 0), (2, None, "same", 0), (3, "u", None, 0), (4, "u", "", 0), (5, "u", big, 0), (7, "u", big, 0), (6, "u", big + "x", 0), (None, "u", "lone", 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, payload int")
    got = {r["page_id"]: r for r in warc.roundtrip(df, "page_id", "html", "url", chunk_bytes=257).collect()}
    assert len(got) == len(rows)
    for i, _, html, _ in rows:
        raw = (html or "").encode()
        assert got[i]["payload_bytes"] == len(raw)
        assert got[i]["payload_digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode()
    assert {i: (r["record_type"], r["refers_to"]) for i, r in got.items()} == {1: ("revisit", 2), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None), 5: ("revisit", 7), 7: ("response", None), 6: ("response", None), None: ("response", None)}
    assert got[7]["segments"] == -(-len(big.encode()) // 257)
    assert warc.roundtrip(df.limit(0), "page_id", "html", "url").count() == 0
    assert {r["record_type"] for r in warc.roundtrip(df.where("page_id < 3"), "page_id", "html", "url", least=5).collect()} == {"response"}


def test_warc_chunk_table_carries_running_digests(spark):
    df = spark.createDataFrame([(1, "u", "abcdefghij")], "i long, u string, p string")
    chunks = warc.chunk_records(warc.mark_revisits(df, "i", "p", "u"), 4).orderBy("chunk_no").collect()
    assert [bytes(c["data"]) for c in chunks] == [b"abcd", b"efgh", b"ij"]
    assert [c["running"] for c in chunks] == [warc.b32(hashlib.sha1(b"abcdefghij"[:n]).digest()) for n in (4, 8, 10)]


def test_warc_payloads_of_line_ends_and_many_chunks(spark):
    r = random.Random(17)
    rows = [(i, "u", bytes(r.choice(b"\r\n\r\nab") for _ in range(n))) for i, n in enumerate([1, 2, 3, 4, 5, 50, 700, 3000] * 6)]
    rows += [(100 + n, "u", b"\r\n" * n + b"\r" * (n % 3)) for n in range(8)]
    rows.append((200, "u", r.randbytes(9 * warc.CHUNK_BYTES + 5)))
    df = spark.createDataFrame(rows, "page_id long, url string, html binary")
    for size, part in ((warc.CHUNK_BYTES, df), (7, df.where("length(html) < 100"))):
        got = {x["page_id"]: x for x in warc.roundtrip(part, "page_id", "html", "url", chunk_bytes=size).collect()}
        assert all(got[i]["payload_digest"] == warc.b32(hashlib.sha1(p).digest()) for i, _, p in rows if i in got) and len(got) == part.count()
    assert warc.roundtrip(df, "page_id", "html", "url").where("page_id = 200").first()["segments"] == 10


def test_warc_damaged_archives_raise():
    whole = b""
    for n, chunk in enumerate((b"abcd", b"ef\r\n")):
        kind = b"continuation" if n else b"response"
        http = b"" if n else b"HTTP/1.1 200 OK\r\n\r\n"
        run = warc.b32(hashlib.sha1(b"abcdef\r\n"[: 4 + 4 * n]).digest()).encode()
        whole += b"WARC/1.1\r\nWARC-Type: %s\r\nWARC-Record-ID: <urn:row:1>\r\nWARC-Payload-Digest: sha1:%s\r\nX-Running-Digest: sha1:%s\r\nX-Payload-Length: 8\r\n" % (kind, warc.b32(hashlib.sha1(b"abcdef\r\n").digest()).encode(), run)
        whole += b"WARC-Segment-Number: %d\r\n" % (n + 1) + (b"WARC-Segment-Origin-ID: <urn:row:1>\r\nWARC-Segment-Total-Length: 8\r\n" if n else b"")
        whole += b"Content-Length: %d\r\n\r\n" % (len(http) + 4) + http + chunk + b"\r\n\r\n"

    def read(raw):
        parts = raw.split(warc.GAP)
        return list(warc.records_of(parts if parts[-1] else parts[:-1]))

    assert read(whole) == [(1, 8, warc.b32(hashlib.sha1(b"abcdef\r\n").digest()), "response", None, 2)]
    assert read(b"") == []
    cuts = [whole[:n] for n in range(5, len(whole) - 4, 7)]
    for bad in [*cuts, whole.replace(b"abcd", b"abcx"), whole.replace(b"WARC/1.1", b"WRC/1.1", 1), whole[whole.index(b"WARC/1.1", 9) :]]:
        with pytest.raises(ValueError):
            read(bad)


# --- 3: k-d tree ---


def test_kd_shards_law_groups_and_slots(spark):
    r = random.Random(5)
    texts = [prose(r.randint(1, 60), r) for _ in range(1500)] + ["hot text " * 5] * 700 + [prose(8, r)] * 4 + [None, ""]
    df = docs(spark, texts, lang=[r.choice(["en", "de", None]) for _ in texts], source=[r.choice(["a", "b", "c"]) for _ in texts])
    got = kdtree.kd_shards(df, shards=8).collect()
    assert sorted(x["doc_id"] for x in got) == list(range(len(texts)))
    size, slots, where = Counter(), defaultdict(list), defaultdict(set)
    for x in got:
        raw = (texts[x["doc_id"]] or "").encode()
        assert (x["size"], x["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
        size[x["shard"]] += x["size"]
        slots[x["shard"]].append(x["slot"])
        where[raw].add(x["shard"])
    assert set(size) == set(range(8)) and max(size.values()) - min(size.values()) < 0.02 * max(size.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len(where[texts[-3].encode()]) == 1
    assert kdtree.kd_shards(df.limit(0), shards=8).count() == 0
    assert {x["shard"] for x in kdtree.kd_shards(df, target_bytes=sum(size.values())).collect()} == {0}


def brute_kd(points, leaves, first=0):
    """{row: leaf} of rows (row, size, text hash, id, coordinates), node by node over sorted lists."""
    if leaves == 1 or not points:
        return {p[0]: first for p in points}
    dims = range(len(points[0][4]))
    spread = [max(p[4][d] for p in points) - min(p[4][d] for p in points) for d in dims]
    dim = spread.index(max(spread))
    weight = sum(p[1] for p in points)
    want, leaf, rest = weight * (leaves // 2) / leaves, weight / leaves, weight
    place = lambda p: (p[4][dim] << 128) + (p[2] + (1 << 63) << 64) + p[3] + (1 << 63)
    side, cut = {}, None
    while cut is None:
        free = sorted((place(p), p[1], p[2]) for p in points if p[2] not in side)
        before = 0
        for key, size, text in free:
            if before + size > want:
                break
            before += size
        else:
            cut = 1 << 160
            break
        for depth in range(1, 10):
            shift = 144 - 16 * depth
            bucket = [x for x in free if x[0] >> shift == key >> shift]
            left, w = sum(x[1] for x in free if x[0] >> shift < key >> shift), sum(x[1] for x in bucket)
            miss = min(left + w - want, want - left)
            if w > 0.002 * leaf and depth == 5 and w <= leaf and miss > 0.005 * leaf and (w <= want or w <= rest - want):
                side[text] = w > want
                want, rest = want - w * (w <= want), rest - w
                break
            if w <= 0.002 * leaf or depth == 9 or (depth == 5 and w <= leaf):
                cut = (key >> shift) + (left + w - want < want - left) << shift
                break
    right = {p[0] for p in points if side.get(p[2], place(p) >= cut)}
    halves = [p for p in points if p[0] not in right], [p for p in points if p[0] in right]
    return brute_kd(halves[0], leaves // 2, first) | brute_kd(halves[1], leaves - leaves // 2, first + leaves // 2)


@pytest.mark.parametrize("leaves", [3, 8])
def test_kd_shards_equal_a_tree_cut_node_by_node(spark, leaves):
    r = random.Random(15)
    texts = [prose(r.randint(1, 20), r) for _ in range(400)] + ["hot text " * 5] * 250 + [x for _ in range(12) for x in [prose(90, r)] * 6] + [None, "", "x" * 9000]
    lang, source = [r.choice(["en", "de", None]) for _ in texts], [r.choice("abcdef") for _ in texts]
    df = docs(spark, texts, lang=lang, source=source, node=["x"] * len(texts), shard=["x"] * len(texts), th=["x"] * len(texts))
    got = {x["doc_id"]: x["shard"] for x in kdtree.kd_shards(df, shards=leaves).collect()}
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    size = [len((t or "").encode()) + 1 for t in texts]
    text = [signed(xxhash.xxh64(t or "", seed=42).intdigest()) for t in texts]
    code = lambda v: xxhash.xxh64("\0null" if v is None else v, seed=42).intdigest() >> 48
    codes = [(min(65535, int(np.floor(np.log2(n) * 2048))), code(a), code(b)) for n, a, b in zip(size, lang, source, strict=True)]
    least = {}
    for h, c in zip(text, codes, strict=True):
        least[h] = min(least.get(h, c[1:]), c[1:])
    codes = [(c[0], *least[h]) for h, c in zip(text, codes, strict=True)]
    total = sum(size)
    before = [{} for _ in range(3)]
    for d in range(3):
        for v in {c[d] for c in codes}:
            before[d][v] = int(sum(n for n, c in zip(size, codes, strict=True) if c[d] < v) / total * 65535)
    rows = [(i, size[i], text[i], i, tuple(before[d][codes[i][d]] for d in range(3))) for i in range(len(texts))]
    assert got == brute_kd(rows, leaves)
    where, load = defaultdict(set), Counter()
    for i, s in got.items():
        where[texts[i] or ""].add(s)
        load[s] += size[i]
    of = Counter()
    for t, n in zip(texts, size, strict=True):
        of[t or ""] += n
    assert all(len(w) == 1 for t, w in where.items() if of[t] < 0.9 * total / leaves)
    assert max(load.values()) - min(load.values()) < 0.02 * total / leaves


# --- 4: reply trees ---


def test_reply_paths_rank_and_cycles(spark):
    nodes = [("t", 1, None, 1.0), ("t", 2, 1, 0.0), ("t", 3, 1, 5.0), ("t", 4, 3, 5.0), ("t", 5, 2, 9.0), ("t", 6, 99, 0.5), ("c", 1, 2, 0.0), ("c", 2, 1, 0.0), ("c", 3, 2, 0.0), ("d", 1, None, 0.0)]
    df = spark.createDataFrame(nodes, "tree string, node long, parent long, score double")
    paths = defaultdict(list)
    found = reply_trees.reply_paths(df)
    for r in found.collect():
        paths[r["tree"], r["leaf"]].append((r["up"], r["node"]))
    assert {k: [n for _, n in sorted(v, reverse=True)] for k, v in paths.items()} == {("t", 4): [1, 3, 4], ("t", 5): [1, 2, 5], ("t", 6): [6], ("d", 1): [1]}
    ranks = {(r["tree"], r["rank"]): r["leaf"] for r in reply_trees.rank_paths(found, df.select("tree", "node", "score"), keep=2).collect()}
    assert ranks == {("t", 1): 4, ("t", 2): 5, ("d", 1): 1}


def test_conversations_read_back(spark):
    nasty = r"a\</s>[INST]\n <\s> [\/INST] [[INST]] \\ </s"
    rows = [(1, t, ("user", "assistant")[t % 2], nasty + str(t), 7) for t in range(70)] + [(2, 0, None, None, 7), (2, 0, "a\nb\\n", "x", 7), (None, 3, "assistant", "lone\n", 7), (3, 1, "assistant", "", 7), (3, 1, "assistant", "", 7)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, tree int")
    out = reply_trees.conversations_formatted(df)
    got = {r["conv_id"]: r for r in out.select("conv_id", "formatted", reply_trees.parse_turns(F.col("formatted")).alias("turns"), reply_trees.loss_text(F.col("formatted"), F.col("loss")).alias("learnt")).collect()}
    assert set(got) == {1, 2, 3, None}
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [(("user", "assistant")[t % 2], nasty + str(t)) for t in range(70)]
    assert got[1]["learnt"] == "".join(nasty + str(t) for t in range(1, 70, 2))
    assert [(t["role"], t["text"]) for t in got[2]["turns"]] == [("", ""), ("a\nb\\n", "x")]
    assert [(t["role"], t["text"]) for t in got[None]["turns"]] == [("assistant", "lone\n")] and got[None]["learnt"] == "lone\n"
    assert len(got[3]["turns"]) == 2
    assert got[1]["formatted"].count("<s>[INST]") == 70
    assert reply_trees.conversations_formatted(df.limit(0)).count() == 0


# --- 5: line dedup ---


def brute_lines(texts):
    words = lambda s: [w.lower() for w in re.findall(r"[A-Za-z0-9\x80-\U0010ffff]+", s)]
    rows = [(d, n, tuple(words(line))) for d, t in enumerate(texts) if t is not None for n, line in enumerate(t.split("\n"))]
    rows = [r for r in rows if r[2]]
    first = {}
    for d, n, w in rows:
        first.setdefault(w, (d, n))
    links = defaultdict(set)
    sets = {w: set(w) for w in first}
    for a, b in combinations(sets, 2):
        x, y = sets[a], sets[b]
        if 5 * len(x & y) >= 4 * len(x | y):
            links[a].add(b)
            links[b].add(a)
    out = {}
    for d, n, w in rows:
        early = min((first[o] for o in links[w]), default=(1 << 60, 0))
        out[d, n] = (len(links[w]), (d, n) == first[w] and first[w] < early)
    return out


def some_lines(seed, groups=12):
    r = random.Random(seed)
    bases = [prose(r.randint(1, 30), r) for _ in range(groups)]

    def line():
        if r.random() < 0.4:
            return prose(r.randint(1, 25), r)
        w = r.choice(bases).split()
        for _ in range(r.choice([0, 0, 1, 2, 4])):
            w[r.randrange(len(w))] = r.choice(WORDS)
        return " ".join(w).upper() if r.random() < 0.1 else " ".join(w)

    return ["\n".join(line() for _ in range(r.randint(1, 8))) for _ in range(120)] + EDGES


@pytest.mark.parametrize("seed", [1, 2])
def test_line_dedup_against_brute_force(spark, seed, monkeypatch):
    if seed == 2:  # many chunks
        monkeypatch.setattr(lines.prefix_entries, "__defaults__", (3,))
        monkeypatch.setattr(lines.verified, "__defaults__", ((3, 3),))
        monkeypatch.setattr(lines, "PART_ENTRIES", 400)
    texts = some_lines(seed)
    want = brute_lines(texts)
    rows = lines.classify_lines(docs(spark, texts, line_no=["x"] * len(texts))).collect()
    assert {(r["doc_id"], r["line_no"]): (r["n_links"], r["kept"]) for r in rows} == want
    out = lines.dedup_lines(docs(spark, texts, line_no=["x"] * len(texts)))
    for r in out.collect():
        t = texts[r["doc_id"]]
        assert r["text"] == (None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if want.get((r["doc_id"], n), (0, True))[1]))
        assert r["line_no"] == "x"


def test_parity_sketches_never_hide_a_pair():
    r = np.random.default_rng(5)
    sizes = [1, 3, 20, 57, 58, 60, 110, 116, 130, 300]
    sets = [np.unique(r.integers(0, 1 << 58, n, np.uint64)) for n in sizes for _ in range(6)]
    sets += [np.unique(np.concatenate([s[: len(s) - len(s) // 9], r.integers(0, 1 << 58, len(s) // 12, np.uint64)])) for s in sets]
    n = np.array([len(s) for s in sets])
    first = np.cumsum(n) - n
    sig = lines.sketches(np.concatenate(sets), first)
    blob = lines.pack_entries(np.arange(len(n), dtype=np.uint32), n, n, n.astype(np.int64), sig)
    back = lines.unpack_entries(blob)
    assert (back[1] == n).all() and (back[3] == n).all() and (back[4][n >= lines.WIDER] == sig[n >= lines.WIDER]).all()
    a, b = (x.ravel() for x in np.meshgrid(np.arange(len(n)), np.arange(len(n))))
    differ = np.array([len(np.setxor1d(sets[i], sets[j])) for i, j in zip(a, b, strict=True)])
    assert lines.apart(n, back[4], a, b, differ).all()
    most = n[a] + n[b] - 2 * lines.overlap_needed(n[a], n[b])
    passed = lines.apart(n, back[4], a, b, most)
    assert passed[differ <= most].all() and passed[differ > most].mean() < 0.2


def test_line_dedup_clashing_columns_null_ids_and_repeated_rows(spark):
    a, b = prose(12), prose(15)
    rows = [(1, a + "\n" + b, "p"), (1, a + "\n" + b, "p"), (None, b, "q"), (2, a, "r"), (3, None, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id string").withColumns({"_gone": F.lit(1), "id": F.lit("x"), "line_no": F.lit("y"), "cls": F.lit(2), "a.b": F.lit(3)})
    got = sorted(((r["doc_id"] or 0, r["text"], r["_id"]) for r in lines.dedup_lines(df).collect()), key=str)
    # the row without an id comes first and keeps its line; the repeated rows go alike
    assert got == sorted([(0, b, "q"), (1, a, "p"), (1, a, "p"), (2, "", "r"), (3, None, "s")], key=str)
    assert lines.dedup_lines(df).columns == df.columns
    assert lines.dedup_lines(df.limit(0)).count() == 0


def test_line_dedup_empty(spark):
    assert lines.classify_lines(docs(spark, ["x"]).limit(0)).count() == 0


# --- 6: decontamination ---


def test_latent_finds_leaks_and_paraphrases(spark):
    r = random.Random(9)
    items = [prose(n, r) for n in (14, 20, 33, 40, 55, 64)] + [None, ""]
    noise = [prose(r.randint(5, 300), r) for _ in range(300)]
    texts, want = list(noise), set()
    for k in range(60):
        i = k % 6
        w = items[i].split()
        if k % 3 == 1:
            w = [x if r.random() > 0.12 else r.choice(WORDS) for x in w]
        texts.append(prose(r.randint(0, 90), r) + " | " + " ".join(w).upper() + "!\n" + prose(r.randint(0, 90), r))
        want.add((len(texts) - 1, i))
    texts += EDGES
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]) for x in latent.leaks(docs(spark, texts, item_id=["x"] * len(texts)), bench).collect()}
    assert len(got & want) >= 57 and got <= want
    kept = {x["doc_id"] for x in latent.decontaminate(docs(spark, texts, _x=["x"] * len(texts)), bench).collect()}
    assert kept == set(range(len(texts))) - {d for d, _ in got}
    assert latent.leaks(docs(spark, texts), bench.limit(0)).count() == 0
    assert latent.leaks(docs(spark, texts).limit(0), bench).count() == 0


def planted_recall(spark, lengths, share, each=60):
    """Of planted copies that a word-by-word scan accepts, the part that is found."""
    r = random.Random(12)
    texts, items = [prose(300, r) for _ in range(300)], []
    want = set()
    for n in lengths:
        for _ in range(each):
            w = prose(n, r).split()
            copy = [r.choice(WORDS) if r.random() < share else x for x in w]
            item = latent.Item.of(len(items), " ".join(w))
            text = " ".join([prose(r.randint(60, 120), r), *copy, prose(120, r)])
            words = latent.Words(latent.pa.array([text], latent.pa.large_string())).hash.tolist()
            if latent.common_subsequence(item.whole, item.n, words) >= item.n / 2 and latent.common_subsequence(item.answer, item.n_answer, words) >= item.n_answer / 2:
                want.add((len(texts), item.ident))
            texts.append(text)
            items.append(" ".join(w))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]) for x in latent.leaks(docs(spark, texts), bench).collect()}
    return len(got & want) / len(want)


def every_window(texts, rows, wide):
    """The findings of all windows of all documents, one after the other."""
    out, step = {}, latent.STEP
    for d, t in enumerate(texts):
        w = latent.Words(latent.pa.array([t or ""], latent.pa.large_string())).hash
        if not len(w):
            continue
        for r in rows:
            it = latent.Item(r["item_id"], np.frombuffer(r["words"], np.uint64), np.frombuffer(r["tail"], np.uint64))
            me = np.frombuffer(r["vector"], np.float32).astype(float)
            margin = it.window // 4 + step
            n_blocks = -(-len(w) // step)
            for b in range(max(1, n_blocks - it.window // step + 1)):
                a, z = b * step, min(len(w), b * step + it.window)
                v = wide[latent.feature(w[a:z])].astype(float).sum(axis=0)
                if round(float(v @ me) / (np.linalg.norm(v) + 1e-12), 6) < round(r["threshold"], 6):
                    continue
                span = w[max(0, a - margin) : z + margin].tolist()
                got, end = latent.common_subsequence(it.whole, it.n, span), latent.common_subsequence(it.answer, it.n_answer, span)
                if got >= it.n / 2 and end >= it.n_answer / 2:
                    out[d, it.ident] = max(out.get((d, it.ident), (0, 0)), (got / it.n, end / it.n_answer))
    return out


@pytest.mark.parametrize("run", [4096, 16])
def test_latent_search_against_every_window(spark, run, monkeypatch):
    r = random.Random(21)
    items = [prose(n, r) for n in (1, 2, 5, 9, 12, 17, 30, 30, 47, 100, 260)] + [None, "?!"]
    items[7] = items[6]
    texts = [prose(r.randint(0, 60), r) for _ in range(60)]
    for i, item in enumerate(items[:11]):
        w = item.split()
        texts += [item, prose(3, r) + " " + item, prose(333, r) + "\n" + " ".join(x if r.random() > 0.25 else r.choice(WORDS) for x in w) + " " + prose(50, r), " ".join(w[: len(w) // 2])]
    texts += EDGES
    df, bench = docs(spark, texts), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    counts, passages = latent.document_frequencies(df)
    idf = latent.inverse_frequencies(counts, passages)
    v, s = latent.factors(latent.range_product(df, idf))
    wide = (v / s * idf[:, None]).astype(np.float32)
    rows = latent.item_rows(bench, wide, counts, "item_id", "text").collect()
    assert [x["item_id"] for x in rows] == list(range(11))
    monkeypatch.setattr(latent, "RUN", run)
    searcher = latent.Searcher([(latent.Item(x["item_id"], np.frombuffer(x["words"], np.uint64), np.frombuffer(x["tail"], np.uint64)), np.frombuffer(x["vector"], np.float32), x["threshold"]) for x in rows], wide)
    found = searcher.find(latent.Words(latent.pa.array([t or "" for t in texts], latent.pa.large_string())))
    got = {(d, it.ident): (lcs, end) for d, it, lcs, end, _ in found}
    want = every_window(texts, rows, wide)
    assert got == want and len(got) > 35


def test_latent_results_do_not_hang_on_the_layout(spark):
    r = random.Random(22)
    items = [prose(n, r) for n in (9, 20, 40)]
    texts = [prose(r.randint(1, 200), r) for _ in range(80)] + [prose(20, r) + " " + i for i in items] + [prose(9000, r) + items[2]] + EDGES
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    df = docs(spark, texts)
    found = [sorted(map(tuple, latent.leaks(df.repartition(n), bench).collect())) for n in (1, 7)]
    assert found[0] == found[1] and len(found[0]) >= 4


def test_latent_finds_short_items_in_one_line_texts(spark):
    r = random.Random(23)
    items = [prose(r.randint(8, 13), r) for _ in range(120)]
    texts = [prose(r.randint(3, 30), r) for _ in range(600)]
    want = set()
    for i, item in enumerate(items):
        want.add((len(texts), i))
        texts.append(" ".join([prose(r.randint(0, 6), r), item, prose(r.randint(0, 6), r)]))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]) for x in latent.leaks(docs(spark, texts), bench).collect()}
    assert len(got & want) / len(want) >= 0.95 and len(got - want) <= 3


def test_latent_clashing_columns_and_null_ids(spark):
    r = random.Random(24)
    item = prose(20, r)
    rows = [(1, item, "x"), (None, item, "y"), (None, prose(30, r), "z"), (2, prose(30, r), "z"), (2, prose(30, r), "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _bad string").withColumns({"_id": F.lit(1), "item_id": F.lit(2), "id": F.lit(3), "t": F.lit(4)})
    bench = spark.createDataFrame([(7, item), (None, item)], "item_id long, text string")
    assert sorted((x["doc_id"] or 0, x["item_id"] or 0) for x in latent.leaks(df, bench).collect()) == [(0, 0), (0, 7), (1, 0), (1, 7)]
    assert [x["doc_id"] for x in latent.decontaminate(df, bench).collect()] == [2, 2]
    assert latent.decontaminate(df, bench).columns == df.columns


def test_latent_recall_of_short_paraphrases(spark):
    assert planted_recall(spark, (15, 17, 20, 22), 0.25) >= 0.95


def test_latent_recall_of_long_items(spark):
    assert planted_recall(spark, (60, 90, 120, 200, 300), 0.25) >= 0.995


def test_randomised_svd_finds_the_factors():
    rng = np.random.default_rng(0)
    a = rng.standard_normal((300, 5)) @ rng.standard_normal((5, latent.FEATURES))
    b = a.T @ (a @ latent.test_matrix(12).astype(np.float64))
    v, s = latent.factors(b, 12)
    want = np.linalg.svd(a, compute_uv=False)[:5]
    assert np.allclose(s[:5], want, rtol=1e-3) and len(s[s > 1e-3 * s[0]]) == 5


def test_common_subsequence_against_dynamic_programme():
    r = random.Random(2)
    for _ in range(200):
        a, b = ([r.randrange(6) for _ in range(r.randint(1, 20))] for _ in range(2))
        d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
        assert latent.common_subsequence(latent.masks(np.array(a)), len(a), b) == d[-1][-1]


# --- 7: packing ---


def test_plan_is_valid_and_beats_fixed_sizes():
    r = random.Random(4)
    sizes = [64, 128, 256, 512]
    hist = dict(Counter(min(512, int(r.expovariate(1 / 90)) + 1) for _ in range(5000)))
    plan = packing.plan_bins(hist, sizes)
    bins, ranks = defaultdict(list), defaultdict(set)
    for length, rank, first, n, offset in plan.entries:
        for k in range(n):
            bins[first + k].append((offset, length))
            ranks[length].add(rank + k)
    assert {k: len(v) for k, v in ranks.items()} == hist and all(max(v) == len(v) - 1 for v in ranks.values())
    size = {first + k: (used, s) for first, n, used, s in plan.bins for k in range(n)}
    total = 0
    for b, parts in bins.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == size[b][0] <= size[b][1] == min(s for s in sizes if s >= at)
        total += packing.cost(size[b][1])
    assert abs(total - plan.total) < 1e-6 * total
    for s in sizes:
        assert plan.total <= packing._pack(hist, sizes, lambda length, left, s=s: max(s, min(x for x in sizes if x >= length))).total


def test_plan_against_all_partitions_of_small_sets():
    """The bound is below the best of all packings, and the plan is close to it."""
    r = random.Random(12)
    sizes = [64, 128, 256, 512]

    def partitions(items):
        if not items:
            yield []
            return
        for rest in partitions(items[1:]):
            yield [items[0], *rest]
            for i, b in enumerate(rest):
                if b + items[0] <= sizes[-1]:
                    yield [*rest[:i], b + items[0], *rest[i + 1 :]]

    plans, bests = 0.0, 0.0
    for _ in range(60):
        items = [r.randint(1, r.choice([60, 130, 512])) for _ in range(r.randint(1, 7))]
        best = min(sum(packing.cost(min(s for s in sizes if s >= b)) for b in bins) for bins in partitions(items))
        plan = packing.plan_bins(dict(Counter(items)), sizes)
        assert plan.bound <= best + 1e-9 and best <= plan.total + 1e-9 and plan.total <= 1.5 * best
        plans, bests = plans + plan.total, bests + best
    assert plans <= 1.05 * bests
    assert packing.plan_bins({}, sizes).total == packing.plan_bins({}, sizes).bound == 0


def test_group_packing_equals_best_fit_decreasing_piece_by_piece():
    """With one bin size the grouped plan has as many bins as best fit item by item, with equal contents."""
    r = random.Random(8)
    items = sorted((r.randint(1, 100) for _ in range(400)), reverse=True)
    rooms = []
    for x in items:
        fits = [i for i, room in enumerate(rooms) if room >= x]
        if fits:
            i = min(fits, key=lambda i: rooms[i])
            rooms[i] -= x
        else:
            rooms.append(100 - x)
    plan = packing._pack(dict(Counter(items)), [100], lambda length, left: 100)
    assert abs(sum(n for _, n, _, _ in plan.bins) - len(rooms)) <= max(1, len(rooms) // 100)


def test_packing_places_every_piece_once(spark):
    r = random.Random(6)
    texts = [prose(r.randint(1, 40), r) for _ in range(300)] + [prose(333, r)] + EDGES[:5]
    df = docs(spark, texts, piece=["x"] * len(texts))
    out = packing.pack(packing.pieces(df, (16, 64, 128)), (16, 64, 128)).collect()
    bins = defaultdict(list)
    for x in out:
        bins[x["bin_id"], x["bin_size"], x["bin_used"]].append((x["offset"], x["tokens"]))
    assert len({k[0] for k in bins}) == len(bins)
    for (_, size, used), parts in bins.items():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at == used <= size
    assert sorted((x["doc_id"], x["piece"]) for x in out) == sorted((i, p) for i, t in enumerate(texts) for p in range(-(-(len((t or "").split()) + 1) // 128)))
    parts = packing.pack_texts(df, (16, 64, 128)).collect()
    joined = defaultdict(str)
    for x in sorted(parts, key=lambda x: (x["doc_id"], x["piece"])):
        joined[x["doc_id"]] += x["text"]
    assert joined == {i: t or "" for i, t in enumerate(texts)}
    assert packing.pack(packing.pieces(df.limit(0))).count() == 0


def test_both_ways_of_counting_words_agree(spark):
    texts = ["a\u00a0b c\u3000d", "x\x1cy z", " \t lead and\x0btail \f", "", None, "one"]
    df = docs(spark, texts)
    counted = {r["doc_id"]: r["tokens"] for r in packing.pieces(df).collect()}
    assert counted == {0: 3, 1: 3, 2: 4, 3: 1, 4: 1, 5: 2}
    assert {r["doc_id"]: r["tokens"] for r in packing.pack_texts(df).collect()} == counted


# --- 8: SimHash ---


def slow_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


@pytest.mark.parametrize("chunk", [2048, 5])
def test_simhash_components_against_brute_force(spark, chunk, monkeypatch):
    monkeypatch.setattr(simhash.links, "__defaults__", (chunk,))
    r = random.Random(7)
    bases = [prose(r.randint(100, 250), r).split() for _ in range(6)]
    texts = []
    for _ in range(260):
        w = list(r.choice(bases))
        for _ in range(r.choice([0, 1, 2, 5, 9])):
            w[r.randrange(len(w))] = r.choice(WORDS).upper()
        texts.append(" \t".join(w))
    texts += [prose(r.randint(1, 50), r) for _ in range(80)] + EDGES
    fps = [slow_fingerprint(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(texts)), 2):
        if (fps[a] ^ fps[b]).bit_count() <= 4:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {x["doc_id"]: (x["fingerprint"], x["component_id"]) for x in simhash.components(docs(spark, texts, fp=["x"] * len(texts))).collect()}
    assert got == {i: (f"{f:016x}", find(i)) for i, f in enumerate(fps)}
    if chunk > 5:
        kept = {x["doc_id"] for x in simhash.keep_first(docs(spark, texts)).collect()}
        blank = {i for i, t in enumerate(texts) if not (t or "").split()}
        assert kept == {i for i in range(len(texts)) if find(i) == i or i in blank}
        twice = docs(spark, texts[:30]).union(docs(spark, texts[:30]))
        assert simhash.keep_first(twice).count() == simhash.keep_first(docs(spark, texts[:30])).count()
        assert simhash.components(docs(spark, texts).limit(0)).count() == 0


def test_pipeline_drops_exact_copies_that_line_dedup_emptied(spark):
    texts = [prose(30), prose(40) + "\n" + prose(20)]
    texts += [texts[1], prose(25), texts[0], texts[1], "", None]
    kept = {x["doc_id"] for x in corpus_pipeline.near_dedup(spark, lines.dedup_lines(docs(spark, texts)), "").collect()}
    assert kept == {0, 1, 2, 3}  # 2 is the first of those without words


# --- 9: toxicity ---


def test_toxicity_held_out_accuracy(spark):
    r = random.Random(10)
    bad = ["wretched", "scoundrel", "vermin", "imbecile"]
    texts, labels = [], []
    for i in range(900):
        w = prose(r.randint(20, 120), r).split()
        toxic = i % 3 == 0
        for _ in range(4 if toxic else 0):
            w.insert(r.randrange(len(w)), r.choice(bad))
        texts.append(" ".join(w))
        labels.append((i, int(toxic)))
    df = docs(spark, texts, toxic=["x"] * len(texts))
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fitted(df, known)
    held = {x["doc_id"] for x in df.where(toxicity.held_out()).collect()}
    assert held == {i for i in range(900) if zlib.crc32(str(i).encode()) % 4 == 2}
    scores = {x["doc_id"]: x["score"] for x in toxicity.score_texts(df, model).collect()}
    right = [(scores[i] >= toxicity.THRESHOLD) == bool(y) for i, y in labels if i in held]
    assert sum(right) / len(right) > 0.95
    kept = {x["doc_id"] for x in toxicity.drop_toxic(df, known).collect()}
    assert kept == {i for i, s in scores.items() if s < toxicity.THRESHOLD}
    edge = toxicity.score_texts(docs(spark, EDGES), model).collect()
    assert all(0 <= x["score"] <= 1 for x in edge) and edge[0]["score"] == edge[1]["score"]
    assert toxicity.fitted(df, known.limit(0)).weights.size == 0
    assert {x["score"] for x in toxicity.score_texts(df.limit(3), toxicity.fitted(df, known.limit(0))).collect()} == {0.0}


def test_toxicity_lengths_and_scores_by_hand(spark):
    """Each window's two lengths and a text's score, worked out apart from the model's code."""
    import zstandard

    r = random.Random(13)
    bad = ["wretched", "scoundrel", "vermin"]
    rows = [(h, toxicity.as_bytes(prose(60, r) + (" " + " ".join(r.choice(bad) for _ in range(4)) if h % 5 == 0 else "")), int(h % 5 == 0)) for h in range(900)]
    model = toxicity.train(toxicity.LocalRows(rows), toxicity.Settings(words=8192, toxic=512))
    assert b"scoundrel" in model.toxic and b"scoundrel" not in model.ordinary
    plain, marked = model.compressors()
    for text in (b"", b"x", b"one word", b"a scoundrel and vermin", toxicity.as_bytes(prose(300, r))):
        cut, at = [], 0
        while at < len(text):
            to = len(text) if at + 128 >= len(text) else (text.rfind(b" ", at + 64, at + 128) if b" " in text[at + 64 : at + 128] else at + 128)
            cut.append(text[at:to])
            at = to
        d = []
        for w in cut or [b""]:
            sizes = []
            for content in (model.ordinary, model.toxic + model.ordinary):
                z = zstandard.ZstdCompressor(level=9, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False)
                sizes.append(len(z.compress(w)))
            d.append(sizes[0] - sizes[1])
        assert d == [len(plain(w)) - len(marked(w)) for w in toxicity.windows(text)]
        top = sorted(d, reverse=True)
        x = [top[0], np.mean([max(v, 0) for v in top[:3]]), *(np.log1p(sum(v >= k for v in d)) for k in range(1, 6)), np.mean([max(v, 0) for v in d]), np.mean([v >= 3 for v in d]), np.log(len(d))]
        z = sum(w * (v - m) / s for w, v, m, s in zip(model.weights, x, model.mean, model.spread, strict=False)) + model.weights[-1]
        assert abs(model.score(np.array([model.features(text, plain, marked)]))[0] - 1 / (1 + np.exp(-z))) < 1e-9
    assert model.score(np.array([model.features(b"a scoundrel and vermin, a wretched scoundrel", plain, marked)]))[0] >= toxicity.THRESHOLD


def test_toxicity_sample_and_edge_rows(spark):
    r = random.Random(14)
    texts = [prose(30, r) + (" scoundrel vermin" * 2 if i % 3 == 0 else "") for i in range(240)]
    df = docs(spark, texts, y=["a"] * 240, h=["b"] * 240, t=["c"] * 240)
    df = df.union(df.where("doc_id < 9")).union(spark.createDataFrame([(None, "scoundrel", "", "", ""), (500, None, "", "", "")], df.schema))
    known = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(240)] + [(None, 1), (7, 1), (8, None), (500, 0)], "doc_id long, toxic int")
    rows = toxicity.labelled_sample(df, known, ~toxicity.held_out(), "doc_id", "text", 1000).collect()
    used = [i for i in [*range(240), 500] if zlib.crc32(str(i).encode()) % 4 != 2]
    assert len(rows) == len(used) + (7 in used) and sum(x["y"] for x in rows) == sum(i % 3 == 0 for i in used if i < 500) + (7 in used)
    assert toxicity.labelled_sample(df, known, ~toxicity.held_out(), "doc_id", "text", 10).count() == 20
    model = toxicity.fitted(df, known)
    local = toxicity.train(toxicity.LocalRows([(x["h"], toxicity.as_bytes(x["t"]), x["y"]) for x in rows]))
    assert model.toxic == local.toxic and model.ordinary == local.ordinary and np.allclose(model.weights, local.weights)
    kept = toxicity.drop_toxic(df, known)
    assert kept.columns == df.columns and 0 < kept.count() < df.count()
    assert toxicity.drop_toxic(df.limit(0), known).count() == 0
    assert toxicity.score_texts(df.limit(0), model).count() == 0


def test_selection_never_reads_held_out_labels(spark):
    r = random.Random(11)
    texts = [prose(40, r) + (" scoundrel vermin" if i % 3 == 0 else "") for i in range(300)]
    df = docs(spark, texts)
    # a held-out row that carries a word of its own
    marked = df.withColumn("text", F.when(toxicity.held_out(), F.concat("text", F.lit(" heldout"))).otherwise(F.col("text")))
    known = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    folds = [toxicity.labelled_sample(marked, known, toxicity.fold().isin(f), "doc_id", "text", 1000).collect() for f in ([0, 1], [3])]
    assert all(folds) and not any("heldout" in r["t"] for rows in folds for r in rows)
    assert sum(map(len, folds)) == df.where(~toxicity.held_out()).count()
    assert toxicity_selection.figures(np.array([0.9, 0.4, 0.1, 0.2]), np.array([1, 0, 0, 1])) == (0.5, 0.5, 0.5, 0.75)


# --- 10: media ---


def test_png_roundtrip_and_features(spark):
    df = docs(spark, [*EDGES, "same", "same"], media=["x"] * (len(EDGES) + 2))
    stored = media.encode_column(df)
    raw = {x["doc_id"]: bytes(x["media"]) for x in stored.collect()}
    for x in media.media_features(stored).collect():
        t = ([*EDGES, "same", "same"][x["doc_id"]] or "").encode()
        want = t + b"\xff" * (max(1, -(-len(t) // 576)) * 576 - len(t))
        assert (x["n_bytes"], x["payload_bytes"]) == (len(t), len(want))
        assert x["payload_sha256"] == hashlib.sha256(want).hexdigest() and x["tail_crc32"] == zlib.crc32(want[-32:])
        assert media.png_decode(raw[x["doc_id"]]).tobytes() == want
        assert len(x["phash"]) == 8
    assert raw[len(EDGES)] == raw[len(EDGES) + 1]


def test_png_filters_and_checksums():
    rng = np.random.default_rng(1)
    for kind in range(5):
        picture = rng.integers(0, 256, (6, 7), np.uint8)
        body = np.zeros((6, 8), np.uint8)
        for y in range(6):
            body[y, 0] = kind
            for x in range(7):
                a = int(picture[y, x - 1]) if x else 0
                b = int(picture[y - 1, x]) if y else 0
                c = int(picture[y - 1, x - 1]) if x and y else 0
                p = a + b - c
                near = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
                body[y, 1 + x] = (int(picture[y, x]) - (0, a, b, (a + b) // 2, near)[kind]) % 256
        assert (media.unfilter(body, 7) == picture).all()
    good = media.png_encode(bytes(range(240)))
    assert media.png_decode(good).tobytes() == bytes(range(240))
    for i in (3, 20, 45, len(good) - 3):
        with pytest.raises(ValueError):
            media.png_decode(good[:i] + bytes([good[i] ^ 1]) + good[i + 1 :])
    with pytest.raises(ValueError):
        media.png_decode(good[:-12])


def test_cosine_hash_is_robust():
    k = np.arange(32)
    cos = np.cos(np.pi / 32 * (k[None, :] + 0.5) * k[:8, None])
    rough = np.kron(cos.T @ np.random.default_rng(4).normal(0, 6, (8, 8)) @ cos, np.ones((8, 1))) + 128
    picture = np.clip(rough, 0, 255).astype(np.uint8)
    noisy = np.clip(picture.astype(int) + np.random.default_rng(0).integers(-3, 4, picture.shape), 0, 255).astype(np.uint8)
    bits = lambda p: int.from_bytes(media.cosine_hash(p), "big")
    assert (bits(picture) ^ bits(noisy)).bit_count() <= 12
