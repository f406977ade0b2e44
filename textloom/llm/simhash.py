"""SimHash near-duplicates by pivot distance tables.

Fingerprints: a bit is 1 if it is set in over half of the XXH64 hashes (seed 42) of a text's 4-word
shingles. Equal fingerprints become one row first. Pairs of different fingerprints within ``most`` = 4
bits are found in blocks that cannot miss one: of 6 blocks of the 64 bits at most 4 can differ, so
some 2 agree; each of the 15 choices of 2 blocks is a key. Within the
rows of a key, the precomputed Hamming distances to 24 reference fingerprints (the pivot table of each
row) discard pairs: by the triangle inequality a pair within 4 bits differs by at most 4 in every
coordinate. Survivors are verified on the fingerprints themselves.

A key with many rows is cut into chunks, and each pair of chunks is a cell of its own; the number of
chunks follows from exact counts of the keys. A cell reports links that join its rows for the first time (a
spanning forest), never all pairs of a group. Links are joined up by distributed components.

Defined cases: no words, or a null text: fingerprint zero, linked like any other; fewer than 4 words: one
shingle of all; repeated rows are rows like others; a null id stays null and is the least of its
component only if all are null; ties of fingerprints are one class; an empty table gives no rows. Other columns are
not looked at, whatever their names.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, free, fresh, materialize, read_documents

SEED, SHINGLE, MOST = 42, 4, 4
BLOCKS, PIVOTS, CHUNK = 6, 24, 2048
_EDGES = np.linspace(0, 64, BLOCKS + 1).astype(int)
_CHOICES = list(combinations(range(BLOCKS), BLOCKS - MOST))
_UPPER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: bytes) -> int:
    """The 64-bit SimHash of a text in UTF-8."""
    words = text.translate(_UPPER).split()
    if not words:
        return 0
    h, n = xxhash.xxh64_intdigest, len(words) - SHINGLE + 1
    if n < 2:
        return h(b" ".join(words), SEED)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:n - 1]]).tolist()
    stops = (ends[SHINGLE - 1 :] - 1).tolist()
    bits = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = np.array([h(line[a:b], SEED) for a, b in zip(starts[at : at + (1 << 16)], stops[at : at + (1 << 16)], strict=True)], ">u8")
        ones = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1)
        # sums of bytes eight columns at a time: 255 rows fit a byte
        for i in range(0, len(ones), 255):
            bits += ones[i : i + 255].view(np.uint64).sum(axis=0).view(np.uint8)
    return int.from_bytes(np.packbits(bits * 2 > n).tobytes(), "big")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long): the fingerprint of every whole text, as signed 64 bits."""
    kind = dict(df.dtypes)[id_col]

    def run(batches):
        for b in batches:
            fps = [fingerprint(t.as_buffer().to_pybytes()) if t.is_valid else 0 for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], ["id", "fp"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"id {kind}, fp long").withColumnRenamed("id", id_col)


def pivots(n: int = PIVOTS) -> np.ndarray:
    return np.random.default_rng(8).integers(0, 1 << 64, n, np.uint64)


def block_keys(fp):
    """One struct (choice, key) per choice of blocks: the bits of the blocks that must agree."""
    out = []
    for i, choice in enumerate(_CHOICES):
        mask = 0
        for b in choice:
            mask |= ((1 << int(_EDGES[b + 1] - _EDGES[b])) - 1) << int(_EDGES[b])
        mask -= (1 << 64) if mask >> 63 else 0
        out.append(F.struct(F.lit(i).alias("choice"), fp.bitwiseAND(F.lit(mask)).alias("key")))
    return F.array(*out)


def forest(fps: np.ndarray, table: np.ndarray, cell: np.ndarray):
    """Index pairs that join rows of equal ``cell`` (sorted) within MOST bits: a spanning forest of each.

    Rows are compared with those 1, 2, ... places on in their cell. Of a pair, first the pivot
    coordinates are compared, one after the other over the pairs still left, then the fingerprints.
    """
    label = np.arange(len(fps))
    live = np.arange(len(fps))
    pairs = []
    off = 1
    while len(live):
        live = live[live + off < len(fps)]
        live = live[cell[live] == cell[live + off]]
        a = live[label[live] != label[live + off]]
        for k in range(table.shape[0]):
            if not len(a):
                break
            row = table[k]
            a = a[np.abs(row[a] - row[a + off]) <= MOST]
        a = a[np.bitwise_count(fps[a] ^ fps[a + off]) <= MOST]
        if len(a):
            root: dict[int, int] = {}

            def find(x, root=root):
                while root.get(x, x) != x:
                    x = root[x]
                return x

            for i in a.tolist():
                x, y = find(int(label[i])), find(int(label[i + off]))
                if x != y:
                    root[max(x, y)] = min(x, y)
                    pairs.append((i, i + off))
            old = np.fromiter(root, np.int64, len(root))
            to = np.arange(len(fps))
            to[old] = [find(int(x)) for x in old]
            label = to[label]
        off += 1
    return pairs


def links(distinct: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(a, b): enough pairs of different fingerprints within MOST bits to join all that are linked."""
    spark = distinct.sparkSession
    keyed = distinct.select("fp", F.inline(block_keys(F.col("fp"))))
    # keys with over a chunk of rows are rare; their chunks come from exact counts
    sizes = keyed.groupBy("choice", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    sizes = materialize(sizes, "simhash-keys")
    keyed = keyed.join(sizes, ["choice", "key"])
    k = F.ceil(F.col("n") / chunk).cast("int")
    mine = F.pmod(F.xxhash64("fp", F.lit(1)), k.cast("long")).cast("int")
    cells = keyed.select("fp", "choice", "key", "n", F.explode(F.transform(F.sequence(F.lit(0), k - 1), lambda j: F.struct(F.least(j, mine).alias("i"), F.greatest(j, mine).alias("j")))).alias("c"))
    cells = cells.select("fp", F.xxhash64("choice", "key", "c.i", "c.j").alias("cell"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = cells.repartition(n, "cell").sortWithinPartitions("cell", "fp")
    refs = pivots()

    def run(batches):
        held_cell, held_fp = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def work(cell, fp):
            u = fp.view(np.uint64)
            table = np.stack([np.bitwise_count(u ^ p) for p in refs]).astype(np.int8)
            found = forest(u, table, cell)
            if found:
                i = np.array(found)
                yield pa.RecordBatch.from_arrays([pa.array(fp[i[:, 0]]), pa.array(fp[i[:, 1]])], ["a", "b"])

        for b in batches:
            cell = np.concatenate([held_cell, b.column(1).to_numpy(zero_copy_only=False)])
            fp = np.concatenate([held_fp, b.column(0).to_numpy(zero_copy_only=False)])
            cut = int(np.searchsorted(cell, cell[-1])) if len(cell) else 0
            yield from work(cell[:cut], fp[:cut])
            held_cell, held_fp = cell[cut:], fp[cut:]
        yield from work(held_cell, held_fp)

    return dealt.mapInArrow(run, "a long, b long")


def components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id): one row per document."""
    docs = materialize(fingerprints(df, id_col, text_col), "simhash-fp")
    reps = materialize(docs.groupBy("fp").agg(F.min(id_col).alias("least")), "simhash-reps")
    joined = materialize(connected_components(links(reps.select("fp")), "simhash-cc"), "simhash-labels")
    labelled = reps.join(joined, reps["fp"] == joined["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = materialize(labelled.select("fp", "component").join(least, "component").select("fp", "component_id"), "simhash-classes")
    return docs.join(classes, "fp").select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(read_documents(spark, sf_dir))


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", wordless: bool = False) -> DataFrame:
    """``df`` with one document of each component, that with the least id; all columns stay.

    Texts without words all stay, unless ``wordless``: then they are one group by their fingerprint zero, as in
    ``components``. Where rows repeat an id that stays, or ids are null, one row of equal ids stays.
    """
    blank = ~F.coalesce(F.col(text_col), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    texts = df if wordless else df.where(~blank)
    key = fresh(df, "id")
    first = components(texts, id_col, text_col)
    gone = materialize(first.where(~F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias(key)).distinct(), "simhash-gone")
    match = F.col(id_col).eqNullSafe(F.col(key))
    kept = df.join(gone, match, "left_anti")
    twice = materialize(texts.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col(id_col).alias(key)), "simhash-twice")
    if twice.isEmpty():
        return kept
    return kept.join(twice, match, "left_anti").union(kept.join(twice, match, "left_semi").dropDuplicates([id_col]))
