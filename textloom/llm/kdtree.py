"""Sharding: a k-d tree over document metadata, cut at weighted medians.

A node with k leaves is split into floor(k/2) and ceil(k/2) leaves along the metadata dimension in
which its rows spread widest, at the point where the bytes left of it have the share of its left
leaves, until every leaf holds about the target bytes. Dimensions are the size, the language and the source, all on
one scale: a row's coordinate is the share (16 bits) of all bytes that lie before its value, sizes in
logarithmic steps and names in the order of a 16-bit hash. Within a coordinate, rows are ordered by a hash of
the text and then by id, so equal texts are neighbours in every dimension; a group's metadata is that of its least row.

Equal texts stay together: a group that the cut falls in goes whole to the nearer side if the cut then misses its share by
``miss`` of a leaf at most; else to a side with room for it, and the cut moves along the other rows until both sides
have their bytes again. Only a group that alone outweighs a leaf is cut, by id.

The medians are found by distributed histograms, 16 bits of the order at a time: one pass sums bytes per
(node, digit) and picks the digit that the cut falls in, in executors, and the next pass looks only inside it.
All nodes of a level share the passes; one row a node reaches the driver, and tables of nodes go to the rows by joins.

Defined cases: a null text has no bytes (size 1); a null language, source or id is a value of its own;
repeated rows are rows like others (rows equal in text and id are never parted); an empty table has no shards. Other columns
are not looked at, whatever their names; very long texts count whole.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free, materialize, ordered_slots, read_documents

SHARDS = 8
DIGIT = 16
#: A row's place along a dimension: a digit of its coordinate, 4 of the text's hash and 4 of the id.
DEPTH = 9
TEXT_DONE = 4
#: The search ends in a bucket of this part of a leaf, and where whole groups let a cut miss its share by no more than that part.
SLACK, MISS = 0.002, 0.005
#: Tables of nodes are broadcast up to so many rows, and joined plainly beyond.
BROADCAST_ROWS = 100_000
_SIGN = 1 << 63


def _signed(bits: int) -> int:
    """The signed long at this place of the order of longs."""
    return bits - _SIGN


def _bound(place: int) -> tuple[int, int, int]:
    """(coordinate, text hash, id) of a place in the order of 144 bits; beyond the last one, a coordinate of 65536."""
    return place >> 128, _signed(place >> 64 & (1 << 64) - 1), _signed(place & (1 << 64) - 1)


def _digits(head):
    """The digits of the order along a dimension, most significant first."""
    part = lambda c, k: F.shiftrightunsigned(F.col(c).bitwiseXOR(F.lit(-_SIGN)), 48 - DIGIT * k).bitwiseAND(0xFFFF)
    return F.array(head.cast("long"), *(part("th", k) for k in range(4)), *(part("ident", k) for k in range(4)))


def _key(*cols):
    return F.struct(*(F.col(c).alias(n) for c, n in zip(cols, "abc", strict=True)))


def _table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]
    made = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    df = spark.range(0, 1, 1, 1).select(F.inline(F.from_json(F.lit(made), f"array<struct<{schema.replace(' long', ':long').replace(' int', ':int').replace(' double', ':double').replace(' boolean', ':boolean')}>>")))
    return F.broadcast(df) if len(rows) <= BROADCAST_ROWS else df


def points(df: DataFrame, id_col: str, text_col: str, cat_cols: list[str]) -> DataFrame:
    """(id, size, crc, ident, th, k0..): a light row per document with its coordinates, 0 to 65535."""
    n = 1 + len(cat_cols)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    kind = lambda c: F.xxhash64(F.coalesce(F.col(c).cast("string"), F.lit("\0null")))
    rows = df.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("crc"),
        F.xxhash64(text).alias("th"),
        *(F.shiftrightunsigned(kind(c), 48).cast("int").alias(f"c{i}") for i, c in enumerate(cat_cols, 1)),
    )
    rows = materialize(rows.withColumn("c0", F.least(F.lit(65535), F.floor(F.log2("size") * 2048).cast("int"))), "kdtree-points")
    codes = [f"c{i}" for i in range(n)]
    # a group's metadata: that of its least row; both sides of the join are plain, so a hot group splits
    groups = materialize(rows.groupBy("th").agg(F.min(F.struct(*codes)).alias("g")), "kdtree-groups")
    ident = F.coalesce(F.col("id").cast("long"), F.lit(-_SIGN)).alias("ident")
    rows = materialize(rows.drop(*codes).join(groups, "th").select("id", "size", "crc", ident, "th", "g.*"), "kdtree-codes")
    # bytes before each code: at most 65536 codes a dimension, whatever the input
    held = rows.select("size", F.posexplode(F.array(*codes)).alias("dim", "code")).groupBy("dim", "code").agg(F.sum("size").alias("w"))
    along = Window.partitionBy("dim").orderBy("code")
    before = F.sum("w").over(along) - F.col("w")
    shares = materialize(held.withColumn("share", F.floor(before / F.sum("w").over(Window.partitionBy("dim")) * 65535).cast("int")), "kdtree-shares")
    for i, c in enumerate(codes):
        rows = rows.join(F.broadcast(shares.where(F.col("dim") == i).select(F.col("code").alias(c), F.col("share").alias(f"k{i}"))), c)
    return materialize(rows.select("id", "size", "crc", "ident", "th", *(f"k{i}" for i in range(n))), "kdtree-keys")


class _Cut:
    """The search for a node's cut: ``place`` of ``depth`` digits, ``left`` bytes before it, ``moved`` groups by side."""

    def __init__(self, dim: int, weight: int, k: int):
        self.dim, self.want, self.leaf = dim, weight * (k // 2) / k, weight / k
        self.slack, self.miss, self.rest = SLACK * self.leaf, MISS * self.leaf, weight
        self.moved: dict[int, bool] = {}
        self.restart()

    def restart(self):
        self.depth = self.place = self.left = 0
        self.at = None

    def range(self):
        shift = DIGIT * (DEPTH - self.depth)
        return *_bound(self.place << shift), *_bound(self.place + 1 << shift)

    def finish(self, place: int):
        self.at = _bound(place << DIGIT * (DEPTH - self.depth))

    def step(self, found):
        """Take the bucket that the cut falls in: (digit, bytes in it, bytes up to its end, least and last text hash), or None."""
        if found is None:
            self.finish(self.place + 1)
            return
        digit, w, upto, least, last = found
        self.left += upto - w
        self.place, self.depth = self.place << DIGIT | digit, self.depth + 1
        if least == last and self.depth <= TEXT_DONE:
            # one text only: its other digits are known
            self.place, self.depth = (self.place >> DIGIT * (self.depth - 1)) << 64 | least + _SIGN, TEXT_DONE + 1
        if self.depth == TEXT_DONE + 1 and w <= self.leaf:
            # a group of equal texts: whole to the nearer side, or else to one that has room for it
            if min(self.left + w - self.want, self.want - self.left) <= self.miss:
                self.finish(self.place + (self.left + w - self.want < self.want - self.left))
                return
            text = _signed(self.place & (1 << 64) - 1)
            if w <= self.want:
                self.moved[text] = False
                self.want -= w
            elif w <= self.rest - self.want:
                self.moved[text] = True
            if text in self.moved:
                self.rest -= w
                self.restart()
                return
        elif w > self.slack and self.depth < DEPTH:
            return
        self.finish(self.place + (self.left + w - self.want < self.want - self.left))


_LO, _HI = ("lo_k", "lo_th", "lo_id"), ("hi_k", "hi_th", "hi_id")


def split(rows: DataFrame, leaves: int, n_dims: int) -> DataFrame:
    """Add ``shard`` (int, 0 to leaves - 1): the leaf of the tree that a row falls in."""
    spark = rows.sparkSession
    rows = rows.withColumn("node", F.lit(0).cast("long"))
    nodes = {0: (0, leaves)}  # node: first leaf, number of leaves
    done: dict[int, int] = {}
    dims = F.array(*(F.col(f"k{i}") for i in range(n_dims)))
    while True:
        done |= {n: first for n, (first, k) in nodes.items() if k == 1}
        nodes = {n: v for n, v in nodes.items() if v[1] > 1}
        if not nodes:
            break
        # the widest dimension of each node, and its bytes
        here = rows.join(_table(spark, [(n,) for n in nodes], "node long"), "node", "left_semi")
        stats = here.groupBy("node").agg(F.sum("size").alias("w"), *(F.max(f"k{i}").alias(f"hi{i}") for i in range(n_dims)), *(F.min(f"k{i}").alias(f"lo{i}") for i in range(n_dims))).collect()
        cuts: dict[int, _Cut] = {}
        for r in stats:
            spread = [r[f"hi{i}"] - r[f"lo{i}"] for i in range(n_dims)]
            cuts[r["node"]] = _Cut(spread.index(max(spread)), r["w"], nodes[r["node"]][1])
        while live := {n: c for n, c in cuts.items() if c.at is None}:
            inside = _table(spark, [(n, c.dim, c.depth, float(c.want - c.left), *c.range()) for n, c in live.items()], f"node long, dim int, depth int, rem double, {', '.join(f'{x} long' for x in _LO + _HI)}")
            part = rows.join(inside, "node").withColumn("head", dims[F.col("dim")].cast("long"))
            part = part.where((_key("head", "th", "ident") >= _key(*_LO)) & (_key("head", "th", "ident") < _key(*_HI)))
            moved = [(n, t) for n, c in live.items() for t in c.moved]
            if moved:
                part = part.join(_table(spark, moved, "node long, th long"), ["node", "th"], "left_anti")
            held = part.groupBy("node", "rem", _digits(F.col("head"))[F.col("depth")].cast("int").alias("d")).agg(F.sum("size").alias("w"), F.min("th").alias("least"), F.max("th").alias("last"))
            held = held.withColumn("upto", F.sum("w").over(Window.partitionBy("node").orderBy("d")))
            found = {r["node"]: r["f"] for r in held.where("upto > rem").groupBy("node").agg(F.min(F.struct("d", "w", "upto", "least", "last")).alias("f")).collect()}
            for n, c in live.items():
                c.step(found.get(n))
        # a row goes right from the cut on, and where its group has been moved to
        at = _table(spark, [(n, c.dim, *c.at) for n, c in cuts.items()], f"node long, dim int, {', '.join(f'{x} long' for x in _LO)}")
        aside = _table(spark, [(n, t, right) for n, c in cuts.items() for t, right in c.moved.items()], "node long, th long, aside boolean")
        went = rows.join(at, "node", "left").join(aside, ["node", "th"], "left").withColumn("head", dims[F.col("dim")].cast("long"))
        right = F.coalesce("aside", _key("head", "th", "ident") >= _key(*_LO))
        child = F.when(F.col("dim").isNull(), F.col("node")).otherwise(F.col("node") * 2 + 1 + right.cast("long"))
        before, rows = rows, materialize(went.select(*(c for c in rows.columns if c != "node"), child.alias("node")), "kdtree-level")
        if hasattr(before, "table_path"):
            free(spark, before)
        nodes = {child: v for n, (first, k) in nodes.items() for child, v in ((2 * n + 1, (first, k // 2)), (2 * n + 2, (first + k // 2, k - k // 2)))}
    leaf = _table(spark, list(done.items()), "node long, shard int")
    return rows.join(leaf, "node").drop("node")


def kd_shards(df: DataFrame, shards: int | None = None, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text", cat_cols: list[str] | None = None) -> DataFrame:
    """(id, size, text_crc32, shard, slot). Give the number of shards or the target bytes of one."""
    cat_cols = ["lang", "source"] if cat_cols is None else cat_cols
    rows = points(df, id_col, text_col, cat_cols)
    if shards is None:
        total = rows.agg(F.sum("size")).first()[0] or 0
        shards = max(1, -(-total // target_bytes))
    placed = split(rows, shards, 1 + len(cat_cols)).select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard")
    return ordered_slots(placed, "shard", [id_col, "text_crc32"], "slot", "kdtree-slots")


def op3_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = kd_shards(read_documents(spark, sf_dir), shards=SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
