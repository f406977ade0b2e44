"""Helpers shared by the operators: shared storage, ordered slots, components, sketches."""

from __future__ import annotations

import contextlib
import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where checkpoints go if the session names no shared folder (single machine, tests).
LOCAL_CHECKPOINTS = "/tmp/checkpoints"


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh path below the folder that all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = LOCAL_CHECKPOINTS
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a lineage cut that outlives executors."""
    path = shared_dir(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.table_path = path
    for paths in _recorders:
        paths.append(path)
    return out


_recorders: list[list[str]] = []


@contextlib.contextmanager
def recorded():
    """Collects the paths of the tables that are materialized inside."""
    paths: list[str] = []
    _recorders.append(paths)
    try:
        yield paths
    finally:
        _recorders.remove(paths)


def free(spark: SparkSession, *tables) -> None:
    """Delete materialized tables (DataFrames from ``materialize``, or paths) that nothing will read again.

    Only what has been written elsewhere since may be freed: a lost executor then needs no older table.
    """
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for t in tables:
        path = jvm.org.apache.hadoop.fs.Path(t if isinstance(t, str) else t.table_path)
        path.getFileSystem(conf).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of jobs whose DataFrames are gone."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fresh(df: DataFrame, *bases: str):
    """A column name that ``df`` does not have (names compare without case), or one for each base."""
    taken = {c.lower() for c in df.columns}
    out = []
    for base in bases:
        name, n = f"_{base}", 0
        while name.lower() in taken:
            name, n = f"_{base}{n}", n + 1
        taken.add(name.lower())
        out.append(name)
    return out[0] if len(out) == 1 else out


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ordered_slots(df: DataFrame, group: str, order: list[str], slot: str, label: str) -> DataFrame:
    """Number the rows of each group 0, 1, ... along ``order`` without gathering a group in a task.

    The rows are range-partitioned on (group, order), so a hot group spreads over many partitions.
    Each partition counts its rows per group; the counts (at most partitions + groups rows) are
    collected, summed up and broadcast as offsets. Null groups are numbered like any other.
    """
    spark = df.sparkSession
    keys = [F.col(group), *(F.col(c) for c in order)]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = (
        df.repartitionByRange(n, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_row", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_row", 33).cast("int"))
    )
    placed = materialize(placed, label)
    counts = placed.groupBy("_part", group).agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n")).collect()
    seen: dict = {}
    offsets = []
    for r in sorted(counts, key=lambda r: r["_first"]):
        offsets.append((r["_part"], r[group], r["_first"] - seen.get(r[group], 0)))
        seen[r[group]] = seen.get(r[group], 0) + r["_n"]
    schema = f"_p int, _g {dict(df.dtypes)[group]}, _base long"
    base = F.broadcast(spark.createDataFrame(offsets, schema))
    joined = placed.join(base, (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_g")), "left")
    return joined.withColumn(slot, F.col("_row") - F.col("_base")).drop("_row", "_part", "_p", "_g", "_base")


def connected_components(edges: DataFrame, label: str) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b: long); component = smallest node id.

    Alternating large-star and small-star steps: each joins every node with the least of its
    neighbours (a map-side-combined minimum), so the edges turn into stars around the least node in a
    logarithmic number of rounds. Rounds end when no edge changes. Both sides of each join are read
    from the shared folder, so the adaptive planner can split the partition of a hub.
    """
    edges = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label
    )
    digest = [F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")]
    before = edges.agg(*digest).first()
    while before["n"]:
        # large star: neighbours on both sides; larger ones move to the least
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), label)
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = materialize(large, label)
        free(edges.sparkSession, edges, least)
        # small star: each node links its smaller neighbours, and itself, to the least of them
        least = materialize(large.groupBy("a").agg(F.min("b").alias("m")), label)
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        edges = materialize(small.where("a <> b").distinct(), label)
        free(edges.sparkSession, large, least)
        after = edges.agg(*digest).first()
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


# --- words of a batch of texts, as arrays -------------------------------------------------------

#: Bytes per slice of a batch that is turned into arrays at once.
SLICE_BYTES = 4 << 20
_LOWER = np.zeros(256, np.uint8)
for _b in range(256):
    if chr(_b).isascii() and chr(_b).isalnum():
        _LOWER[_b] = ord(chr(_b).lower())
    elif _b >= 0x80:
        _LOWER[_b] = _b
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * _C2
    h = (h ^ (h >> np.uint64(27))) * _C3
    return h ^ (h >> np.uint64(31))


class Words:
    """The words of some texts: runs of ASCII letters, digits and non-ASCII bytes, ASCII lower-cased.

    ``hash`` holds a 64-bit hash of each word, ``line`` its line counted over all rows;
    ``start``/``end`` are byte offsets in ``buf``. ``line_doc`` and ``line_no`` place each line,
    ``line_first`` and ``line_words`` its words; ``first`` is the index of the first word of each row
    (and the total, at the end).
    """

    def __init__(self, texts: pa.Array):
        n = len(texts)
        data = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), texts), pa.scalar("\n", texts.type))[0].as_buffer() if n else b""
        raw = np.frombuffer(data, np.uint8)
        self.buf = raw
        low = np.zeros(len(raw) + 17, np.uint8)
        np.take(_LOWER, raw, out=low[1 : len(raw) + 1])
        inside = low != 0
        edges = np.flatnonzero(inside[1 : len(raw) + 2] != inside[: len(raw) + 1])
        self.start, self.end = edges[::2], edges[1::2]
        self.hash = self._hashes(low[1:])
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        self.doc_start = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1] if n else np.zeros(0, np.int64)
        self.first = np.searchsorted(self.start, np.append(self.doc_start, len(raw) + 1))

    def __getattr__(self, name: str):
        """What places lines is made when it is first asked for."""
        if not name.startswith("line"):
            raise AttributeError(name)
        n, raw = len(self.doc_start), self.buf
        breaks = np.flatnonzero(raw == 10)
        self.line_start = np.concatenate([[0], breaks + 1]) if n else np.zeros(0, np.int64)
        self.line_end = np.concatenate([breaks, [len(raw)]]) if n else np.zeros(0, np.int64)
        self.line_first = np.searchsorted(self.start, self.line_start)
        self.line_words = np.diff(np.append(self.line_first, len(self.start)))
        self.line = np.repeat(np.arange(len(self.line_first)), self.line_words)
        doc_line = np.searchsorted(self.line_start, self.doc_start)
        self.line_doc = np.repeat(np.arange(n), np.diff(np.append(doc_line, len(self.line_first))))
        self.line_no = np.arange(len(self.line_first)) - doc_line[self.line_doc]
        if name not in self.__dict__:
            raise AttributeError(name)
        return self.__dict__[name]

    def _hashes(self, low: np.ndarray) -> np.ndarray:
        eight = np.ndarray((len(low) - 7,), "<u8", low, strides=(1,))
        size = self.end - self.start
        h = size.astype(np.uint64) * _C1
        at, left, live = self.start, size, None
        while len(at):
            part = eight[at] & _MASK[np.minimum(left, 8)]
            if live is None:
                h = mix(h ^ part)
            else:
                h[live] = mix(h[live] + _C1 ^ part)
            more = np.flatnonzero(left > 8)
            live = more if live is None else live[more]
            at, left = at[more] + 8, left[more] - 8
        return h


def text_slices(batches, text: str = "text", size: int = SLICE_BYTES):
    """(batch slice, texts as large strings with nulls as empty) of about ``size`` bytes of text each."""
    for batch in batches:
        texts = pc.fill_null(batch.column(batch.schema.get_field_index(text)).cast(pa.large_string()), "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + size, "right")))
            yield batch.slice(at, to - at), texts.slice(at, to - at)
            at = to


def sum_sketches(parts: DataFrame, size: int) -> np.ndarray:
    """Add up fixed-size count arrays. ``parts``: (slice int, counts binary of int64); ``size`` counts in all.

    What reaches the driver is one array of ``size`` int64, whatever the input's size.
    """

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for v in b.column("counts"):
                a = np.frombuffer(v.as_buffer(), np.int64)
                total = a.copy() if total is None else total + a
        yield pa.RecordBatch.from_pydict({"slice": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros(size, np.int64)
    rows = parts.groupBy("slice").applyInArrow(add, "slice int, counts binary").collect()
    for r in rows:
        a = np.frombuffer(r["counts"], np.int64)
        out[r["slice"] * len(a) : r["slice"] * len(a) + len(a)] = a
    return out


def sketch_rows(counts: np.ndarray, width: int):
    """The rows that ``sum_sketches`` takes, from one task's counts, in slices of ``width``."""
    parts = counts.astype(np.int64).reshape(-1, width)
    keep = np.flatnonzero(parts.any(axis=1))
    yield pa.RecordBatch.from_pydict({"slice": pa.array(keep, pa.int32()), "counts": pa.array([parts[i].tobytes() for i in keep], pa.binary())})
