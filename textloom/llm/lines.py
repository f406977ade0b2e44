"""Line dedup: an exact set-similarity join of lines.

A line's tokens are the set of its words (runs of letters and digits, lower case), as 58-bit hashes,
ordered by rarity: by the logarithm of their corpus frequency, then by hash. Frequencies come from a
sketch of 2^20 counters over all rows; any order that is the same everywhere keeps the join exact, the
sketch only makes it selective. Lines of equal word sequence are one class, by a 64-bit hash. Exact
means: up to collisions of these hashes.

Candidates: two sets of Jaccard similarity >= 0.8 share a token among their first
n - ceil(0.8 n) + 1. These prefix entries are dealt by token as packed arrays, of about PART_ENTRIES at once; within
a token, pairs pass the length filter, the positional filter, and a parity sketch that bounds the symmetric difference.
A second sketch counts the prefix entries: a token with many is cut into chunks and each pair of chunks is a cell of
its own. A cell reports a spanning forest of its candidate pairs, not all of them.

Verification: candidate groups are the connected components of those forests. Only their token sets are
fetched (a fixed-size Bloom filter picks the lines) and dealt by group, large groups again as
pairs of chunks; there all pairs are compared exactly, one cell at a time. Every class gets its number of linked
classes and the earliest line linked to it. A line stays if it is the first of its class and no linked class has an
earlier line; all later matches go.

Defined cases: a line without words is kept and has no class; a null text has no lines; repeated rows
repeat their lines: of lines with one (id, line number) all stay or go alike; a null id sorts first; of equal first
lines none is preferred; a very long line is a set like others; an empty table gives no rows. Other columns pass
through ``dedup_lines`` untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, connected_components, free, fresh, materialize, mix, read_documents, release, text_slices

SIMILARITY = 0.8
BUCKETS = 1 << 20
CHUNK = 4096
#: Sets in a chunk of a large candidate group: the square root of its size, within these bounds.
GROUP_CHUNK = (128, 1024)
#: Prefix entries that are joined in memory at once, about.
PART_ENTRIES = 1 << 20
BLOOM_BITS = 1 << 24
#: Bytes of text whose words are handled at once: their arrays stay in a core's cache.
TEXT_SLICE = 1 << 20
_SLICE = 1 << 14
_SEQ = np.uint64(0x9E3779B97F4A7C15)
#: Sizes from which a set's parity sketch has 128 and 256 bits.
WIDE, WIDER = 58, 116


def pack_entries(cell, n, pos, cls, sig) -> bytes:
    """Entries sorted by cell, as compressed columns; of the sketch only the words that a set's size calls for."""
    steps = np.diff(cell, prepend=np.uint32(0))
    columns = [np.uint32(len(cell)), steps, n.astype("<u4"), pos.astype("<u4"), cls, sig[:, 0], sig[n >= WIDE, 1], sig[n >= WIDER, 2:]]
    return zstandard.compress(b"".join(c.tobytes() for c in columns), 1)


def unpack_entries(blob) -> tuple[np.ndarray, ...]:
    raw = zstandard.decompress(blob)
    k = int(np.frombuffer(raw, "<u4", 1)[0])
    small = np.frombuffer(raw, "<u4", 3 * k, 4).reshape(3, k)
    n = small[1]
    big = np.frombuffer(raw, np.uint64, offset=4 + 12 * k)
    sig = np.zeros((k, 4), np.uint64)
    sig[:, 0] = big[k : 2 * k]
    wide, wider = n >= WIDE, n >= WIDER
    sig[wide, 1] = big[2 * k : 2 * k + wide.sum()]
    sig[wider, 2:] = big[2 * k + wide.sum() :].reshape(-1, 2)
    return np.cumsum(small[0], dtype=np.uint32), n, small[2], big[:k].view(np.int64), sig


def sketches(tok: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A parity sketch of each token set: words a, b, c, d of 256 bits, kept as a^b^c^d, b^d, c, d.

    The first word alone is the sketch of 64 bits, the first two give that of 128.
    """
    bit = (tok >> np.uint64(7)) & np.uint64(255)
    one, word = np.uint64(1) << (bit & np.uint64(63)), bit >> np.uint64(6)
    a, b, c, d = (np.bitwise_xor.reduceat(np.where(word == np.uint64(k), one, np.uint64(0)), first) for k in range(4))
    return np.stack([a ^ b ^ c ^ d, b ^ d, c, d], 1)


def apart(n: np.ndarray, sig: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Which pairs of sets may differ by ``most`` tokens in all: a parity that differs stands for one at least."""
    x = sig[a, 0] ^ sig[b, 0]
    ok = np.bitwise_count(x) <= most
    at = np.flatnonzero(ok & (np.minimum(n[a], n[b]) >= WIDE))
    y = sig[a[at], 1] ^ sig[b[at], 1]
    ok[at] = np.bitwise_count(x[at] ^ y).astype(np.int64) + np.bitwise_count(y) <= most[at]
    keep = ok[at] & (np.minimum(n[a[at]], n[b[at]]) >= WIDER)
    at, x, y = at[keep], x[at][keep], y[keep]
    c, d = (sig[a[at], 2:] ^ sig[b[at], 2:]).T
    ok[at] = sum(np.bitwise_count(w).astype(np.int64) for w in (x ^ y ^ c, y ^ d, c, d)) <= most[at]
    return ok


def bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(44)).astype(np.int64)


def classes_of(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """The lines with words, and a 64-bit hash of each one's word sequence."""
    full = np.flatnonzero(w.line_words)
    if not len(full):
        return full, np.zeros(0, np.int64)
    place = np.arange(len(w.hash)) - np.repeat(w.line_first[full], w.line_words[full])
    seq = np.add.reduceat(mix(w.hash + place.astype(np.uint64) * _SEQ), w.line_first[full])
    return full, mix(seq ^ w.line_words[full].astype(np.uint64)).view(np.int64)


def token_sets(hashes: np.ndarray, line: np.ndarray, levels: np.ndarray):
    """Distinct tokens of each line, rarest first: (tokens, index of each line's first, sizes).

    ``levels``: the rarity level (0 to 63) of each sketch bucket. ``line`` ascends from 0 without gaps.
    """
    v = (levels[bucket(hashes)] << np.uint64(58)) | (hashes >> np.uint64(6))
    o = np.argsort(v)
    lines = line[o]
    lines = lines.astype(np.uint16) if len(lines) and line[-1] < 1 << 16 else lines
    o = o[np.argsort(lines, kind="stable")]
    v, lines = v[o], line[o]
    keep = np.ones(len(v), bool)
    keep[1:] = (v[1:] != v[:-1]) | (lines[1:] != lines[:-1])
    v, lines = v[keep], lines[keep]
    first = np.flatnonzero(np.diff(lines, prepend=-1))
    return v, first, np.diff(np.append(first, len(v)))


def rarity(counts: np.ndarray) -> np.ndarray:
    return np.minimum(63, np.log2(np.maximum(counts, 1)) * 3).astype(np.uint64)


def prefix_length(n: np.ndarray) -> np.ndarray:
    """n - ceil(0.8 n) + 1, in integers."""
    return n - -(-n * 4 // 5) + 1


def overlap_needed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least overlap of sets of these sizes with Jaccard >= 0.8: ceil(4 (a + b) / 9)."""
    return -(-(a + b) * 4 // 9)


def _counter_rows(total: np.ndarray):
    """A task's counters as compressed slices: (slice, counts)."""
    parts = total.reshape(-1, _SLICE)
    keep = np.flatnonzero(parts.any(axis=1))
    return pa.array(keep, pa.int32()), pa.array([zstandard.compress(parts[i].tobytes(), 1) for i in keep], pa.binary())


def _summed(rows: DataFrame) -> np.ndarray:
    """The sums of (slice, counts) rows: 2^20 counters, whatever the input's size."""

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(_SLICE, np.int64)
        for b in batches:
            for c in b.column(1):
                out += np.frombuffer(zstandard.decompress(c.as_buffer()), np.int32)
        yield pa.RecordBatch.from_pydict({"slice": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([out.tobytes()], pa.binary())})

    counts = np.zeros(BUCKETS, np.int64)
    for r in rows.select("slice", "counts").groupBy("slice").applyInArrow(add, "slice int, counts binary").collect():
        counts[r["slice"] * _SLICE : (r["slice"] + 1) * _SLICE] = np.frombuffer(r["counts"], np.int64)
    return counts


def scan_lines(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, np.ndarray]:
    """All lines with words as (id, line_no, cls), and the word counts per bucket."""
    kind = dict(df.dtypes)[id_col]
    names = ["id", "line_no", "cls", "slice", "counts"]

    def run(batches):
        total, id_type = np.zeros(BUCKETS, np.int32), None
        for b, texts in text_slices(batches, "t", TEXT_SLICE):
            w = Words(texts)
            np.add.at(total, bucket(w.hash), np.int32(1))
            full, cls = classes_of(w)
            id_type = b.column(0).type
            n = len(full)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(w.line_doc[full])), pa.array(w.line_no[full], pa.int32()), pa.array(cls), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names)
        if id_type is not None:
            slices, counts = _counter_rows(total)
            n = len(slices)
            yield pa.RecordBatch.from_arrays([pa.nulls(n, id_type), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), slices, counts], names)

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"id {kind}, line_no int, cls long, slice int, counts binary")
    rows = materialize(rows, "lines-scan")
    lines = rows.where("slice is null").select("id", "line_no", "cls")
    lines.table_path = rows.table_path
    return lines, _summed(rows.where("slice is not null"))


class Fresh:
    """The classes of a slice that the slices just before it in a task did not have: each once."""

    def __init__(self):
        self.seen, self.older = set(), set()

    def pick(self, cls: np.ndarray, also: np.ndarray | None = None) -> np.ndarray:
        _, new = np.unique(cls, return_index=True)
        new = new if also is None else new[also[new]]
        new = np.sort(new)
        new = new[np.array([c not in self.seen and c not in self.older for c in cls[new].tolist()], bool)]
        if len(self.seen) > 1 << 17:
            self.seen, self.older = set(), self.seen
        self.seen.update(cls[new].tolist())
        return new


def _sets(w: Words, full: np.ndarray, new: np.ndarray, levels: np.ndarray):
    """``token_sets`` of the lines ``full[new]``."""
    pick = np.zeros(len(w.line_words), bool)
    pick[full[new]] = True
    line = np.repeat(np.arange(len(new)), w.line_words[full[new]])
    return token_sets(w.hash[pick[w.line]], line, levels)


def _prefixes(tok, first, n):
    """(token, row, place) of the prefix entries."""
    row = np.repeat(np.arange(len(n)), n)
    pos = np.arange(len(tok)) - first[row]
    keep = pos < prefix_length(n)[row]
    return tok[keep], row[keep], pos[keep]


def _token_bucket(tok: np.ndarray) -> np.ndarray:
    return ((tok << np.uint64(6)) >> np.uint64(44)).astype(np.int64)


def prefix_counts(df: DataFrame, text_col: str, counts: np.ndarray) -> np.ndarray:
    """Prefix entries per bucket."""
    held = df.sparkSession.sparkContext.broadcast(rarity(counts))

    def run(batches):
        levels, fresh_ones, total = held.value, Fresh(), np.zeros(BUCKETS, np.int32)
        for _, texts in text_slices(batches, "t", TEXT_SLICE):
            w = Words(texts)
            full, cls = classes_of(w)
            new = fresh_ones.pick(cls)
            if len(new):
                np.add.at(total, _token_bucket(_prefixes(*_sets(w, full, new, levels))[0]), np.int32(1))
        slices, packed = _counter_rows(total)
        yield pa.RecordBatch.from_arrays([slices, packed], ["slice", "counts"])

    return _summed(df.select(F.col(text_col).alias("t")).mapInArrow(run, "slice int, counts binary"))


def prefix_entries(df: DataFrame, text_col: str, counts: np.ndarray, entries: np.ndarray, parts: int, chunk: int = CHUNK) -> DataFrame:
    """(part int, entries binary): the prefix entries of all lines, packed, dealt by cell.

    ``entries``: the prefix entries in each bucket; those of a bucket with many go to pairs of chunks.
    """
    held = df.sparkSession.sparkContext.broadcast((rarity(counts), np.maximum(1, -(-entries // chunk)).astype(np.int32)))

    def run(batches):
        levels, chunks = held.value
        fresh_ones = Fresh()
        out: list[tuple] = []
        size = 0

        def flush():
            cell, n, pos, cls, sig = (np.concatenate(c) for c in zip(*out, strict=True))
            scrambled = mix(cell)
            part = (scrambled % np.uint64(parts)).astype(np.int64)
            cell = (scrambled >> np.uint64(32)).astype(np.uint32)
            o = np.argsort(part.astype(np.uint64) << np.uint64(32) | cell)
            part = part[o]
            at = np.flatnonzero(np.diff(part, prepend=-1))
            to = np.append(at[1:], len(part))
            packed = [pack_entries(*(c[o[i:j]] for c in (cell, n, pos, cls, sig))) for i, j in zip(at, to, strict=True)]
            return pa.RecordBatch.from_pydict({"part": pa.array(part[at], pa.int32()), "entries": pa.array(packed, pa.binary())})

        for _, texts in text_slices(batches, "t", TEXT_SLICE):
            w = Words(texts)
            full, cls = classes_of(w)
            new = fresh_ones.pick(cls)
            if not len(new):
                continue
            tok, first, n = _sets(w, full, new, levels)
            sig = sketches(tok, first)
            tok, row, pos = _prefixes(tok, first, n)
            k = chunks[_token_bucket(tok)].astype(np.int64)
            mine = (mix(cls[new][row].view(np.uint64)) % k.astype(np.uint64)).astype(np.int64)
            # a few entries at a time, however many copies chunks call for
            ends = np.cumsum(k)
            at = 0
            while at < len(tok):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 20), "right")))
                rep = at + np.repeat(np.arange(to - at), k[at:to])
                other = np.arange(len(rep)) - np.repeat(np.cumsum(k[at:to]) - k[at:to], k[at:to])
                cell = tok[rep] ^ (np.minimum(mine[rep], other) * 65537 + np.maximum(mine[rep], other)).astype(np.uint64) * _SEQ
                out.append((cell, n[row[rep]], pos[rep], cls[new][row[rep]], sig[row[rep]]))
                size += len(rep)
                at = to
                if size > 1 << 20:
                    yield flush()
                    out, size = [], 0
        if out:
            yield flush()

    return df.select(F.col(text_col).alias("t")).mapInArrow(run, "part int, entries binary")


def joined_cells(cell, n, pos, cls, sig):
    """A spanning forest, as index pairs, of the candidate pairs in each cell of sorted entries."""
    n, pos = n.astype(np.int64), pos.astype(np.int64)
    _, label = np.unique(cls, return_inverse=True)
    live, off, pairs = np.arange(len(cell)), 1, []
    while len(live):
        live = live[live + off < len(cell)]
        live = live[cell[live] == cell[live + off]]
        live = live[n[live] * 5 >= n[live + off] * 4]
        a = live[label[live] != label[live + off]]
        b = a + off
        need = overlap_needed(n[a], n[b])
        ok = np.minimum(n[a] - pos[a], n[b] - pos[b]) >= need
        a, b, need = a[ok], b[ok], need[ok]
        a = a[apart(n, sig, a, b, n[a] + n[b] - 2 * need)]
        if len(a):
            label = _unite(label, a, a + off, pairs)
        off += 1
    return pairs


def _unite(label, a, b, pairs):
    """Join the labels of a[i] and b[i]; note the pairs that joined two."""
    root: dict[int, int] = {}

    def find(x):
        while (y := root.get(x, x)) != x:
            root[x] = root.get(y, y)
            x = y
        return x

    for i, j, x, y in zip(a.tolist(), b.tolist(), label[a].tolist(), label[b].tolist(), strict=True):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
            pairs.append((i, j))
    if root:
        to = np.arange(int(label.max()) + 1)
        for x in root:
            to[x] = find(x)
        label = to[label]
    return label


def candidate_links(entries: DataFrame) -> DataFrame:
    """(a, b): links between classes that join all candidates."""

    def join(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, n, pos, cls, sig = (np.concatenate(c) for c in zip(*(unpack_entries(c.as_buffer()) for b in batches for c in b.column(1)), strict=True))
        keep = np.argsort(cell)
        twin = np.zeros(len(keep) + 1, bool)
        twin[1:-1] = cell[keep][1:] == cell[keep][:-1]
        keep = keep[twin[1:] | twin[:-1]]
        o = keep[np.lexsort((cls[keep], cell[keep].astype(np.uint64) << np.uint64(32) | n[keep]))]
        once = np.ones(len(o), bool)
        once[1:] = (cell[o][1:] != cell[o][:-1]) | (cls[o][1:] != cls[o][:-1])
        o = o[once]
        i = np.array(joined_cells(cell[o], n[o], pos[o], cls[o], sig[o]), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_pydict({"a": pa.array(cls[o][i[:, 0]]), "b": pa.array(cls[o][i[:, 1]])})

    return entries.groupBy("part").applyInArrow(join, "a long, b long")


def bloom_bits(cls: np.ndarray):
    h = mix(cls.view(np.uint64) + np.uint64(5))
    return [(h >> np.uint64(s)) & np.uint64(BLOOM_BITS - 1) for s in (0, 24, 40)]


def bloom(ids: DataFrame) -> np.ndarray:
    """A fixed-size Bloom filter of a long column, as one byte per bit on use."""
    size = BLOOM_BITS // 64

    def run(batches):
        bits = np.zeros(BLOOM_BITS, bool)
        for b in batches:
            for h in bloom_bits(b.column(0).to_numpy(zero_copy_only=False)):
                bits[h.astype(np.int64)] = True
        parts = np.packbits(bits).reshape(64, -1)
        keep = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_pydict({"slice": pa.array(keep, pa.int32()), "bits": pa.array([parts[i].tobytes() for i in keep], pa.binary())})

    def either(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(size // 8, np.uint8)
        for b in batches:
            for c in b.column(1):
                out |= np.frombuffer(c.as_buffer(), np.uint8)
        yield pa.RecordBatch.from_pydict({"slice": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([out.tobytes()], pa.binary())})

    size = BLOOM_BITS // 8 // 64 * 8
    out = np.zeros((64, size // 8), np.uint8)
    for r in ids.mapInArrow(run, "slice int, bits binary").groupBy("slice").applyInArrow(either, "slice int, bits binary").collect():
        out[r["slice"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def fetch_sets(df: DataFrame, text_col: str, counts: np.ndarray, bits: np.ndarray) -> DataFrame:
    """(cls, tokens binary): the token sets of the classes in the filter (and some more)."""
    held = df.sparkSession.sparkContext.broadcast((rarity(counts), bits))

    def run(batches):
        levels, packed = held.value
        bits = np.unpackbits(packed).astype(bool)
        fresh_ones = Fresh()
        for _, texts in text_slices(batches, "t", TEXT_SLICE):
            w = Words(texts)
            full, cls = classes_of(w)
            hit = np.ones(len(cls), bool)
            for h in bloom_bits(cls):
                hit &= bits[h.astype(np.int64)]
            new = fresh_ones.pick(cls, hit)
            if not len(new):
                continue
            tok, first, n = _sets(w, full, new, levels)
            raw = tok.tobytes()
            yield pa.RecordBatch.from_pydict({"cls": pa.array(cls[new]), "tokens": pa.array([raw[8 * i : 8 * (i + k)] for i, k in zip(first.tolist(), n.tolist(), strict=True)], pa.binary())})

    return df.select(F.col(text_col).alias("t")).mapInArrow(run, "cls long, tokens binary")


def exact_links(sets: list[np.ndarray], side: np.ndarray, both: bool):
    """Index pairs (i, j) of sets with Jaccard >= 0.8; between the two sides, or within if not ``both``.

    The overlaps of all pairs are one product of 0/1 matrices over the tokens of the group that at
    least two of its sets hold.
    """
    n = np.array([len(s) for s in sets])
    row = np.repeat(np.arange(len(sets)), n)
    tok, inv, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(times > 1)
    if not len(shared):
        return np.zeros((0, 2), np.int64)
    to = np.full(len(tok), -1)
    to[shared] = np.arange(len(shared))
    col = to[inv]
    row, col = row[col >= 0], col[col >= 0]
    left = np.flatnonzero(side == 0) if both else np.arange(len(sets))
    right = np.flatnonzero(side == 1) if both else np.arange(len(sets))
    overlap = np.zeros((len(left), len(right)), np.float32)
    place = np.zeros(len(sets), np.int64)
    for at in range(0, len(shared), 4096):
        inside = (col >= at) & (col < at + 4096)
        wide = np.zeros((len(sets), min(4096, len(shared) - at)), np.float32)
        wide[row[inside], col[inside] - at] = 1
        overlap += wide[left] @ wide[right].T
    place[left] = np.arange(len(left))
    i, j = np.nonzero(overlap * 9 >= (n[left][:, None] + n[right][None, :]) * 4)
    i, j = left[i], right[j]
    return np.stack([i, j], 1) if both else np.stack([i, j], 1)[i < j]


def verified(members: DataFrame, chunk: tuple[int, int] = GROUP_CHUNK) -> DataFrame:
    """(cls, n_links, first): links of each class to others of its group, from exact comparison.

    ``members``: (cls, grp, tokens, at), ``at`` the (id, line_no) struct of the class's first line. A task holds the
    sets of one cell, two chunks at most.
    """
    kind = members.schema["at"].dataType.simpleString()
    sizes = materialize(members.groupBy("grp").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "lines-sizes")
    per = F.least(F.lit(chunk[1]), F.greatest(F.lit(chunk[0]), F.ceil(F.sqrt("size"))))
    k = F.ceil(F.col("size") / per).cast("int")
    mine = F.pmod(F.xxhash64("cls", F.lit(3)), k.cast("long")).cast("int")
    cells = members.join(sizes, "grp").select("cls", "tokens", "at", "grp", mine.alias("side"), F.explode(F.transform(F.sequence(F.lit(0), k - 1), lambda j: F.struct(F.least(j, mine).alias("i"), F.greatest(j, mine).alias("j")))).alias("c"))
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = cells.select("cls", "tokens", "at", "grp", "c.i", "c.j", "side").repartition(n, "grp", "i", "j").sortWithinPartitions("grp", "i", "j")

    def compare(rows: pa.RecordBatch):
        """The links of one cell."""
        i, j, side, cls = (rows.column(c).to_numpy() for c in ("i", "j", "side", "cls"))
        sets = [np.frombuffer(t.as_buffer(), np.uint64) for t in rows.column("tokens")]
        pairs = exact_links(sets, (side == j[0]).astype(int), bool(i[0] != j[0]))
        if not len(pairs):
            return
        ends = np.concatenate([pairs, pairs[:, ::-1]])
        at = rows.column("at").to_pylist()
        order = sorted(range(len(at)), key=lambda x: (at[x]["id"] is not None, at[x]["id"], at[x]["line_no"]))
        rank = np.empty(len(at), np.int64)
        rank[order] = np.arange(len(at))
        least = np.full(len(at), len(at))
        np.minimum.at(least, ends[:, 0], rank[ends[:, 1]])
        found, counts = np.unique(ends[:, 0], return_counts=True)
        firsts = rows.column("at").take(pa.array(np.array(order)[least[found]]))
        yield pa.RecordBatch.from_arrays([pa.array(cls[found], pa.int64()), pa.array(counts, pa.int64()), firsts], ["cls", "n_links", "first"])

    def run(batches):
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            rows = b if held is None else pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
            g = np.stack([rows.column(c).to_numpy() for c in ("grp", "i", "j")], 1)
            cuts = np.flatnonzero(np.append(True, (g[1:] != g[:-1]).any(axis=1)))
            for a, z in zip(cuts, cuts[1:], strict=False):
                yield from compare(rows.slice(a, z - a))
            held = rows.slice(cuts[-1])
        if held is not None:
            yield from compare(held)

    found = cells.mapInArrow(run, f"cls long, n_links long, first {kind}")
    return found.groupBy("cls").agg(F.sum("n_links").alias("n_links"), F.min("first").alias("first"))


def classify_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tables: list | None = None) -> DataFrame:
    """(id, line_no, class_id, n_links, kept): one row per line with words. ``tables`` gets what the result reads."""
    spark = df.sparkSession
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    lines, counts = scan_lines(docs, "id", "t")
    firsts = lines.groupBy("cls").agg(F.min(F.struct("id", "line_no")).alias("at"))
    firsts = materialize(firsts, "lines-classes")
    entries = prefix_counts(docs, "t", counts)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")) * 8, int(entries.sum()) // PART_ENTRIES)
    edges = materialize(candidate_links(prefix_entries(docs, "t", counts, entries, parts)), "lines-links")
    groups = materialize(connected_components(edges, "lines-cc").select(F.col("node").alias("cls"), F.col("component").alias("grp")), "lines-groups")
    free(spark, edges)
    sets = fetch_sets(docs, "t", counts, bloom(groups.select("cls")))
    members = materialize(groups.join(firsts, "cls").join(sets.dropDuplicates(["cls"]), "cls"), "lines-members")
    found = materialize(verified(members), "lines-verified")
    free(spark, groups, members)
    told = firsts.join(found, "cls", "left").select("cls", "at", F.coalesce("n_links", F.lit(0)).alias("n_links"), (F.col("first").isNull() | (F.col("at") < F.col("first"))).alias("stays"))
    told = materialize(told, "lines-told")
    free(spark, firsts, found)
    release(spark)
    if tables is not None:
        tables += [lines, told]
    mine = F.struct("id", "line_no").eqNullSafe(F.col("at"))
    return lines.join(told, "cls").select(F.col("id").alias(id_col), "line_no", F.col("cls").alias("class_id"), "n_links", (F.col("stays") & mine).alias("kept"))


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with later matches taken out of its texts; no row goes, other columns stay.

    A text whose lines all go becomes empty. The lines that go grow with the texts, so both meet by a shuffle at any size.
    """
    tables: list = []
    key, lost = fresh(df, "id", "gone")
    gone = classify_lines(df, id_col, text_col, tables).where(~F.col("kept"))
    gone = materialize(gone.groupBy(F.col(id_col).alias(key)).agg(F.collect_set("line_no").alias(lost)), "lines-gone")
    free(df.sparkSession, *tables)
    kept = F.array_join(F.filter(F.transform(F.split(text_col, "\n"), lambda x, i: F.when(~F.array_contains(lost, i), x)), lambda x: x.isNotNull()), "\n")
    joined = df.join(gone.hint("merge"), F.col(id_col).eqNullSafe(F.col(key)), "left")
    return joined.withColumn(text_col, F.when(F.col(lost).isNotNull(), kept).otherwise(F.col(text_col))).select(*(F.col(f"`{c}`") for c in df.columns))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_lines(read_documents(spark, sf_dir))
