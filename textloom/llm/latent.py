"""Benchmark decontamination by latent semantic retrieval.

Passages of 64 words become TF-IDF rows over 2^14 hashed features (unit length). A one-pass randomised
SVD (Nystrom form) multiplies them with a random test matrix W and back, B = A'AW; B is a sum over
tasks of fixed size, and W'B and B give the right singular vectors V and values S. Texts are then seen
through the whitened factors V/S.

Search: for each length class of benchmark items, windows of that many words slide over every whole
text, one block of STEP words at a time and never over the end of a document (a shorter one is one window);
all items of the class are compared with all windows by cosine. An item's threshold is the least cosine that windows
half a block off disturbed copies of it (a quarter of the words replaced by words of the corpus) reach, however low.
Each candidate is checked on the words: the longest common subsequence with the item must hold half of it, and that
with its answer (the last sentence, or last quarter) half of that. Candidates whose span holds too few words of the
item for that are dropped first, by exact bounds.

Results do not hang on the layout: passages, blocks and windows start anew in every document, sums over tasks are
of integers, and the cosines that decide are rounded after a sum of fixed order.

Defined cases: a null or empty text has no words and no finding; an item without words is never found;
repeated rows are found each; repeated items are found each; of equally good windows of a document the greatest
cosine is told; empty tables give no rows. A null id is carried. A very long text is searched whole, in runs of
RUN blocks that overlap by a window. Other columns are not looked at, whatever their names. Items are taken in blocks
of ITEM_BLOCK, each a pass over the texts, so what is broadcast is bounded; it is freed after the pass.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, fresh, materialize, read_documents, sketch_rows, sum_sketches, text_slices

FEATURES, RANK, PASSAGE, STEP = 1 << 14, 64, 64, 8
ITEM_BLOCK = 2048
#: Blocks searched at once.
RUN = 4096
#: Fixed point of the sums that make up B.
SCALE = 1 << 12
#: Up to so many passages, a slice's part of B is a product of dense matrices.
DENSE = 256
LCS_SHARE, ANSWER_SHARE = 0.5, 0.5
_PARTS = 64
#: Bytes of text at once, in the passes over passages and in the search; the arrays of a slice should fit in a core's cache.
SLICE, SEARCH_SLICE = 64 << 10, 128 << 10
#: Disturbed copies of an item that its threshold is the least of.
TRIALS = 96


def feature(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(50)).astype(np.int64)


def _passages(w: Words):
    """(feature, passage) of each word; passages are numbered over the slice."""
    n = np.diff(w.first)
    per = -(-n // PASSAGE)
    base = np.cumsum(per) - per
    pos = np.arange(len(w.hash)) - np.repeat(w.first[:-1], n)
    return feature(w.hash), np.repeat(base, n) + pos // PASSAGE, int(per.sum())


def _blocks(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place in the row, first word) of each block of STEP words; blocks start anew in every row."""
    per = -(-np.diff(w.first) // STEP)
    row = np.repeat(np.arange(len(per)), per)
    place = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
    return row, place, w.first[row] + place * STEP


def block_sums(wide: np.ndarray, features: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Rows of ``wide``, whose last row is zero, added up word after word in each block (float32).

    A block's sum is the same wherever it stands.
    """
    out = np.empty((len(first), wide.shape[1]), np.float32)
    padded = np.append(features, np.zeros(STEP, np.int64))
    for a in range(0, len(first), 1024):
        b = slice(a, min(a + 1024, len(first)))
        part = out[b]
        np.take(wide, padded[first[b]], axis=0, out=part, mode="clip")
        more = np.empty_like(part)
        for j in range(1, STEP):
            np.take(wide, np.where(size[b] > j, padded[first[b] + j], len(wide) - 1), axis=0, out=more, mode="clip")
            part += more
    return out


def with_zero(wide: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(np.vstack([wide, np.zeros((1, wide.shape[1]), np.float32)]))


def document_frequencies(df: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int]:
    """(passages that hold each feature, passages)."""

    def run(batches):
        total = np.zeros(FEATURES + _PARTS, np.int64)
        for _, texts in text_slices(batches, "t", SLICE):
            f, p, n = _passages(Words(texts))
            keys = np.sort((p * FEATURES + f).astype(np.int32 if n * FEATURES < 1 << 31 else np.int64))
            keys = keys[np.diff(keys, prepend=-1) != 0]
            total[:FEATURES] += np.bincount(keys & (FEATURES - 1), minlength=FEATURES)
            total[FEATURES] += n
        yield from sketch_rows(total, len(total) // _PARTS)

    counts = sum_sketches(df.select(F.col(text_col).alias("t")).mapInArrow(run, "slice int, counts binary"), FEATURES + _PARTS)
    return counts[:FEATURES], int(counts[FEATURES])


def inverse_frequencies(counts: np.ndarray, passages: int) -> np.ndarray:
    return np.log((passages + 1) / (counts + 1)).astype(np.float32) + np.float32(0.01)


def test_matrix(rank: int) -> np.ndarray:
    return np.random.default_rng(6).standard_normal((FEATURES, rank)).astype(np.float32)


def range_product(df: DataFrame, idf: np.ndarray, rank: int = RANK, text_col: str = "text") -> np.ndarray:
    """B = A'AW: one pass; each task adds up one FEATURES x rank matrix, the sum is of that size."""
    held = df.sparkSession.sparkContext.broadcast(idf)

    def run(batches):
        idf = held.value
        wide = with_zero(test_matrix(rank) * idf[:, None])
        total = np.zeros((FEATURES, rank), np.int64)
        for _, texts in text_slices(batches, "t", SLICE):
            w = Words(texts)
            f, p, n = _passages(w)
            if not len(f):
                continue
            keys = np.sort((p * FEATURES + f).astype(np.int32 if n * FEATURES < 1 << 31 else np.int64))
            new = np.flatnonzero(np.diff(keys, prepend=-1))
            tf = np.diff(np.append(new, len(keys)))
            rows, features = np.divmod(keys[new], FEATURES)
            # the squared length of a row: (occurrences x idf)^2 of its features
            norm = np.add.reduceat((tf * idf[features].astype(np.float64)) ** 2, np.flatnonzero(np.diff(rows, prepend=-1)))
            row, place, first = _blocks(w)
            y = block_sums(wide, f, first, np.minimum(w.first[row + 1] - first, STEP))
            y = np.rint(np.add.reduceat(y, np.flatnonzero(place % (PASSAGE // STEP) == 0)) * (SCALE / norm)[:, None])
            times = np.bincount(f, minlength=FEATURES)
            found = np.flatnonzero(times)
            if n <= DENSE:  # a product of small matrices; sums of integers that float32 (or 64) holds exactly
                exact = np.float32 if np.abs(y).max() * times.max() < 1 << 24 else np.float64
                a = np.zeros((len(found), n), exact)
                a[(np.cumsum(times > 0) - 1)[features], rows] = tf
                total[found] += (a @ y.astype(exact)).astype(np.int64)
            else:
                order = np.argsort(features.astype(np.uint16), kind="stable")
                to = np.flatnonzero(np.diff(features[order], prepend=-1))
                total[found] += np.add.reduceat(y.astype(np.int64)[rows[order]] * tf[order, None], to)
        for i, part in enumerate(np.split(total, _PARTS)):
            if part.any():
                yield pa.RecordBatch.from_pydict({"slice": pa.array([i], pa.int32()), "rows": pa.array([part.tobytes()], pa.binary())})

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(FEATURES // _PARTS * rank, np.int64)
        for b in batches:
            for c in b.column(1):
                out += np.frombuffer(c.as_buffer(), np.int64)
        yield pa.RecordBatch.from_pydict({"slice": pa.array([key[0].as_py()], pa.int32()), "rows": pa.array([out.tobytes()], pa.binary())})

    out = np.zeros((_PARTS, FEATURES // _PARTS * rank))
    parts = df.select(F.col(text_col).alias("t")).mapInArrow(run, "slice int, rows binary")
    for r in parts.groupBy("slice").applyInArrow(add, "slice int, rows binary").collect():
        out[r["slice"]] = np.frombuffer(r["rows"], np.int64)
    return out.reshape(FEATURES, rank) / SCALE * idf[:, None].astype(np.float64)


def factors(b: np.ndarray, rank: int = RANK) -> tuple[np.ndarray, np.ndarray]:
    """(V, S) of the randomised SVD from B: A'A = B (W'B)^-1 B'."""
    core = test_matrix(rank).astype(np.float64).T @ b
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    good = values > max(values.max(), 0) * 1e-9
    half = b @ (vectors[:, good] / np.sqrt(values[good]))
    v, s, _ = np.linalg.svd(half, full_matrices=False)
    keep = s > s.max(initial=0) * 1e-6
    return v[:, keep], s[keep]


def _sentences(text: str) -> str:
    parts = [p for p in re.split(r"(?<=[.?!])\s+", text.strip()) if re.search(r"\w", p)]
    return parts[-1] if len(parts) > 1 else ""


class Item:
    """A benchmark item: its words and those of its answer, as hashes."""

    def __init__(self, ident, words: np.ndarray, tail: np.ndarray):
        self.ident, self.words = ident, words
        self.whole, self.answer = masks(words), masks(tail)
        self.n, self.n_answer = len(words), len(tail)
        self.window = max(2 * STEP, STEP * round(len(words) / STEP))

    @classmethod
    def of(cls, ident, text: str | None) -> Item:
        text = text or ""
        whole, last = Words(pa.array([text], pa.large_string())).hash, Words(pa.array([_sentences(text)], pa.large_string())).hash
        return cls(ident, whole, last if 3 <= len(last) < len(whole) else whole[-max(3, len(whole) // 4) :])


def masks(words: np.ndarray) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(words.tolist()):
        out[w] = out.get(w, 0) | 1 << i
    return out


def common_subsequence(mask: dict[int, int], n: int, words: list[int]) -> int:
    """Length of the longest common subsequence of n words (as bit masks) with a list of words."""
    full = (1 << n) - 1
    v = full
    for w in words:
        if m := mask.get(w):
            u = v & m
            v = (v + u | v - u) & full
    return n - v.bit_count()


class Cover:
    """How many words of an item a span of a slice can hold at most.

    The longest common subsequence is no longer than that, so what falls short needs no word check.
    """

    def __init__(self, items: list[Item]):
        self.vocab = np.unique(np.concatenate([it.words for it in items]))
        self.bits = np.zeros((len(self.vocab) + 1, -(-len(items) // 8)), np.uint8)
        for j, it in enumerate(items):
            self.bits[np.searchsorted(self.vocab, list(it.whole)), j >> 3] |= 1 << (j & 7)
        self.spare = np.array([it.n - len(it.whole) for it in items])

    def place(self, words: np.ndarray) -> None:
        """Take the words of a slice."""
        at = np.searchsorted(self.vocab, words)
        self.at = np.where(self.vocab[np.minimum(at, len(self.vocab) - 1)] == words, at, len(self.vocab))
        order = np.argsort(words, kind="stable")
        same = np.flatnonzero(words[order[1:]] == words[order[:-1]])
        self.before = np.full(len(words), -1)
        self.before[order[same + 1]] = order[same]

    def sums(self, first: np.ndarray, stop: int) -> np.ndarray:
        """(blocks + 1, items): words of each item's vocabulary in the blocks from ``first`` on, added up.

        Counts are of 16 bits and run over; differences of spans below 2^16 words are right.
        """
        inside = self.at[first[0] : stop]
        known = np.flatnonzero(inside < len(self.vocab))
        out = np.zeros((len(first) + 1, self.bits.shape[1] * 8), np.uint16)
        if len(known):
            block = np.searchsorted(first - first[0], known, "right")
            at = np.flatnonzero(np.diff(block, prepend=-1))
            # eight counts of a byte in a word: at most STEP words a block, so bytes do not run over
            flags = np.unpackbits(self.bits[inside[known]], axis=1, bitorder="little").view(np.uint64)
            out[block[at]] = np.add.reduceat(flags, at).view(np.uint8)
        return np.cumsum(out, axis=0, out=out)

    def most(self, start: np.ndarray, stop: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The bound without a span's repeated words, for many pairs of spans and items."""
        out = self.spare[j]
        for c in range(0, len(j), 1024):
            a, z, k = (x[c : c + 1024, None] for x in (start, stop, j))
            pos = a + np.arange(int((z - a).max()))
            first = pos < z
            np.minimum(pos, len(self.at) - 1, out=pos)
            first &= self.before[pos] < a
            out[c : c + 1024] += (first & (self.bits[self.at[pos], k >> 3] >> (k & 7).astype(np.uint8) & 1).astype(bool)).sum(axis=1)
        return out


def disturbed_threshold(item: Item, wide: np.ndarray, share: np.ndarray) -> float:
    """The least cosine of an item with windows that lie half a stride off a copy with words replaced.

    Other words are drawn as often as the corpus has them; ``share`` adds up the parts of the features.
    The draws hang on the item's words alone.
    """
    rng = np.random.default_rng(int(item.words.sum(dtype=np.uint64)))
    f = feature(item.words)
    me = wide[f].sum(axis=0)
    low = 1.0
    for k in range(TRIALS):
        around = np.searchsorted(share, rng.random(len(f) + 2 * item.window), "right")
        own = rng.random(len(f)) >= 0.25
        around[item.window : item.window + len(f)][own] = f[own]
        at = item.window + (STEP // 2 if k % 2 else -STEP // 2)
        other = wide[around[at : at + item.window]].sum(axis=0)
        low = min(low, float(me @ other / (np.linalg.norm(me) * np.linalg.norm(other) + 1e-12)))
    return min(0.75, low)


def item_rows(benchmark: DataFrame, wide: np.ndarray, counts: np.ndarray, item_col: str, item_text: str) -> DataFrame:
    """(item_id, words, tail, vector, threshold) of each item with words, made in the executors."""
    share = np.cumsum(counts) / max(1, counts.sum())
    share[share >= share[-1]] = 1
    held = benchmark.sparkSession.sparkContext.broadcast((wide, share))
    names = ["item_id", "words", "tail", "vector", "threshold"]

    def run(batches):
        wide, share = held.value
        for b in batches:
            rows = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                whole = Item.of(i, text)
                if not whole.n:
                    continue
                tail = whole.words[-whole.n_answer :]
                me = wide[feature(whole.words)].sum(axis=0)
                me = (me / (np.linalg.norm(me) + 1e-12)).astype(np.float32)
                rows.append((i, whole.words.tobytes(), tail.tobytes(), me.tobytes(), disturbed_threshold(whole, wide, share)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64()), strict=True)], names)

    return benchmark.select(F.col(item_col).cast("long"), F.col(item_text)).mapInArrow(run, "item_id long, words binary, tail binary, vector binary, threshold double")


class Searcher:
    """The items of a pass by length class, and the search of a slice of texts."""

    def __init__(self, items: list[tuple[Item, np.ndarray, float]], wide: np.ndarray):
        self.wide = with_zero(wide)
        classes: dict[int, list] = {}
        for row in items:
            classes.setdefault(row[0].window // STEP, []).append(row)
        self.items, self.classes = [], []
        for k, rows in sorted(classes.items()):
            base = len(self.items)
            self.items += [r[0] for r in rows]
            least = np.ceil(LCS_SHARE * np.array([r[0].n for r in rows]))
            self.classes.append((k, base, len(rows), np.stack([r[1] for r in rows]), np.array([r[2] for r in rows], np.float32), least.astype(np.uint16)))
        self.cover = Cover(self.items)

    def find(self, w: Words):
        """(document, item, lcs, answer, cosine) of the best finding of each document and item."""
        doc, place, first = _blocks(w)
        size = np.minimum(w.first[doc + 1] - first, STEP)
        left = -(-np.diff(w.first) // STEP)[doc] - place  # blocks from here to the end of the document
        longest = max(c[0] for c in self.classes)
        reach = longest + longest // 4 + 2  # a window and its margin
        self.cover.place(w.hash)
        f = feature(w.hash)
        best: dict[tuple[int, int], tuple] = {}
        for at in range(0, len(doc), RUN):
            to, end = min(len(doc), at + RUN), min(len(doc), at + RUN + reach)
            stop = int(first[end]) if end < len(doc) else len(w.hash)
            known = self.cover.sums(first[at:end], stop)
            known = np.concatenate([np.repeat(known[:1], reach, 0), known, np.repeat(known[-1:], reach, 0)])
            self._run(w, best, (doc, first, place, left), at, to, reach, block_sums(self.wide, f, first[at:end], size[at:end]), known)
        return [(d, self.items[j], *(-x for x in best[d, j])) for d, j in sorted(best)]

    def _run(self, w, best, parts, at, to, reach, sums, known):
        """The windows that start at blocks ``at`` to ``to``; ``sums``: of single blocks, ``known``: see Cover.sums."""
        doc, first, place, left = parts
        power = [sums]  # sums of 1, 2, 4, ... blocks

        def windows(k):
            """The sum of the k blocks from each block on (fewer rows than blocks), always in one order."""
            out, size = None, 0
            for bit in range(k.bit_length()):
                if len(power) == bit:
                    p = power[-1]
                    power.append(p[: max(0, len(p) - (1 << bit - 1))] + p[1 << bit - 1 :])
                if k >> bit & 1:
                    p = power[bit][size:]
                    out = p if out is None else out[: len(p)] + p
                    size += 1 << bit
            return out

        for k, base, m, vectors, limit, least in self.classes:
            margin = k * STEP // 4 + STEP
            near = -(-margin // STEP)
            mine = known[:, base : base + m]
            v = windows(k)[: to - at]
            lo = np.arange(at, at + len(v))
            # words of the items in each window and its margins; the front margin of a later run is not seen
            count = mine[reach + k + near :][: len(v)] - mine[reach - near :][: len(v)]
            if at:
                count[:near] += np.uint16(margin)
            whole = left[lo] >= k
            hi = lo + k
            # a shorter document is one window
            short = np.flatnonzero((place[at:to] == 0) & (left[at:to] < k)) + at
            if len(short):
                size = left[short]
                own = np.repeat(short, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                v = np.concatenate([v, np.add.reduceat(sums[own - at], np.cumsum(size) - size)])
                lo, hi, whole = np.concatenate([lo, short]), np.concatenate([hi, short + size]), np.concatenate([whole, np.ones(len(short), bool)])
                count = np.concatenate([count, mine[short + size - at + reach] - mine[short - at + reach]])
            if not len(lo):
                continue
            norm = np.sqrt(np.einsum("ij,ij->i", v, v))
            good = v @ vectors.T >= norm[:, None] * (limit - np.float32(1e-3))
            good &= count >= least
            i, j = np.divmod(np.flatnonzero(good), m)
            i, j = i[whole[i]], j[whole[i]]
            if not len(i):
                continue
            pair = v[i].astype(np.float64)
            cos = np.round((pair * vectors[j]).sum(axis=1) / (np.sqrt((pair * pair).sum(axis=1)) + 1e-12), 6)
            d = doc[lo[i]]
            begin = np.maximum(first[lo[i]] - margin, w.first[d])
            end = np.minimum(np.minimum(first[lo[i]] + (hi - lo)[i] * STEP, w.first[d + 1]) + margin, w.first[d + 1])
            keep = (cos >= np.round(limit[j].astype(np.float64), 6)) & (self.cover.most(begin, end, base + j) >= least[j])
            for x in np.flatnonzero(keep).tolist():
                it = self.items[base + j[x]]
                words = w.hash[begin[x] : end[x]].tolist()
                got = common_subsequence(it.whole, it.n, words)
                if got >= LCS_SHARE * it.n:
                    last = common_subsequence(it.answer, it.n_answer, words)
                    if last >= ANSWER_SHARE * it.n_answer:
                        found = (-got / it.n, -last / it.n_answer, -float(cos[x]))
                        key = int(d[x]), int(base + j[x])
                        best[key] = min(found, best.get(key, found))


def search(df: DataFrame, items: list[tuple[Item, np.ndarray, float]], wide: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """(id, item_id, cosine, lcs, answer): the checked findings, the best of each document and item."""
    held = df.sparkSession.sparkContext.broadcast(Searcher(items, wide))
    kind = dict(df.dtypes)[id_col]
    names = ["id", "item_id", "cosine", "lcs", "answer"]

    def run(batches):
        searcher = held.value
        for b, texts in text_slices(batches, "t", SEARCH_SLICE):
            found = searcher.find(Words(texts))
            if found:
                d, it, lcs, answer, cos = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(d)), pa.array([x.ident for x in it], pa.int64()), pa.array(cos), pa.array(lcs), pa.array(answer)], names)

    out = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"id {kind}, item_id long, cosine double, lcs double, answer double")
    out = materialize(out, "latent-found")
    held.destroy()
    return out.withColumnRenamed("id", id_col)


def leaks(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", rank: int = RANK) -> DataFrame:
    """(id, item_id, cosine, lcs, answer): one row per document and benchmark item found in it."""
    counts, passages = document_frequencies(df, text_col)
    idf = inverse_frequencies(counts, passages)
    v, s = factors(range_product(df, idf, rank, text_col), rank)
    wide = (v / s * idf[:, None]).astype(np.float32) if len(s) else np.zeros((FEATURES, 1), np.float32)
    rows = materialize(item_rows(benchmark, wide, counts, item_col, item_text), "latent-items")
    out, block = None, []

    def flush(out):
        part = search(df, block, wide, id_col, text_col)
        return part if out is None else out.union(part)

    for r in rows.toLocalIterator():
        words, tail = (np.frombuffer(r[c], np.uint64) for c in ("words", "tail"))
        block.append((Item(r["item_id"], words, tail), np.frombuffer(r["vector"], np.float32), r["threshold"]))
        if len(block) == ITEM_BLOCK:
            out, block = flush(out), []
    if block:
        out = flush(out)
    if out is None:
        kind = dict(df.dtypes)[id_col]
        out = df.sparkSession.createDataFrame([], f"id {kind}, item_id long, cosine double, lcs double, answer double").withColumnRenamed("id", id_col)
    return out


def op6_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def decontaminate(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` without the documents that hold a benchmark item; all columns stay."""
    bad = fresh(df, "bad")
    found = materialize(leaks(df, benchmark, id_col, text_col).select(F.col(id_col).alias(bad)).distinct(), "latent-leaks")
    return df.join(found, F.col(id_col).eqNullSafe(F.col(bad)), "left_anti")
