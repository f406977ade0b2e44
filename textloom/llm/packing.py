"""Best-fit packing with bins of several permitted sizes.

Packing depends on lengths alone, so the plan is made from the histogram of lengths (at most
``max(capacities)`` rows, whatever the input's size). Lengths are taken in descending order. All pieces of
a length go, as many at once as there are bins, to the open bins with the least room that fits them;
what is left opens new bins. Which sizes to open is decided jointly: a policy names the size to open for the
pieces of each class (a class: the least size that a piece fits). Plans are made for every permitted size as the preferred
one of all classes and for the size whose cost per token is least, given what is still to be packed; from the best of them the search
changes the size of one class at a time while the total cost falls, so that the sizes are chosen with regard to each other. At the
end every bin is downsized to the least size that holds its contents. ``Plan.bound`` is a cost that no packing can
go below, so total / bound tells how far a plan can be from the best.

Pieces then take their places by rank: pieces of equal length are numbered along the document id with
distributed slots, and a plan entry (length, first rank, bins) maps ranks to bins. Documents longer than the
largest size are cut into full bins and a rest.

Defined cases: a null or blank text has the separator token alone; repeated rows are packed like others; an
empty table gives no rows; pieces of equal length are ties, ranked by id and piece; a very long text is cut into full
bins and a rest. Other columns are not looked at.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, ordered_slots, read_documents

CAPACITIES = (512, 1024, 2048, 4096, 8192)
#: Cost of a bin: its tokens, plus attention growing with the square, plus a fixed share per sequence.
FIXED, QUADRATIC = 16.0, 1 / 32768


def cost(capacity: int) -> float:
    return FIXED + capacity + QUADRATIC * capacity * capacity


class Plan:
    """``entries``: (length, first rank, group, first bin, bins, offset); bin = the group's first + rank - first rank."""

    def __init__(self):
        self.entries: list[tuple] = []
        self.bins: list[tuple] = []  # (first bin, bins, contents)
        self.total = 0.0
        self.bound = 0.0


def _pack(histogram: dict[int, int], capacities: list[int], opened) -> Plan:
    """Best-fit decreasing on (length, count); ``opened(length, tokens left)`` gives a new bin's size.

    Bins with equal contents are one group (room, number, first bin, used): a group is split when only
    some of its bins take a piece.
    """
    plan, next_bin = Plan(), 0
    rooms: list[int] = []
    by_room: dict[int, list] = {}
    left = sum(k * v for k, v in histogram.items())

    def put(room, n, first, used):
        if room not in by_room:
            insort(rooms, room)
            by_room[room] = []
        by_room[room].append((n, first, used))

    for length in sorted(histogram, reverse=True):
        todo, rank = histogram[length], 0
        while todo:
            i = bisect_left(rooms, length)
            if i < len(rooms):
                room = rooms[i]
                n, first, used = by_room[room].pop()
                if not by_room[room]:
                    del by_room[room]
                    rooms.pop(i)
                take = min(n, todo)
                if take < n:
                    put(room, n - take, first + take, used)
            else:
                size = opened(length, left)
                per = max(1, min(todo, todo * length // size))
                take, first, used, room = per, next_bin, 0, size
                next_bin += take
            plan.entries.append((length, rank, first, take, used))
            put(room - length, take, first, used + length)
            rank += take
            todo -= take
            left -= take * length
    for room, groups in by_room.items():
        for n, first, used in groups:
            size = capacities[bisect_left(capacities, used)]
            plan.bins.append((first, n, used, size))
            plan.total += n * cost(size)
    return plan


def lower_bound(histogram: dict[int, int], capacities) -> float:
    """A piece's bin holds it and no more than its size, so its tokens cost at least the best rate of a size it fits."""
    sizes = sorted(capacities)
    best, rate = {}, float("inf")
    for s in reversed(sizes):
        best[s] = rate = min(rate, cost(s) / s)
    return sum(n * length * best[sizes[bisect_left(sizes, length)]] for length, n in histogram.items())


def plan_bins(histogram: dict[int, int], capacities=CAPACITIES) -> Plan:
    """The least-cost plan found over the policies of opening bins, with a lower bound of any plan's cost."""
    sizes = sorted(capacities)
    classes = sorted({bisect_left(sizes, length) for length in histogram})

    def cheapest(length, left):
        """The size with the least cost per token that will be in it."""
        return min((s for s in sizes if s >= length), key=lambda s: (cost(s) / min(s, max(length, left)), s))

    made: dict[tuple, Plan] = {}

    def plan_of(policy: tuple) -> Plan:
        if policy not in made:
            size_of = dict(zip(classes, policy, strict=True))
            made[policy] = _pack(histogram, sizes, lambda length, left: sizes[size_of[bisect_left(sizes, length)]])
        return made[policy]

    uniform = [tuple(max(i, c) for c in classes) for i in range(len(sizes))]
    best = min(uniform, key=lambda p: plan_of(p).total)
    better = True
    while better:
        better = False
        for at, c in enumerate(classes):
            for i in range(c, len(sizes)):
                tried = (*best[:at], i, *best[at + 1 :])
                if plan_of(tried).total < plan_of(best).total:
                    best, better = tried, True
    plan = min(plan_of(best), _pack(histogram, sizes, cheapest), key=lambda p: p.total)
    plan.bound = lower_bound(histogram, sizes)
    return plan


#: A word, as both engines see it: what stands between the white space of ASCII.
WORD = r"[^ \t\n\x0b\f\r]+"


def token_counts(text):
    """Words divided by white space, and a separator."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    return (F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"\s+"))) + 1).cast("long")


def pieces(df: DataFrame, capacities=CAPACITIES, id_col: str = "doc_id", n_tokens=None) -> DataFrame:
    """(id, piece, start, tokens): documents cut at the largest size."""
    most = max(capacities)
    counted = df.select(F.col(id_col), (token_counts(F.col("text")) if n_tokens is None else n_tokens).alias("n"))
    cut = counted.select(id_col, "n", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.floor((F.col("n") - 1) / most)))).alias("piece"))
    return cut.select(id_col, F.col("piece").cast("int").alias("piece"), (F.col("piece") * most).alias("start"), F.least(F.lit(most).cast("long"), F.col("n") - F.col("piece") * most).alias("tokens"))


def pack(parts: DataFrame, capacities=CAPACITIES, id_col: str = "doc_id") -> DataFrame:
    """Add bin_id, bin_size, bin_used and offset to pieces (id, piece, start, tokens, ...)."""
    spark = parts.sparkSession
    ranked = materialize(ordered_slots(parts, "tokens", [id_col, "piece"], "rank", "packing-ranks"), "packing-ranked")
    histogram = {r["tokens"]: r["n"] for r in ranked.groupBy("tokens").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = plan_bins(histogram, capacities)
    # both tables are bounded by the plan: some entries per distinct length (at most max(capacities))
    table = np.array(plan.entries, np.int64).reshape(-1, 5)
    order = np.lexsort((table[:, 1], table[:, 0]))
    table = table[order]
    ends = np.array(plan.bins, np.int64).reshape(-1, 4)
    ends = ends[np.argsort(ends[:, 0])]
    held = spark.sparkContext.broadcast((table, ends))
    kind = dict(parts.dtypes)[id_col]
    carried = [c for c in parts.columns if c not in (id_col, "piece", "start", "tokens")]
    names = ["id", "piece", "start", "tokens", *carried, "bin_id", "bin_size", "bin_used", "offset"]

    def place(batches):
        table, ends = held.value
        # (length, first rank) in one ascending key: ranks stay below 2^40
        key = (table[:, 0] << 40) + table[:, 1]
        for b in batches:
            tokens, rank = (b.column(i).to_numpy(zero_copy_only=False) for i in (3, b.num_columns - 1))
            at = np.searchsorted(key, (tokens << 40) + rank, "right") - 1
            bins = table[at, 2] + rank - table[at, 1]
            end = np.searchsorted(ends[:, 0], bins, "right") - 1
            out = [bins, ends[end, 3], ends[end, 2], table[at, 4]]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns - 1)), *(pa.array(x, pa.int64()) for x in out)], names)

    extra = "".join(f", {c} {dict(parts.dtypes)[c]}" for c in carried)
    schema = f"id {kind}, piece int, start long, tokens long{extra}, bin_id long, bin_size long, bin_used long, offset long"
    return ranked.select(F.col(id_col).alias("id"), "piece", "start", "tokens", *carried, "rank").mapInArrow(place, schema).withColumnRenamed("id", id_col)


def pack_texts(df: DataFrame, capacities=CAPACITIES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of all texts with their text and place: every byte of a text is in one piece.

    Only lengths are ranked and planned; the texts join their places at the end, on (id, piece).
    """
    most = max(capacities)
    kind = dict(df.dtypes)[id_col]
    word = re.compile(WORD)

    def cut(batches):
        for b in batches:
            rows, numbers, starts, tokens, texts = [], [], [], [], []
            for i, t in enumerate(b.column(1)):
                text = t.as_py() or ""
                n = len(word.findall(text)) + 1
                at = [0]
                if n > most:
                    at += [m.start() for k, m in enumerate(word.finditer(text)) if k and k % most == 0]
                count = max(1, -(-n // most))
                at = at[:count] + [len(text)] * (count + 1 - len(at[:count]))
                for k in range(count):
                    rows.append(i)
                    numbers.append(k)
                    starts.append(k * most)
                    tokens.append(min(most, n - k * most))
                    texts.append(text[at[k] : at[k + 1]])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(numbers, pa.int32()), pa.array(starts, pa.int64()), pa.array(tokens, pa.int64()), pa.array(texts, pa.string())], ["id", "piece", "start", "tokens", "text"])

    parts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(cut, f"id {kind}, piece int, start long, tokens long, text string")
    parts = materialize(parts.withColumn("_piece_id", F.monotonically_increasing_id()), "packing-pieces")
    placed = materialize(pack(parts.drop("text"), capacities, "id"), "packing-placed")
    return placed.join(parts.select("_piece_id", "text"), "_piece_id").drop("_piece_id").withColumnRenamed("id", id_col).withColumnRenamed("text", text_col)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # lengths are written first: ranging them samples its input, which would count the words twice
    return pack(materialize(pieces(read_documents(spark, sf_dir)), "packing-lengths"))
