"""Toxicity by compression distance.

Two zstandard dictionaries are trained. The ordinary one, on ordinary text, in two layers: on windows, then on
the words that the first layer does not hold. The toxic one, on the words of toxic text that the ordinary one does
not hold; it is laid over the ordinary one, so that both code ordinary text alike. Every whole text is
lower-cased and cut into windows of about 128 bytes at white space; each window is compressed with both. Where a window
is toxic, the second length is shorter. The differences of a text (largest, number, share) are weighed by a logistic
model fitted on labelled texts that the dictionaries have not seen, and shifted so that the best F1 there falls at a
score of THRESHOLD.

The fit uses a bounded sample: at most ``sample`` labelled documents of each class, the first by a hash of the
id, two thirds of them for the dictionaries; and of these at most ``samples`` windows (or pieces of 64 bytes of words) for
each dictionary, the first by a hash. Windows are cut and texts are measured in the executors; what reaches the driver
is those windows and ten numbers a document. Scores depend on the text alone.

Defined cases: a null text counts as empty; an empty text is one empty window; repeated rows score
alike, and one of them is learnt from; equal scores are no tie to break: a score of THRESHOLD or more is toxic; rows
without a label are not learnt from, nor those with a null id; without both classes in the sample every score is 0; a
document labelled 0 and 1 is learnt from once per label; a very long text is scored whole, a window at a time; an empty
table gives no rows. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read_documents

SAMPLE = 6000
THRESHOLD = 0.3


@dataclass(frozen=True)
class Settings:
    """What ``toxicity_selection`` chooses, on rows that are not held out; sizes in bytes.

    ``base``, ``words`` and ``counter``: the layers of the ordinary dictionary; ``toxic``: the toxic one; ``segment`` and ``dmer``: of
    the trainer, for words; ``samples``: the most windows, or pieces of words, that a dictionary is trained on.
    """

    window: int = 128
    base: int = 16384
    words: int = 98304
    counter: int = 16384
    toxic: int = 3072
    segment: int = 24
    dmer: int = 8
    level: int = 9
    samples: int = 120000


SETTINGS = Settings()
_PIECE, _LEAST = 64, 4
#: Bytes by which the toxic dictionary must shorten an ordinary window for the layer ``counter``.
_HARD = 2


def windows(text: bytes, size: int = SETTINGS.window) -> list[bytes]:
    """The text in pieces of at most ``size`` bytes, cut before white space where there is some."""
    out, at = [], 0
    while at < len(text):
        to = at + size
        if to < len(text):
            cut = text.rfind(b" ", at + size // 2, to)
            to = cut if cut > 0 else to
        out.append(text[at:to])
        at = to
    return out or [b""]


def unheld(text: bytes, dictionary: bytes) -> list[bytes]:
    """The words of a text that a dictionary does not hold, each once, in pieces."""
    words = sorted({w for w in text.split() if len(w) >= _LEAST and w not in dictionary})
    return windows(b" " + b" ".join(words) + b" ", _PIECE) if words else []


def dictionary(size: int, samples: list[bytes], **how) -> bytes:
    """A trained zstandard dictionary, as bytes; of too little text the text itself."""
    try:
        return zstandard.train_dictionary(size, samples, **how).as_bytes()
    except zstandard.ZstdError:
        return b" ".join(samples)[-size:]


def compressor(content: bytes, level: int):
    if len(content) < 8:
        return zstandard.ZstdCompressor(level=level, write_content_size=False).compress
    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(level=level)
    return zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False).compress


class Model:
    """Both dictionaries, and the weights of the calibrated score."""

    def __init__(self, toxic: bytes, ordinary: bytes, settings: Settings = SETTINGS):
        self.toxic, self.ordinary, self.settings = toxic, ordinary, settings
        self.weights = np.zeros(0)
        self.mean = self.spread = np.zeros(0)

    def compressors(self):
        return compressor(self.ordinary, self.settings.level), compressor(self.toxic + self.ordinary, self.settings.level)

    def features(self, text: bytes, plain, marked) -> list[float]:
        d = np.array([len(plain(w)) - len(marked(w)) for w in windows(text, self.settings.window)], np.float64)
        top = np.sort(d)[::-1]
        n = len(d)
        return [top[0], top[:3].clip(0).mean(), *(np.log1p((d >= k).sum()) for k in (1, 2, 3, 4, 5)), d.clip(0).mean(), (d >= 3).mean(), float(np.log(n))]

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "made"}

    def fit(self, x: np.ndarray, y: np.ndarray) -> None:
        self.mean, self.spread = x.mean(axis=0), x.std(axis=0) + 1e-9
        a = np.c_[(x - self.mean) / self.spread, np.ones(len(x))]
        w = np.zeros(a.shape[1])
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            w -= np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 0.3 * np.eye(len(w)), a.T @ (p - y) + 0.3 * w)
        # the cut with the best F1 gets the score THRESHOLD
        z = a @ w
        order = np.argsort(-z, kind="stable")
        hits = np.cumsum(y[order])
        f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
        best = int(f1.argmax())
        cut = (z[order[best]] + z[order[min(best + 1, len(y) - 1)]]) / 2
        w[-1] += np.log(THRESHOLD / (1 - THRESHOLD)) - cut
        self.weights = w

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.zeros(len(x))
        z = np.c_[(x - self.mean) / self.spread, np.ones(len(x))] @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def shortened(text: bytes, model: Model) -> list[bytes]:
    """The windows of a text that the toxic dictionary shortens."""
    if not hasattr(model, "made"):  # once a task
        model.made = model.compressors()
    plain, marked = model.made
    return [w for w in windows(text, model.settings.window) if len(plain(w)) - len(marked(w)) >= _HARD]


def as_bytes(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "replace")


def _keyed(h: int, parts: list[bytes]):
    return [(xxhash.xxh64_intdigest(p, (h + i) & (1 << 64) - 1) >> 1, p) for i, p in enumerate(parts)]


class LocalRows:
    """Labelled rows (hash of the id, lower-cased text, label) in memory, for the choice of settings."""

    def __init__(self, rows: list[tuple[int, bytes, int]]):
        self.rows = rows

    def classes(self) -> list[set[int]]:
        return [{y for h, _, y in self.rows if (h % 3 == 2) == last} for last in (False, True)]

    def samples(self, y: int, cut, most: int) -> list[bytes]:
        found = (k for h, t, label in self.rows if label == y and h % 3 < 2 for k in _keyed(h, cut(t)))
        return [p for _, p in heapq.nsmallest(most, found)]

    def measured(self, model: Model) -> tuple[np.ndarray, np.ndarray]:
        a, b = model.compressors()
        rest = sorted((h, y, t) for h, t, y in self.rows if h % 3 == 2)
        return np.array([model.features(t, a, b) for _, _, t in rest]), np.array([float(y) for _, y, _ in rest])


class SparkRows:
    """The same of a DataFrame (h long, t string, y int): texts stay in the executors."""

    def __init__(self, df: DataFrame):
        self.df = df.withColumn("role", F.pmod("h", F.lit(3)))

    def classes(self) -> list[set[int]]:
        found = {(r["last"], r["y"]) for r in self.df.select((F.col("role") == 2).alias("last"), "y").distinct().collect()}
        return [{y for x, y in found if x == last} for last in (False, True)]

    def samples(self, y: int, cut, most: int) -> list[bytes]:
        def run(batches):
            for b in batches:
                rows = [k for h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for k in _keyed(h, cut(as_bytes(t)))]
                rows = heapq.nsmallest(most, rows)
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array([p for _, p in rows], pa.binary())], ["k", "p"])

        part = self.df.where((F.col("y") == y) & (F.col("role") < 2)).select("h", "t").mapInArrow(run, "k long, p binary")
        return [bytes(r["p"]) for r in part.orderBy("k", "p").limit(most).collect()]

    def measured(self, model: Model) -> tuple[np.ndarray, np.ndarray]:
        held = self.df.sparkSession.sparkContext.broadcast(model)

        def run(batches):
            model = held.value
            a, b = model.compressors()
            for batch in batches:
                x = [model.features(as_bytes(t), a, b) for t in batch.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.list_(pa.float64()))], ["h", "y", "x"])

        rows = self.df.where("role = 2").select("h", "y", "t").mapInArrow(run, "h long, y int, x array<double>").collect()
        rows = sorted((r["h"], r["y"], r["x"]) for r in rows)
        return np.array([x for _, _, x in rows]), np.array([float(y) for _, y, _ in rows])


def train(rows: LocalRows | SparkRows, settings: Settings = SETTINGS) -> Model:
    """Two thirds of the rows make the dictionaries, a third calibrates."""
    if any(len(c) < 2 for c in rows.classes()):
        return Model(b"", b"", settings)
    s = settings
    how = {"k": s.segment, "d": s.dmer}
    base = dictionary(s.base, rows.samples(0, lambda t: windows(t, s.window), s.samples))
    ordinary = dictionary(s.words, rows.samples(0, lambda t: unheld(t, base), s.samples), **how) + base
    first = Model(dictionary(s.toxic, rows.samples(1, lambda t: unheld(t, ordinary), s.samples), **how), ordinary, s)
    hard = rows.samples(0, lambda t: shortened(t, first), s.samples)
    both = dictionary(s.counter, [p for w in hard for p in unheld(w, ordinary)], **how) + ordinary
    model = Model(dictionary(s.toxic, rows.samples(1, lambda t: unheld(t, both), s.samples), **how), both, s)
    model.fit(*rows.measured(model))
    return model


def labelled_sample(df: DataFrame, labels: DataFrame, usable, id_col: str, text_col: str, sample: int) -> DataFrame:
    """(h, t, y): at most ``sample`` labelled documents of each class, the first by a hash of the id."""
    spark = df.sparkSession
    known = labels.select(F.col("doc_id").alias(id_col), F.col("toxic").cast("int").alias("y")).where("y is not null").where(usable)
    known = known.select(F.col(id_col).alias("i"), "y", F.xxhash64(F.col(id_col).cast("string")).alias("h")).distinct()
    # the ids are chosen from the labels alone: at most twice ``sample`` rows are broadcast, few texts are shuffled
    ids = known.where("y = 0").orderBy("h", "i").limit(sample).union(known.where("y = 1").orderBy("h", "i").limit(sample))
    texts = df.where(usable).select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    rows = texts.join(F.broadcast(ids), "i").groupBy("i", "y", "h").agg(F.min("t").alias("t"))
    n = min(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return materialize(rows.select("h", "t", "y").repartition(n, "h"), "toxicity-sample")


def score_texts(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row."""
    held = df.sparkSession.sparkContext.broadcast(model)
    kind = dict(df.dtypes)[id_col]

    def run(batches):
        model = held.value
        plain, marked = model.compressors()
        for b in batches:
            x = [model.features(as_bytes(t.as_py()), plain, marked) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(np.array(x)) if x else [], pa.float64())], ["id", "score"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def fold(id_col: str = "doc_id"):
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4))


def held_out(id_col: str = "doc_id"):
    """The rows whose labels are never looked at."""
    return fold(id_col) == 2


def fitted(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, settings: Settings = SETTINGS) -> Model:
    return train(SparkRows(labelled_sample(df, labels, ~held_out(id_col), id_col, text_col, sample)), settings)


def op9_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    model = fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_texts(docs, model)
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` without the texts predicted toxic; all columns stay."""
    model = fitted(df, labels, id_col, text_col)
    held = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index(text_col)

    def run(batches):
        model = held.value
        plain, marked = model.compressors()
        for b in batches:
            x = [model.features(as_bytes(t.as_py()), plain, marked) for t in b.column(at)]
            if x:
                yield b.filter(pa.array(model.score(np.array(x)) < THRESHOLD))

    return df.mapInArrow(run, df.schema)
