"""Choose the toxicity operator's settings without the held-out rows.

``python -m textloom.llm.toxicity_selection SF_DIR ...`` fits every setting of GRID on the labelled rows of folds 0
and 1, and ranks them by the F1 of ``predicted`` on those of fold 3, the mean over all tables given. Labels of fold 2,
which is held out, are never read: the folds are filtered before the labels are joined. One line per setting, best first.
"""

from __future__ import annotations

import itertools
import sys
from multiprocessing import Pool

import numpy as np
from pyspark.sql import SparkSession

from .common import read_documents
from .toxicity import SAMPLE, THRESHOLD, LocalRows, Settings, as_bytes, fold, labelled_sample, train

GRID = [
    Settings(window=w, toxic=t, segment=k, dmer=d, samples=n)
    for (w, t), (k, d), n in itertools.product(((64, 2048), (96, 2048), (128, 3072)), ((20, 6), (24, 8)), (20000, 60000, 120000))
]


def figures(scores: np.ndarray, y: np.ndarray) -> tuple[float, float, float, float]:
    """(F1, precision, recall, AUC)."""
    said = scores >= THRESHOLD
    hits = float((said & (y == 1)).sum())
    precision, recall = hits / max(1, said.sum()), hits / max(1, (y == 1).sum())
    _, place, count = np.unique(scores, return_inverse=True, return_counts=True)
    rank = (np.cumsum(count) - (count - 1) / 2)[place]
    n = int((y == 1).sum())
    auc = (rank[y == 1].sum() - n * (n + 1) / 2) / max(1, n * (len(y) - n))
    return 2 * precision * recall / max(1e-9, precision + recall), precision, recall, float(auc)


def _hold(rows):
    global _ROWS
    _ROWS = rows


def _one(settings: Settings):
    fit, check = _ROWS
    model = train(LocalRows(fit), settings)
    a, b = model.compressors()
    x = np.array([model.features(t, a, b) for _, t, _ in check])
    return figures(model.score(x), np.array([y for _, _, y in check])), settings


def select(spark: SparkSession, sf_dir: str, grid: list[Settings] = GRID, workers: int = 8) -> dict[Settings, tuple[float, ...]]:
    docs, labels = read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    samples = [labelled_sample(docs, labels, fold().isin(f), "doc_id", "text", SAMPLE).collect() for f in ([0, 1], [3])]
    rows = [[(r["h"], as_bytes(r["t"]), r["y"]) for r in part] for part in samples]
    with Pool(workers, _hold, (rows,)) as pool:
        return {settings: found for found, settings in pool.imap_unordered(_one, grid)}


if __name__ == "__main__":
    session = SparkSession.builder.master("local[8]").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false").getOrCreate()
    tables = [select(session, path) for path in sys.argv[1:]]
    for chosen in sorted(GRID, key=lambda s: -sum(t[s][0] for t in tables)):
        print("; ".join("F1 %.3f precision %.3f recall %.3f AUC %.3f" % t[chosen] for t in tables), chosen)
