"""Operator 10: quality by histogram gradient-boosted trees over document statistics.

Each whole text becomes a row of statistics. Trees are grown on binned statistics (histograms of gradients), all of one
depth, and flattened into arrays in heap order; a batch of documents goes down all trees as numpy index arithmetic.

Training uses a bounded sample of labelled rows (ROWS, those with the least hashes) outside the held-out fold; ids,
languages and sources are never features.

Nulls: a null text has the statistics of an empty one; a null id or label is in no sample, and a null id not held out.
Repeated rows are scored alike; an id labelled twice counts once, by the higher label. Very long texts are read whole,
one at a time. Ties: a value equal to a threshold goes left; of equal gains the first statistic and the lowest threshold
split. With one label only every score is the same, and 0.5 without any. Empty table: no rows. Other columns are never
read.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .work import bound_batches, held_out, spread

#: Bound of the training sample, in rows.
ROWS = 12_000
MARKS = "*#$%&|@_=+~^<>{}[]\\/"
ENDS = ".!?"


def statistics(text: str | None) -> list[float]:
    """Shape, repetition and character classes of a whole text; none depends on its words' meaning."""
    text = text or ""
    words, lines = text.split(), text.split("\n")
    n, size = max(1, len(words)), max(1, len(text))
    distinct = len(set(words))
    same = sum(map(operator.eq, words, words[1:]))
    same_two = sum(map(operator.eq, words, words[2:]))
    full = [x for x in lines if x.strip()]
    counts = [text.count(c) for c in MARKS]
    raw = text.encode("utf-8", "replace")
    letters = sum(map(len, words))
    return [
        np.log1p(len(words)), letters / n, distinct / n, same / n, same_two / n, distinct / n**0.5,
        sum(counts) / n, max(counts) / n, text.count("|") / n,
        sum(text.count(c) for c in "*#$%&") / n, sum(map(text.count, ENDS)) / n, text.count(",") / n,
        sum(map(text.count, "0123456789")) / size, len(full) / n, len(set(full)) / max(1, len(full)),
        sum(x.rstrip().endswith(tuple(ENDS)) for x in full) / max(1, len(full)), (len(raw) - len(text)) / size,
        max(map(len, full), default=0) / size, sum(1 for c in text if c.isupper()) / size if len(text) < 2000 else len(text.translate(_UPPER)) / size,
        (len(text) - letters) / size, max(map(len, words), default=0), text.count("http") / n, text.count("\n") / size,
        sum(map(text.count, "\"'();:-")) / n,
    ]


class _Upper(dict):
    """Deletes all but upper-case letters; remembers each character."""

    def __missing__(self, c: int):
        self[c] = c if chr(c).isupper() else None
        return self[c]


_UPPER = _Upper()


@dataclass
class FlatTrees:
    """Trees of one depth in heap order: feature and threshold of inner nodes, value of leaves."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    bias: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        row = np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < len(feature):
                node = 2 * node + 1 + (x[row, feature[node]] > threshold[node])
            z += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 3.0, least: float = 4.0) -> FlatTrees:
    inner = 2**depth - 1
    if not len(y) or y.min() == y.max():
        p = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
        return FlatTrees(np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, inner + 1)), float(np.log(p / (1 - p))))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)  # x > cut k: bin > k
    z0 = float(np.log(y.mean() / (1 - y.mean())))
    z = np.full(len(y), z0)
    features, thresholds, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        feature, threshold = np.zeros(inner, int), np.full(inner, np.inf)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            local = node - first
            gain, best = np.full(width, 1e-9), [(0, -1)] * width
            for f in range(x.shape[1]):
                cell = local * bins + binned[:, f]
                gs = np.bincount(cell, weights=g, minlength=width * bins).reshape(width, bins).cumsum(axis=1)
                hs = np.bincount(cell, weights=h, minlength=width * bins).reshape(width, bins).cumsum(axis=1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                score = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
                score[(hs < least) | (ht - hs < least)] = -1
                score = score[:, : len(cuts[f])]
                if score.shape[1]:
                    at = score.argmax(axis=1)
                    for k in np.flatnonzero(score[np.arange(width), at] > gain):
                        gain[k], best[k] = score[k, at[k]], (f, int(at[k]))
            for k, (f, at) in enumerate(best):
                if at >= 0:
                    feature[first + k], threshold[first + k] = f, cuts[f][at]
            node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > threshold[node])
        leaf = rate * np.bincount(node - inner, weights=g, minlength=inner + 1) / (np.bincount(node - inner, weights=h, minlength=inner + 1) + ridge)
        z += leaf[node - inner]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(leaf)
    return FlatTrees(np.array(features), np.array(thresholds), np.array(leaves), z0)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", rows: int = ROWS) -> FlatTrees:
    known = labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y")).where(F.col("i").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("i")))
    known = known.groupBy("i").agg(F.max("y").alias("y")).orderBy(F.xxhash64("i"), "i").limit(rows)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([statistics(t) for t in batch.column(0).to_pylist()], pa.list_(pa.float64()))], ["y", "x"])

    texts = bound_batches(docs).select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).join(F.broadcast(known), "i").select("t", "y")
    got = texts.mapInArrow(run, "y int, x array<double>").toArrow()
    y = np.array(got.column(0).to_pylist(), float)
    x = np.array(got.column(1).to_pylist(), float).reshape(len(y), len(statistics(None)))
    if len(y):  # the order of rows decides nothing but the last digits of sums
        order = np.lexsort((*x.T, y))
        x, y = x[order], y[order]
    return train(x, y)


def score_documents(docs: DataFrame, model: FlatTrees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of trees

    def run(batches):
        for batch in batches:
            x = np.array([statistics(t) for t in batch.column(1).to_pylist()], float).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.scores(x))], ["doc_id", "score"])

    return spread(bound_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))).mapInArrow(run, "doc_id long, score double")


def predicted(score: Column, threshold: float = 0.3) -> Column:
    return F.when(score >= threshold, 1).otherwise(0).cast("int")
