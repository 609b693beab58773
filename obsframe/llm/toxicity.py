"""Operator 5: toxicity by non-negative positive-unlabelled learning.

Confirmed toxic examples (P) and unlabelled text (U) train a linear model over the presence of words. The risk is
prior * R_P(+) + max(0, R_U(-) - prior * R_P(-)), so a model that fits the sample gains nothing from pushing the
negative part below zero; when it is below, the step follows the positive part, and goes up the negative part's gradient
a little. A proximal step after each update keeps the weights sparse, so words without evidence have no say in long
texts; the model is the mean of the later half of the steps, which does not depend on where the last one fell.

Training uses bounded samples (P_ROWS, U_ROWS, those with the least hashes), drawn by id; scoring reads every whole
text. Unlabelled text is drawn from all documents outside the held-out fold, labels unread, as the risk estimator
supposes. Labels come only from rows outside that fold; ids, languages and sources are never features.

Nulls: a null text has no words and gets the model's score for none, as an empty one; a null id is in no training
sample and not held out; null labels are not positive. Repeated rows are scored alike; an id with several texts may
train with each. Very long texts are read whole: only their distinct words are kept. Without positive examples or
documents to train on, every score is the prior, 0 if unknown. Empty table: no rows. Other columns are never read by
`score_documents`, and kept by `drop_toxic`.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .work import bound_batches, held_out, spread

#: Bounds of the two training samples, in rows.
P_ROWS, U_ROWS = 3_000, 6_000
MIN_DOCS = 4
#: How far steps go up the negative part of the risk where it is below zero.
ASCENT = 0.03
#: Bytes of a word's beginning.
STEM = 4
_WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def word_codes(text: str | None) -> np.ndarray:
    """Hashes of the distinct words of a text and of their beginnings, which stand for inflected forms."""
    words = set(_WORDS.findall(text.encode("utf-8", "replace").lower())) if text else set()
    beginnings = {w[:STEM] for w in words}
    return np.concatenate((np.fromiter(map(zlib.crc32, words), np.uint32, len(words)), np.fromiter(map(zlib.crc32, beginnings), np.uint32, len(beginnings)) ^ np.uint32(0x5BD1E995)))


@dataclass
class LinearWords:
    codes: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, texts: list) -> np.ndarray:
        each = [word_codes(t) for t in texts]
        flat = np.concatenate(each) if each else np.zeros(0, np.uint32)
        owner = np.repeat(np.arange(len(each)), [len(e) for e in each])
        z = np.full(len(each), self.bias)
        if len(self.codes) and len(flat):
            at = np.minimum(np.searchsorted(self.codes, flat), len(self.codes) - 1)
            z += np.bincount(owner, weights=np.where(self.codes[at] == flat, self.weights[at], 0.0), minlength=len(each))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def risk(z: np.ndarray, n_p: int, prior: float, ascent: float) -> tuple[float, float, np.ndarray]:
    """Of outputs z, those of n_p positives first: the positive part of the risk (logistic loss), the negative part, which
    may be below zero, and what a step follows down: the gradient by z of their sum, or, where the negative part is
    below zero, of the positive part less the negative one times ascent."""
    s, is_p = 1 / (1 + np.exp(-z)), np.arange(len(z)) < n_p
    as_negative = np.logaddexp(0, z)
    plus = prior * np.logaddexp(0, -z[is_p]).mean()
    minus = as_negative[~is_p].mean() - prior * as_negative[is_p].mean()
    g_minus = np.where(is_p, -prior * s / n_p, s / (len(z) - n_p))
    return plus, minus, np.where(is_p, prior * (s - 1) / n_p, 0) + g_minus * (-ascent if minus < 0 else 1)


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, rounds: int = 300, rate: float = 0.1, l1: float = 0.005, ascent: float = ASCENT) -> LinearWords:
    """Fit by adaptive full-batch steps of falling length on the non-negative risk with the logistic loss (see risk()). l1
    shrinks with the root of the number of positives, as the sampling error of the gradient does."""
    if not positive or not unlabelled:
        p = min(max(prior, 1e-6), 1 - 1e-6)
        return LinearWords(np.zeros(0, np.uint32), np.zeros(0), float(np.log(p / (1 - p))))
    prior = min(max(prior, 1e-6), 1 - 1e-6)
    rows = positive + unlabelled
    codes, column = np.unique(np.concatenate(rows), return_inverse=True)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    known = np.bincount(column, minlength=len(codes)) >= MIN_DOCS
    used = known[column]
    column, owner, codes = (np.cumsum(known) - 1)[column[used]], owner[used], codes[known]
    n_p, n = len(positive), len(codes)
    # Sums over rows, and over columns, are sums of neighbours; each column has some entries, a row may have none.
    filled, row_at = np.unique(owner, return_index=True)
    order = np.argsort(column, kind="stable")
    of_column, column_at = owner[order], np.searchsorted(column[order], np.arange(n))
    l1 = l1 / np.sqrt(n_p)
    x = np.zeros(n + 1)
    x[n] = np.log(prior / (1 - prior))
    drift, size, total = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1)
    for t in range(1, rounds + 1):
        z = np.full(len(rows), x[n])
        if n:
            z[filled] += np.add.reduceat(x[column], row_at)
        _, _, g = risk(np.clip(z, -30, 30), n_p, prior, ascent)
        grad = np.append(np.add.reduceat(g[of_column], column_at) if n else np.zeros(0), g.sum())
        drift, size = 0.9 * drift + 0.1 * grad, 0.99 * size + 0.01 * grad**2
        step = rate / np.sqrt(1 + t / 50) / (np.sqrt(size / (1 - 0.99**t)) + 1e-4)
        x = x - step * drift / (1 - 0.9**t)
        x[:n] = np.sign(x[:n]) * np.maximum(np.abs(x[:n]) - step[:n] * l1, 0)
        if 2 * t > rounds:
            total += x
    x = total / max(1, rounds - rounds // 2)
    keep = np.flatnonzero(x[:n])
    return LinearWords(codes[keep], x[keep], float(x[n]))


def _sample(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> list[np.ndarray]:
    """Word hashes of the texts of a bounded list of ids."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([word_codes(t) for t in batch.column(0).to_pylist()], pa.list_(pa.int64()))], ["codes"])

    texts = bound_batches(docs).select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).join(F.broadcast(ids), "i").select("t")
    got = texts.mapInArrow(run, "codes array<long>").toArrow().column(0)
    return [np.array(c.values, np.uint32) for c in got]


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", p_rows: int = P_ROWS, u_rows: int = U_ROWS, prior: float | None = None) -> LinearWords:
    """Train from labelled positives and from documents of the corpus, labels unread. prior: share of positives in the corpus; by
    default that among the labelled training rows."""
    known = labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y")).where(F.col("i").isNotNull() & ~held_out(F.col("i")))
    counts = known.agg(F.sum(F.when(F.col("y") == 1, 1).otherwise(0)).alias("p"), F.count("y").alias("n")).first()
    if prior is None:
        prior = (counts["p"] or 0) / counts["n"] if counts["n"] else 0.0
    order = F.xxhash64("i")
    p_ids = known.where("y = 1").select("i").distinct().orderBy(order, "i").limit(p_rows)
    rest = docs.select(F.col(id_col).alias("i")).where(F.col("i").isNotNull() & ~held_out(F.col("i"))).distinct()
    u_ids = rest.orderBy(order, "i").limit(u_rows)
    return train(_sample(docs, p_ids, id_col, text_col), _sample(docs, u_ids, id_col, text_col), prior)


def score_documents(docs: DataFrame, model: LinearWords, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the words of the training samples

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.scores(batch.column(1).to_pylist()))], ["doc_id", "score"])

    return spread(bound_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))).mapInArrow(run, "doc_id long, score double")


def drop_toxic(docs: DataFrame, model: LinearWords, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs whose score is below the threshold."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(shared.value.scores(batch.column(at).to_pylist()) < threshold))

    return spread(bound_batches(docs)).mapInArrow(run, docs.schema)


def predicted(score: Column, threshold: float = 0.5) -> Column:
    return F.when(score >= threshold, 1).otherwise(0).cast("int")
