"""Quality scores: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader updates.

Words are runs of letters and digits; runs of other marks are words of their own. Each
word gives its unigram, its bigram with the word before, its shape (all capitals,
capitalised, digits, marks, plain) and whether it repeats the last word. A document's
features are frequencies, so that its score is one sparse dot product divided by its length.

Texts that are null, empty or white space have no features and get the score of the bias. A null doc_id is scored as any other and never learnt from; repeated
rows each get a row, with equal scores. A document with several labels has the least of them. Texts of any length are read whole, a longer one than half a megabyte by itself. An
empty table gives no rows; other columns are left out, whatever their names, and `passing` returns the columns it was given.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewarden.llm import text as tx
from lakewarden.llm.common import held_out, labelled_sample, map_text, table, utf8

U = np.uint64
BITS = 18
#: At most so many documents of each label are learnt from.
SAMPLE = {1: 2400, 0: 600}
SCALE = 20.0


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed feature numbers of all words of all texts, four a word, and each text's first (one more entry for the end)."""
    data, begins = tx.lay(texts)
    if not len(data):
        return np.empty(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    starts, ends, kind = tx.class_runs(data)
    h = tx.run_hashes(tx.LOWER[data], starts, ends)
    first = np.searchsorted(starts, begins)
    upper = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))])
    digit = np.concatenate([[0], np.cumsum((data >= 48) & (data <= 57))])
    n, up, dig = ends - starts, upper[ends] - upper[starts], digit[ends] - digit[starts]
    shape = np.where(kind == 2, 1, np.where(dig == n, 2, np.where((up == n) & (n > 1), 3, np.where(up > 0, 4, 5)))).astype(U)
    head = np.zeros(len(h), bool)
    head[first[:-1][first[:-1] < len(h)]] = True
    before = np.concatenate([[U(0)], h[:-1]]) if len(h) else h
    before[head] = U(1)
    out = np.empty((len(h), 4), np.int64)
    mask = U((1 << BITS) - 1)
    out[:, 0] = h & mask
    out[:, 1] = tx.mix(h + before * U(0xD1342543DE82EF95)) & mask
    out[:, 2] = tx.mix(shape + U(77)) & mask
    out[:, 3] = tx.mix((h == before).astype(U) + U(99)) & mask
    return out.reshape(-1), first * 4


def train(texts: list[bytes], labels: list[int], epochs: int = 4, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1) -> np.ndarray:
    """Weights, the bias last, after `epochs` passes of FTRL-proximal updates, one document at a time in the order given."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    bias = 1 << BITS
    docs = []
    for i in range(0, len(texts), 256):
        f, first = features(texts[i : i + 256])
        for a, b in zip(first[:-1], first[1:]):
            x, c = np.unique(f[a:b], return_counts=True)
            docs.append((np.append(x, bias), np.append(c * (SCALE / max(b - a, 1)), 1.0)))
    for _ in range(epochs):
        for (x, v), y in zip(docs, labels):
            zx, nx = z[x], n[x]
            w = np.where(np.abs(zx) <= l1, 0.0, -(zx - np.sign(zx) * l1) / ((beta + np.sqrt(nx)) / alpha + l2))
            g = (1 / (1 + np.exp(-np.clip(w @ v, -35, 35))) - y) * v
            sigma = (np.sqrt(nx + g * g) - np.sqrt(nx)) / alpha
            z[x] = zx + g - sigma * w
            n[x] = nx + g * g
    return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))


def score(texts: list[bytes], weights: np.ndarray) -> np.ndarray:
    """The probability of label 1 of each text, to 9 digits, so that a text's neighbours don't show in it."""
    f, first = features(texts)
    sums = np.concatenate([[0.0], np.cumsum(weights[f])])
    dot = (sums[first[1:]] - sums[first[:-1]]) * SCALE / np.maximum(first[1:] - first[:-1], 1) + weights[-1]
    return np.round(1 / (1 + np.exp(-np.clip(dot, -35, 35))), 9)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: dict[int, int] = SAMPLE) -> np.ndarray:
    """Weights learnt from a bounded sample of labelled rows. Without labelled rows every weight is 0 and every score a half."""
    return train(*labelled_sample(docs, labels, label, rows))


def scored(docs: DataFrame, weights: np.ndarray, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs."""

    def run(slab: pa.RecordBatch) -> pa.RecordBatch:
        s = score(utf8(slab.column(1)), weights)
        return pa.RecordBatch.from_arrays([slab.column(0), slab.column(2), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out(F.col("doc_id")).alias("held_out"))
    return map_text(rows, run, "doc_id long, held_out boolean, score double, predicted int")


def passing(docs: DataFrame, weights: np.ndarray, threshold: float = 0.3) -> DataFrame:
    """The rows of docs, all columns, that score at least `threshold`."""
    at = docs.columns.index("text")

    def run(slab: pa.RecordBatch) -> pa.RecordBatch:
        return slab.filter(pa.array(score(utf8(slab.column(at)), weights) >= threshold))

    return map_text(docs, run, docs.schema)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, fit(docs, table(spark, sf_dir, "labels")))
