"""Toxic spans by a linear-chain conditional random field over words.

Words carry one of two tags. Labels are given for documents only, so tokens are labelled
first: in documents labelled toxic, words are labelled toxic that have a feature (the word
or one of its beginnings) which occurs nearly only in toxic documents of the sample. The field's
weights (features to tags, transitions, first tags) are then fitted to the labelled
tokens by gradient steps on their likelihood. For every document forward-backward
gives each word's marginal; the document's score is calibrated from the chance that
at least one word is toxic, and words of a marginal of a half or more are the offending offsets.

A whole slab of documents is one chain, cut by first-tag matrices where a document
begins; both passes are prefix products of 2x2 matrices, taken in columns of blocks.

Texts without words (null, empty) get the score of no toxic word. A null doc_id is scored as any other and never learnt from; repeated rows each get a
row, with equal scores. A document with several labels has the least of them; without any label of either class nothing is learnt. Texts of any length are read whole, a longer one
than half a megabyte by itself. An empty table gives no rows; other columns are left out, whatever their names.
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
SAMPLE = {1: 1000, 0: 5000}
#: Documents that training looks at together.
SLAB = 200
#: A feature's beginnings in bytes; 0 is the whole word.
BEGINNINGS = (0, 3, 4, 5, 6)
BLOCK = 64


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashed features (one row a word), starts and ends in the laid bytes, each text's first word, and where texts begin."""
    data, begins = tx.lay(texts)
    if not len(data):
        return np.empty((0, len(BEGINNINGS)), np.int32), *[np.empty(0, np.int64)] * 2, np.zeros(len(texts) + 1, np.int64), begins
    starts, ends, kind = tx.class_runs(data)
    starts, ends = starts[kind == 1], ends[kind == 1]
    prefix = tx.prefix_sums(tx.LOWER[data])
    out = np.empty((len(starts), len(BEGINNINGS)), np.int32)
    for i, n in enumerate(BEGINNINGS):
        h = tx.range_hashes(prefix, starts, ends if not n else np.minimum(starts + n, ends))
        out[:, i] = tx.mix(h + U(i)) & U((1 << BITS) - 1)
    return out, starts, ends, np.searchsorted(starts, begins), begins


def _products(m: np.ndarray) -> np.ndarray:
    """v[t] = v[t-1] @ m[t] for row vectors, from (1, 1), each scaled to sum 1; m is (n, 2, 2)."""
    n = len(m)
    blocks = -(-n // BLOCK)
    full = np.zeros((blocks * BLOCK, 2, 2))
    full[:n] = m
    full[n:] = np.eye(2)
    full = np.ascontiguousarray(full.reshape(blocks, BLOCK, 4).transpose(1, 2, 0))  # place in block, entry, block
    p = full[0].copy()
    for k in range(1, BLOCK):
        q = full[k]
        p = np.stack([p[0] * q[0] + p[1] * q[2], p[0] * q[1] + p[1] * q[3], p[2] * q[0] + p[3] * q[2], p[2] * q[1] + p[3] * q[3]])
        p /= p.max(axis=0)
    into, a, b = np.empty((2, blocks)), 1.0, 1.0
    for k, (p0, p1, p2, p3) in enumerate(p.T.tolist()):
        into[0, k], into[1, k] = a, b
        a, b = a * p0 + b * p2, a * p1 + b * p3
        s = a + b
        a, b = a / s, b / s
    out = np.empty((BLOCK, 2, blocks))
    x, y = into
    for k in range(BLOCK):
        q = full[k]
        x, y = x * q[0] + y * q[2], x * q[1] + y * q[3]
        s = x + y
        x, y = x / s, y / s
        out[k, 0], out[k, 1] = x, y
    return out.transpose(2, 0, 1).reshape(-1, 2)[:n]


def marginals(e: np.ndarray, head: np.ndarray, trans: np.ndarray, init: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each word's chance of tag 1, the scaled forward and backward vectors and the matrices.

    e: log-odds of tag 1 from the word's features; head: words that begin a document;
    trans: 2x2 log-potentials; init: log-odds of tag 1 for a first word."""
    x = np.exp(np.clip(e, -30, 30))
    m = np.empty((len(e), 2, 2))
    m[:, :, 0], m[:, :, 1] = np.exp(trans[:, 0]), np.exp(trans[:, 1]) * x[:, None]
    m[head] = np.stack([np.ones(head.sum()), np.exp(init) * x[head]], axis=1)[:, None, :]
    forward = _products(m)
    # From the end: beta[t] = m[t+1] @ beta[t+1]; a document's last word meets a matrix of equal rows, so it starts from (1, 1).
    back = np.empty_like(m)
    back[:-1], back[-1:] = m[1:].transpose(0, 2, 1), 1.0
    backward = _products(back[::-1])[::-1]
    both = forward * backward
    return both[:, 1] / both.sum(axis=1), forward, backward, m


def toxic_features(texts: list[bytes], y: np.ndarray, share: float = 0.95) -> tuple[np.ndarray, int]:
    """Which features are of toxic documents (seen in so many of them that chance can't be why, and in nearly no others), and how many words clean documents have."""
    toxic, clean, words = max(1, int((y == 1).sum())), max(1, int((y == 0).sum())), 0
    least = max(4, int(np.ceil(np.log(1e-4) / np.log(toxic / (toxic + clean)))))
    counts = np.zeros((2, 1 << BITS))
    for k in range(0, len(texts), SLAB):
        f, _, _, first, _ = tokens(texts[k : k + SLAB])
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        words += int((y[k + doc] == 0).sum())
        for i in range(f.shape[1]):
            pair = np.unique(doc << BITS | f[:, i])
            np.add.at(counts, (y[k + (pair >> BITS)], pair & ((1 << BITS) - 1)), 1)
    rate = counts[1] / toxic
    return (counts[1] >= least) & (rate >= share * (rate + (counts[0] + 0.5) / clean)), words


def _chains(texts: list[bytes], y: np.ndarray, good: np.ndarray, every: int, around: int, model: dict | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, tags and chain heads of the words to learn from, a slab of documents at a time.

    Words of toxic documents near labelled ones; each every-th stretch of clean documents; and, with a model,
    words of clean documents that it takes for toxic, with those beside them."""
    out = []
    for k in range(0, len(texts), SLAB):
        f, _, _, first, _ = tokens(texts[k : k + SLAB])
        if not len(f):
            continue
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        toxic = y[k + doc] == 1
        tag = good[f].any(axis=1) & toxic
        keep = (np.convolve(tag, np.ones(2 * around + 1, np.float32), "same")[: len(f)] > 0) & toxic
        keep |= (np.arange(len(f)) // (2 * around) % every == 0) & ~toxic
        if model:
            head = np.concatenate([[True], np.diff(doc) > 0])
            wrong = (marginals(model["w"][f].sum(axis=1) + model["bias"], head, model["trans"], model["init"])[0] > 0.1) & ~toxic
            keep |= (np.convolve(wrong, np.ones(7, np.float32), "same")[: len(f)] > 0) & ~toxic
        at = np.flatnonzero(keep)
        if len(at):
            out.append((f[at], tag[at].astype(np.int8), np.concatenate([[True], (np.diff(doc[at]) > 0) | (np.diff(at) > 1)])))
    return tuple(np.concatenate(x) for x in zip(*out))


def _climb(model: dict, f: np.ndarray, tag: np.ndarray, head: np.ndarray, steps: int, rate: float, l2: float) -> dict:
    """Adagrad steps on the likelihood of the words' tags."""
    g2, gb2, gt2, gi2 = np.full(1 << BITS, 1e-3), 1e-3, np.full((2, 2), 1e-3), 1e-3
    inner, n = np.flatnonzero(~head), len(f)
    w, trans, bias, init = model["w"].copy(), model["trans"].copy(), model["bias"], model["init"]
    for _ in range(steps):
        p, forward, backward, m = marginals(w[f].sum(axis=1) + bias, head, trans, init)
        g = np.zeros(1 << BITS)
        for i in range(f.shape[1]):
            g += np.bincount(f[:, i], p - tag, minlength=1 << BITS)
        g = g / n * 100 + l2 * w
        pair = forward[inner - 1][:, :, None] * m[inner] * backward[inner][:, None, :]
        pair /= pair.sum(axis=(1, 2), keepdims=True)
        gt = pair.sum(axis=0)
        np.subtract.at(gt, (tag[inner - 1], tag[inner]), 1.0)
        gt, gb, gi = gt / n * 100, (p - tag).sum() / n * 100, (p - tag)[head].sum() / n * 100
        g2, gt2, gb2, gi2 = g2 + g * g, gt2 + gt * gt, gb2 + gb * gb, gi2 + gi * gi
        w -= rate * g / np.sqrt(g2)
        trans -= rate * gt / np.sqrt(gt2)
        bias -= rate * gb / np.sqrt(gb2)
        init -= rate * gi / np.sqrt(gi2)
    return model | {"w": w, "trans": trans, "bias": bias, "init": init}


def train(texts: list[bytes], labels: list[int], steps: int = 40, rate: float = 0.5, l2: float = 1e-4, around: int = 12) -> dict:
    """Weights, transitions, first-tag odds and calibration.

    Fitted twice: on words near labelled ones and stretches of clean documents, then also on the words of clean
    documents that the first fit takes for toxic."""
    model = {"w": np.zeros(1 << BITS), "bias": -3.0, "trans": np.zeros((2, 2)), "init": 0.0, "scale": np.array([0.0, 0.0, 0.0, -5.0])}
    y = np.array(labels, np.int64)
    if not y.any() or y.all():
        return model
    good, words = toxic_features(texts, y)
    if not good.any():
        return model
    every = max(1, words // (20 * around * int(y.sum())))
    for before in (None, True):
        model = _climb(model, *_chains(texts, y, good, every, around, before and model), steps, rate, l2)
    x = np.concatenate([summaries(texts[i : i + SLAB], model)[0] for i in range(0, len(texts), SLAB)])
    scale = np.zeros(4)
    for _ in range(100):  # damped Newton steps of a logistic regression with a weak prior
        q = 1 / (1 + np.exp(-np.clip(x @ scale, -35, 35)))
        scale -= 0.5 * np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + 0.05 * np.eye(4), x.T @ (q - y) + 0.05 * scale)
    return model | {"scale": scale}


def summaries(texts: list[bytes], model: dict, least: float = 0.5) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
    """What a document's score is made of, and its offending byte offsets.

    The first: log-odds of its likeliest toxic word and of the second, the logarithm of the expected number of toxic words, and 1."""
    out = np.tile([-12.0, -12.0, 0.0, 1.0], (len(texts), 1))
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    f, starts, ends, first, begins = tokens(texts)
    if not len(f):
        return out, spans
    head = np.zeros(len(f), bool)
    head[first[:-1][first[:-1] < len(f)]] = True
    p = np.clip(marginals(model["w"][f].sum(axis=1) + model["bias"], head, model["trans"], model["init"])[0], 1e-6, 1 - 1e-6)
    odds = np.log(p / (1 - p))
    total = np.concatenate([[0.0], np.cumsum(p)])
    out[:, 2] = np.log1p(total[first[1:]] - total[first[:-1]])
    some = np.flatnonzero(first[1:] > first[:-1])
    out[some, 0] = np.maximum.reduceat(odds, first[some])
    rest = odds.copy()
    top = np.flatnonzero(odds == np.repeat(out[some, 0], (first[1:] - first[:-1])[some]))
    rest[top[np.searchsorted(top, first[some])]] = -12.0
    out[some, 1] = np.maximum.reduceat(rest, first[some])
    hit = np.flatnonzero(p >= least)
    for t, d in zip(hit, np.searchsorted(begins, starts[hit], side="right") - 1):
        spans[d].append((int(starts[t] - begins[d]), int(ends[t] - begins[d])))
    return out, spans


def score(texts: list[bytes], model: dict) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
    """Scores, to 9 digits, so that a text's neighbours don't show in them, and offending byte offsets."""
    x, spans = summaries(texts, model)
    return np.round(1 / (1 + np.exp(-np.clip(x @ model["scale"], -35, 35))), 9), spans


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: dict[int, int] = SAMPLE) -> dict:
    return train(*labelled_sample(docs, labels, label, rows))


def _points(text: bytes, spans: list[tuple[int, int]]) -> str:
    """Byte offsets as code points, start-end, comma-joined."""
    if not spans:
        return ""
    point = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    return ",".join(f"{point[a]}-{point[b]}" for a, b in spans)


def scored(docs: DataFrame, model: dict, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted and spans (start-end in code points, end exclusive, comma-joined) of every row of docs."""
    def run(slab: pa.RecordBatch) -> pa.RecordBatch:
        texts = utf8(slab.column(1))
        s, spans = score(texts, model)
        return pa.RecordBatch.from_arrays(
            [slab.column(0), slab.column(2), pa.array(s), pa.array((s >= threshold).astype(np.int32)), pa.array([_points(t, o) for t, o in zip(texts, spans)], pa.string())], names=["doc_id", "held_out", "score", "predicted", "spans"]
        )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out(F.col("doc_id")).alias("held_out"))
    return map_text(rows, run, "doc_id long, held_out boolean, score double, predicted int, spans string")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, fit(docs, table(spark, sf_dir, "labels")))
