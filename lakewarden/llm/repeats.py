"""Passages that repeat across documents, by seed and extend.

A window is 13 consecutive words of one document (runs of bytes other than 32 and 9 to 13, unchanged). Every word covered by a window
whose words also start in a document with a smaller doc_id is removed.

1. Seeds. A window's anchor is the 6-word gram of the least keyed digest in it, the leftmost of equal ones. Equal windows choose equal
   anchors, and a document has about one anchor for four words. Anchors of one document only are dropped: nothing else there repeats.
2. Extension. An anchor is extended both ways to the ends of the windows that chose it. Such segments share out all windows of a document.
   Segments of equal words are one class; all its members but those of its first document are matched whole, without meeting each other.
3. Where segments of one anchor differ, some windows of a class's first document may yet be in an earlier document's segment. Only
   for these the windows themselves are compared, one segment a class, so that edges of a repeat are exact.
4. Matches that touch or overlap make one maximal repeat; its words are left out.

No pairs of documents are made: each step looks up the smallest doc_id of a digest, which is combined before its shuffle, in joins
whose other side can be split. Digests of segments and windows are 128 bits of keyed word digests. Windows are judged on the input.

Null and empty texts have no words, and texts of fewer than 13 words no windows; they come back whole. A window that repeats within its own
document only stays. A null doc_id is neither smaller nor larger than others: such rows are kept whole and remove nothing. Rows of one doc_id don't
remove each other's words, and equal rows give equal results. Texts of any length are taken; a single one is read whole.
Other columns are ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewarden.llm.common import Stored, map_text, table, utf8
from lakewarden.llm.text import U, mix, word_digests

WINDOW = 13
GRAM = 6
_R = U(0xD1342543DE82EF95)


@dataclass
class Segments:
    """Segments of a slab's texts: the text each is of, its anchor's digest, its own, and its first and last window in the text."""

    text: np.ndarray
    seed: np.ndarray
    body: np.ndarray
    first: np.ndarray
    last: np.ndarray


def _rolled(h: np.ndarray, width: int) -> np.ndarray:
    """A digest of each run of `width` of the digests h."""
    out = np.zeros(max(0, len(h) - width + 1), U)
    for j in range(width):
        out = out * _R + h[j : j + len(out)]
    return mix(out)


def segments(texts: list[bytes], window: int = WINDOW, gram: int = GRAM, key: bytes = b"", bodies: bool = True) -> Segments:
    h, begins = word_digests(texts, key)
    n, reach = h.shape[1], window - gram + 1
    if n < window:
        none = np.empty(0, np.int64)
        return Segments(none, none.astype(U), none.astype(U), none, none)
    g = _rolled(h[0], gram)
    best, where = g[: n - window + 1].copy(), np.arange(n - window + 1)
    for j in range(1, reach):
        x = g[j : j + len(best)]
        less = x < best
        best[less] = x[less]
        where[less] = np.flatnonzero(less) + j
    text = np.searchsorted(begins, np.arange(len(best)), side="right") - 1
    inside = np.flatnonzero(np.arange(len(best)) + window <= begins[text + 1])  # windows that don't cross into the next text
    where, text = where[inside], text[inside]
    # A run of windows with one anchor is one segment; anchors never move left.
    new = np.ones(len(inside), bool)
    new[1:] = (where[1:] != where[:-1]) | (text[1:] != text[:-1])
    first = inside[new]
    last = inside[np.append(np.flatnonzero(new)[1:] - 1, len(inside) - 1)] if len(inside) else first
    text, anchor = text[new], where[new]
    body = np.zeros(len(first), U)
    length = last - first + window
    for j in range(window + reach - 1 if bodies else 0):  # a segment has this many words at most
        here = j < length
        body[here] = body[here] * _R + h[1, first[here] + j]
    body = mix(body ^ (length * 64 + anchor - first).astype(U))
    return Segments(text, g[anchor], body, first - begins[text], last - begins[text])


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and key: rows of one doc_id with different texts are told apart by it."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("key", F.hash("text"))


def _seed_rows(rows: DataFrame, window: int, gram: int, key: bytes) -> DataFrame:
    """A row for each different anchor of each text of rows (doc_id, text, key)."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch | None:
        s = segments(utf8(b.column(1)), window, gram, key, False)
        if not len(s.text):
            return None
        order = np.lexsort((s.seed, s.text))
        text, seed = s.text[order], s.seed[order]
        new = np.ones(len(seed), bool)
        new[1:] = (text[1:] != text[:-1]) | (seed[1:] != seed[:-1])
        return pa.RecordBatch.from_arrays([pa.array(seed[new].view(np.int64))], names=["seed"])

    return map_text(rows, run, "seed long")


def _segment_rows(rows: DataFrame, window: int, gram: int, key: bytes) -> DataFrame:
    """A row for each segment of rows (doc_id, text, key); place is 64 times its first window and the number of windows after that."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch | None:
        s = segments(utf8(b.column(1)), window, gram, key)
        if not len(s.text):
            return None
        take = pa.array(s.text)
        cols = [pa.array(s.seed.view(np.int64)), pa.array(s.body.view(np.int64)), b.column(0).take(take), b.column(2).take(take), pa.array(s.first * 64 + s.last - s.first)]
        return pa.RecordBatch.from_arrays(cols, names=["seed", "body", "doc_id", "key", "place"])

    return map_text(rows, run, "seed long, body long, doc_id long, key int, place long")


def _window_rows(texts: DataFrame, window: int, key: bytes) -> DataFrame:
    """Each window of the segments of texts (doc_id, text, key, places), with its digest."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch | None:
        h, begins = word_digests(utf8(b.column(1)), key)
        if h.shape[1] < window:
            return None
        places = b.column(3)
        of, flat = np.repeat(np.arange(b.num_rows), np.diff(places.offsets.to_numpy())), places.flatten().to_numpy(zero_copy_only=False)
        first, many = flat // 64, flat % 64 + 1
        of, start = np.repeat(of, many), np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
        at, digests = begins[of] + start, []
        for i in (0, 1):
            x = np.zeros(len(at), U)
            for j in range(window):
                x = x * _R + h[i, at + j]
            digests.append(pa.array(mix(x).view(np.int64)))
        take = pa.array(of)
        return pa.RecordBatch.from_arrays([*digests, b.column(0).take(take), b.column(2).take(take), pa.array(start.astype(np.int32))], names=["w1", "w2", "doc_id", "key", "start"])

    return map_text(texts, run, "w1 long, w2 long, doc_id long, key int, start int")


def covered(spans: list[tuple[int, int]]) -> list[list[int]]:
    """Maximal runs of words of spans (first word, word after the last)."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _result(text: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, bytes]:
    words, runs = text.split(), covered(spans)
    kept, at = [], 0
    for a, b in runs:
        kept += words[at:a]
        at = b
    kept += words[at:]
    return len(words), len(words) - len(kept), b" ".join(kept)


def _finished(rows: DataFrame, schema: str, last: Callable[[bytes], bytes | str]) -> DataFrame:
    """rows (doc_id, text, spans) with the numbers of words and of removed ones, and `last` of the kept words joined by one space."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        done = [_result(t, [(x["a"], x["b"]) for x in s or ()]) for t, s in zip(utf8(b.column(1)), b.column(2).to_pylist())]
        cols = [pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.int64()), pa.array([last(d[2]) for d in done], pa.string())]
        return pa.RecordBatch.from_arrays([b.column(0), *cols], names=schema.replace(",", "").split()[::2])

    return map_text(rows, run, schema)


def removed_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, key and the spans of words (a, the first, to b, after the last) that repeat: one row for each document with any. Spans may overlap."""
    return _spans(_keyed(docs), window, gram)


def _spans(rows: DataFrame, window: int, gram: int) -> DataFrame:
    if not 0 <= window - gram < 64:
        raise ValueError("a window holds its gram and at most 63 words more")
    named, key = rows.where(F.col("doc_id").isNotNull()), os.urandom(16)
    first = F.floor(F.col("place") / 64).cast("int")
    with Stored(rows.sparkSession, "repeats") as keep:
        # Sides of joins that have a key once are written before, so that Spark can split what a hot key has on the other side.
        seeds = keep(_seed_rows(named, window, gram, key).groupBy("seed").agg(F.count("*").alias("texts")).where("texts > 1").select("seed"))
        shared = keep(_segment_rows(named, window, gram, key).join(seeds, "seed", "left_semi"))
        classes = keep(shared.groupBy("seed", "body").agg(F.min("doc_id").alias("least")))
        doubtful = keep(classes.groupBy("seed").agg(F.count("*").alias("bodies")).where("bodies > 1"))
        classes = keep(classes.join(doubtful, "seed", "left").select("seed", "body", "least", F.col("bodies").isNotNull().alias("doubtful")))
        met = keep(shared.join(classes, ["seed", "body"]).where("doc_id > least or doubtful").select("doc_id", "key", "place", (F.col("doc_id") > F.col("least")).alias("matched")))
        leading = met.where("not matched").groupBy("doc_id", "key").agg(F.collect_list("place").alias("places"))
        windows = keep(_window_rows(named.join(leading, ["doc_id", "key"]).select("doc_id", "text", "key", "places"), window, key))
        earliest = keep(windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("w1", "w2", "least"))
        late = windows.join(earliest, ["w1", "w2"]).where("doc_id > least").select("doc_id", "key", F.struct(F.col("start").alias("a"), (F.col("start") + window).alias("b")).alias("span"))
        whole = met.where("matched").select("doc_id", "key", F.struct(first.alias("a"), (first + (F.col("place") % 64).cast("int") + window).alias("b")).alias("span"))
        return keep(whole.unionByName(late).groupBy("doc_id", "key").agg(F.collect_list("span").alias("spans")), last=True)


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed and text: the words kept, joined by one space. One row for each row of docs."""
    return _joined(docs, window, gram, "doc_id long, n_words long, n_removed long, text string", bytes.decode)


def _joined(docs: DataFrame, window: int, gram: int, schema: str, last: Callable[[bytes], bytes | str]) -> DataFrame:
    rows = _keyed(docs)
    spans = _spans(rows, window, gram)
    return _finished(rows.join(spans, ["doc_id", "key"], "left").select("doc_id", "text", "spans"), schema, last)


def op11_seed_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    return _joined(table(spark, sf_dir, "documents").select("doc_id", "text"), WINDOW, GRAM, schema, lambda kept: sha256(kept).hexdigest())


OP11_SQL = r"""
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t\n\r\x0b\x0c]+') AS words FROM documents),
windows AS (
  SELECT r, doc_id, i, array_to_string(words[i:i + 12], ' ') AS seq
  FROM (SELECT r, doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM docs WHERE doc_id IS NOT NULL)),
firsts AS (SELECT seq, min(doc_id) AS least FROM windows GROUP BY seq HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 13)) AS p FROM windows JOIN firsts USING (seq) WHERE doc_id > least),
lost AS (SELECT r, count(*) AS n FROM gone GROUP BY r),
kept AS (
  SELECT r, string_agg(word, ' ' ORDER BY p) AS text
  FROM (SELECT r, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM docs) ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, len(words) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM docs LEFT JOIN lost USING (r) LEFT JOIN kept USING (r)
"""
