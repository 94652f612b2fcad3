"""Packing token ids into windows by minimum bin slack.

Documents longer than a window are cut into full windows and a remainder. A task pools
remainders, GROUP_IDS ids at a time. For each window the largest pooled length is
set, and a subset-sum bitset over the other lengths (with their counts) finds the fill
closest to capacity; the counts of each length are read back through the bitsets kept for
each step. A pattern without slack is used as often as the counts allow. Where slack is left,
a pooled piece longer than it is cut to fill it, and the rest of the piece goes back to the pool. So
a pool ends with less than one window, which joins the next pool, or at the task's end is a tail.

Tails travel with their ids: groups of them, of about GROUP_IDS ids each, are packed in the same way, and
only the last window of each group stays short.

Null text is empty (one end id); null and repeated doc_ids are kept as they are, a row each. Very long texts
are cut as any others. An empty table gives no rows. Other columns are left out, whatever their names.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewarden.llm.common import scratch, slabs, table
from lakewarden.llm.tokens import encoder, forget, vocabulary_path

WINDOW = 2048
#: Pieces of text that a worker remembers the ids of.
REMEMBER = 200_000
#: Ids whose remainders are packed at a time, and ids of the tails of one group.
GROUP_IDS = 4_000_000


def fill(counts: dict[int, int], room: int, lengths: list[int] | None = None) -> tuple[dict[int, int], int]:
    """The multiset of available lengths whose sum is closest to room from below, and what is left of room.

    `lengths`: counts' keys in order, if at hand. Longer ones are tried first, and the search ends at an exact fit."""
    lengths = sorted(counts) if lengths is None else lengths
    bits, mask, layers = 1, (1 << (room + 1)) - 1, []
    for i in range(bisect_right(lengths, room) - 1, -1, -1):
        length = lengths[i]
        left, step = min(counts.get(length, 0), room // length), 1
        if not left:
            continue
        layers.append((length, bits))
        while left:
            step = min(step, left)
            bits |= (bits << (length * step)) & mask
            left -= step
            step *= 2
        if bits >> room & 1:
            break
    at = bits.bit_length() - 1
    slack, chosen = room - at, {}
    for length, before in reversed(layers):
        k = 0
        while not before >> at & 1:
            at -= length
            k += 1
        if k:
            chosen[length] = k
    return chosen, slack


class Packer:
    """Pieces in, placed pieces out. A piece is (document, first id's place in it, ids as u32 bytes, ids of the document)."""

    def __init__(self, window: int = WINDOW, keep: bool = True):
        """keep: placed pieces carry their ids."""
        self.window, self.keep, self.next, self.pool = window, keep, 0, defaultdict(list)
        self.ids = 0  # in the pool

    def _placed(self, piece: tuple, at: int) -> tuple:
        doc, start, ids, n = piece
        return doc, start, len(ids) // 4, zlib.crc32(ids), n, self.next, at, ids if self.keep else None

    def add(self, piece: tuple) -> Iterator[tuple]:
        length = len(piece[2]) // 4
        if length == self.window:
            yield self._placed(piece, 0)
            self.next += 1
        else:
            self.pool[length].append(piece)
            self.ids += length

    def pack(self) -> Iterator[tuple]:
        """Places all of the pool but less than one window."""
        pool, lengths = self.pool, sorted(k for k, v in self.pool.items() if v)
        counts = {k: len(pool[k]) for k in lengths}

        def put(length: int, piece: tuple) -> None:
            if not counts.get(length):
                counts[length] = 0
                i = bisect_right(lengths, length)
                if not i or lengths[i - 1] != length:
                    lengths.insert(i, length)
            counts[length] += 1
            pool[length].append(piece)

        def take(length: int) -> tuple:
            counts[length] -= 1
            return pool[length].pop()

        while self.ids >= self.window:
            while not counts[lengths[-1]]:
                lengths.pop()
            largest = lengths[-1]
            counts[largest] -= 1
            chosen, slack = fill(counts, self.window - largest, lengths)
            counts[largest] += 1
            chosen[largest] = chosen.get(largest, 0) + 1
            for _ in range(1 if slack else min(counts[x] // k for x, k in chosen.items())):
                at = 0
                for length in sorted(chosen, reverse=True):
                    for _ in range(chosen[length]):
                        yield self._placed(take(length), at)
                        at += length
                if slack:  # all that is left is longer than the slack: the least is cut
                    i = bisect_right(lengths, slack)
                    while not counts[lengths[i]]:
                        i += 1
                    doc, start, ids, n = take(lengths[i])
                    yield self._placed((doc, start, ids[: 4 * slack], n), at)
                    put(len(ids) // 4 - slack, (doc, start + slack, ids[4 * slack :], n))
                self.next += 1
                self.ids -= self.window
        self.pool = defaultdict(list, {k: v for k, v in pool.items() if v})

    def rest(self) -> Iterator[tuple]:
        """The pool's pieces, one after the other."""
        at = 0
        for length in sorted(self.pool, reverse=True):
            for piece in self.pool[length]:
                yield self._placed(piece, at)
                at += length


_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Added to the numbers of sequences that are packed from tails.
_TAILS = 1 << 62


def pack(docs: DataFrame, end_id: int = 1, window: int = WINDOW, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row for each piece of each document's ids (text, then end_id) and its place in a sequence of `window` ids.

    Each task packs the rows of its own split, and numbers its sequences from its partition's number times
    2^40. What it wrote is kept as a table, so that sequences aren't packed anew; of it, only tails (less than a
    window a task) are shuffled. With with_ids the piece's ids come as little-endian u32 bytes.
    """
    spark, vocab = docs.sparkSession, vocabulary or vocabulary_path()
    end = array("I", [end_id]).tobytes()
    names = [*(x.split()[0] for x in _SCHEMA.split(", ")), "ids", "tail"]
    kinds = [*[pa.int64()] * 7, pa.binary(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, packer, out = TaskContext.get().partitionId() << 40, Packer(window, with_ids), []

        def batch(tail: bool) -> pa.RecordBatch:
            columns = list(zip(*[(*p[:5], base + p[5], p[6], p[7], tail) for p in out]))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        for b in slabs(batches, chars=2_000_000):
            for doc, ids in zip(b.column(0).to_pylist(), encoder(vocab, REMEMBER).encode([t or "" for t in b.column(1).to_pylist()])):
                ids += end
                n = len(ids) // 4
                for at in range(0, n, window):
                    out += packer.add((doc, at, ids[4 * at : 4 * (at + window)], n))
            if packer.ids >= GROUP_IDS:
                out += packer.pack()
            if len(out) > 5000:
                yield batch(False)
        out += packer.pack()
        if out:
            yield batch(False)
        packer.keep = True
        out += packer.rest()
        if out:
            yield batch(True)
        forget(vocab)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    path = scratch(spark, "pieces")
    rows.mapInArrow(run, _SCHEMA + ", ids binary, tail boolean").write.parquet(path)
    pieces = spark.read.parquet(path)
    tails = pieces.where("tail")
    held = tails.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    shown = [*names[:7], *["ids"] * with_ids]
    # A task's tail stays together: its sequence's number says which task's it is.
    grouped = tails.withColumn("group", F.pmod(F.xxhash64("sequence_id"), F.lit(-(-held // GROUP_IDS) or 1)).cast("long"))

    def join(group: pd.DataFrame) -> pd.DataFrame:
        packer, base = Packer(window), _TAILS | int(group["group"].iloc[0]) << 32
        group = group.sort_values(["sequence_id", "offset"])
        out = []
        for doc, start, ids, n in zip(group["doc_id"].astype("Int64"), group["start"], group["ids"], group["doc_tokens"]):
            out += packer.add((None if doc is pd.NA else doc, start, ids, n))
        out += packer.pack()
        out += packer.rest()
        placed = pd.DataFrame([(*p[:5], base + p[5], *p[6:]) for p in out], columns=names[:8])
        return placed.astype({"doc_id": "Int64"})[shown]

    joined = grouped.groupBy("group").applyInPandas(join, _SCHEMA + ", ids binary" * with_ids)
    return pieces.where("not tail").select(*shown).unionByName(joined)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
