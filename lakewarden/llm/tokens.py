"""Token ids of texts with a public vocabulary, and a bit-plane file format for them.

File (one per shard), little-endian: magic `LWP1`, then u8 plane kind (1 byte planes,
2 bit planes), u32 ids a block, u64 ids, u64 documents; the documents' int64 ids and
u32 lengths, each zstd-compressed behind a u32 size; the blocks' planes, each
zstd-compressed; last the chunk index: for each plane of each block its u64 offset and u32
size, and at the very end the index's own u64 offset. A block's ids are transposed, so
that a plane holds one byte (or bit) position of all its ids; high planes are nearly
constant and shrink to nothing.

A null or empty text is its end id alone. Null ids come first and are held as the least long; equal ids are in order of their texts' place in the table. A text of any length is
encoded whole, and a document's ids are never cut, so that a file may be longer than SHARD_IDS. An empty table makes no file, and reading gives no rows; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import gc
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewarden.llm.common import partition_sums, release, scratch, slabs, table

VOCABULARY = "byte_bpe_50k.json"
BLOCK_IDS = 1 << 16
SHARD_IDS = 1 << 20
_MAGIC = b"LWP1"
_HEAD = struct.Struct("<4sBIQQ")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: ASCII marks but the apostrophe, which begins tokens such as 's; they are written as they are.
_MARKS = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'
#: Letters below it are letters in every version of Unicode that a library may follow.
_LATIN_END = "\u0250"


class _Written(dict):
    """How the vocabulary writes a character, by its code point: the library is asked once for each."""

    def __missing__(self, code: int) -> str:
        from tokenizers import pre_tokenizers

        ((written, _),) = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(code))
        self[code] = written
        return written


class Encoder:
    """Ids of whole texts (as little-endian u32 bytes), remembering words.

    The byte-level pre-tokenizer always ends a token before a space or line break that
    stands between two other characters, so such pieces are encoded once each and joined;
    a text in which white space adjoins white space is encoded whole. It also ends a token between
    Latin letters and marks that end a piece, so a new piece of Latin letters, with or without such
    marks, is given to the library's model as it is, letters and marks apart. Other new pieces are
    encoded many at a time as one text, and parted again where a token begins with the
    space (or is the line break) that led each. Two generations of at most `remember` pieces are held.
    """

    def __init__(self, path: str, remember: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.written, self.marks = self.tokenizer.model, _Written(), {}
        vocabulary = self.tokenizer.get_vocab()
        # How the vocabulary writes a space and a line break.
        self.spaced = np.zeros(max(vocabulary.values()) + 1, bool)
        self.spaced[[i for t, i in vocabulary.items() if t[0] == "\u0120"]] = True
        self.line = vocabulary["\u010a"]
        self.line_bytes = array("I", [self.line]).tobytes()
        self.remember, self.young, self.old = remember, {}, {}
        self.heads: dict[str, bytes | None] = {}

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _run(self, written: str) -> bytes:
        """Ids of a run that the pre-tokenizer doesn't cut, as the vocabulary writes it."""
        return array("I", [t.id for t in self.model.tokenize(written)]).tobytes()

    def _learn(self, cache: dict, pieces: list[str], spaced: bool) -> None:
        """Pieces without white space at their ends, as they are encoded after a space, or at the start of a line."""
        clean, lead, old = [], "\u0120" if spaced else "", self.old if spaced else {}
        if len(self.marks) > 10_000:
            self.marks = {}
        for p in pieces:
            letters = p if p.isalpha() else p.rstrip(_MARKS)
            if letters.isalpha() and (letters.isascii() or max(letters) < _LATIN_END):
                ids = cache.get(letters) or old.get(letters) or self._run(lead + letters.translate(self.written))
                cache[letters] = ids
                if letters != p:
                    marks = p[len(letters) :]
                    if marks not in self.marks:
                        self.marks[marks] = self._run(marks)
                    cache[p] = ids + self.marks[marks]
            elif p and not p[0].isspace() and not p[-1].isspace():
                clean.append(p)
            else:
                cache[p] = None
        for k in range(0, len(clean), 20_000):
            part = clean[k : k + 20_000]
            text = " " + " ".join(part) if spaced else "\n" + "\n".join(part)
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            starts = np.flatnonzero(self.spaced[ids] if spaced else ids == self.line)
            if len(starts) != len(part):  # a piece holds white space of another kind; take them one by one
                for p in part:
                    cache[p] = self.whole(" " + p if spaced else p)
                continue
            raw, ends = ids.tobytes(), [*(4 * starts[1:]).tolist(), 4 * len(ids)]
            for p, a, b in zip(part, (4 * starts + (0 if spaced else 4)).tolist(), ends):
                cache[p] = raw[a:b]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text. Millions of strings and no cycles are made here, so the cycle collector rests meanwhile."""
        gc.disable()
        try:
            return self._encode(texts)
        finally:
            gc.enable()

    def _encode(self, texts: list[str]) -> list[bytes]:
        split = [t.replace("\n", " \n").split(" ") for t in texts]
        if len(self.young) > self.remember:
            self.young, self.old = {}, self.young
        if len(self.heads) > self.remember // 4:
            self.heads = {}
        young, old, heads = self.young, self.old, self.heads
        new = set()
        for p in split:
            new.update(p[1:])
        new.difference_update(young)
        known = new & old.keys() if old else set()
        for p in known:
            young[p] = old[p]
        new -= known
        lines = [p for p in new if p[:1] == "\n"]
        first = {p[1:] for p in lines} | {p[0] for p in split if p[0][:1] != "\n"}
        self._learn(heads, list(first.difference(heads)), spaced=False)
        self._learn(young, [p for p in new if p[:1] != "\n"], spaced=True)
        for p in lines:
            body = heads[p[1:]]
            young[p] = None if body is None else self.line_bytes + body
        heads |= {p[0]: None for p in split if p[0][:1] == "\n"}
        out = []
        for text, p in zip(texts, split):
            try:
                out.append(heads[p[0]] + b"".join(map(young.__getitem__, p[1:])))
            except TypeError:  # a piece, None, that can't be encoded alone
                out.append(self.whole(text))
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str, remember: int = 400_000) -> Encoder:
    """One for each worker process and vocabulary; it remembers as much as was asked for last."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    _encoders[path].remember = remember
    return _encoders[path]


def forget(path: str) -> None:
    """Drops the pieces that the worker's encoder remembers, at a task's end: other stages' tasks need the memory."""
    if path in _encoders:
        _encoders[path].young, _encoders[path].old, _encoders[path].heads = {}, {}, {}
    release()


def _planes(block: np.ndarray, bits: bool) -> np.ndarray:
    raw = block.astype("<u4").view(np.uint8).reshape(-1, 4)
    return np.packbits(np.unpackbits(raw, axis=1).T, axis=1) if bits else np.ascontiguousarray(raw.T)


def _unplanes(planes: list[bytes], n: int, bits: bool) -> np.ndarray:
    raw = np.frombuffer(b"".join(planes), np.uint8).reshape(len(planes), -1)
    if bits:
        raw = np.packbits(np.unpackbits(raw, axis=1)[:, :n].T, axis=1)
        return np.ascontiguousarray(raw).view("<u4").reshape(-1)
    return np.ascontiguousarray(raw.T).view("<u4").reshape(-1)


def to_file(doc_ids: list[int], lengths: list[int], ids: bytes, bits: bool = False, block: int = BLOCK_IDS) -> bytes:
    """A file of whole documents' ids."""
    z = zstandard.ZstdCompressor(level=1)
    a = np.frombuffer(ids, "<u4")
    parts = [_HEAD.pack(_MAGIC, 2 if bits else 1, block, len(a), len(doc_ids))]
    for column in (np.array(doc_ids, "<i8"), np.array(lengths, "<u4")):
        packed = z.compress(column.tobytes())
        parts += [struct.pack("<I", len(packed)), packed]
    at, index = sum(map(len, parts)), []
    for k in range(0, len(a), block):
        for plane in _planes(a[k : k + block], bits):
            packed = z.compress(plane.tobytes())
            index.append(struct.pack("<QI", at, len(packed)))
            parts.append(packed)
            at += len(packed)
    return b"".join([*parts, *index, struct.pack("<Q", at)])


def from_file(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc ids, lengths and all ids of a file."""
    z = zstandard.ZstdDecompressor()
    magic, kind, block, n, docs = _HEAD.unpack_from(data)
    if magic != _MAGIC:
        raise ValueError("not a token file")
    at, columns = _HEAD.size, []
    for kind_of in ("<i8", "<u4"):
        (size,) = struct.unpack_from("<I", data, at)
        columns.append(np.frombuffer(z.decompress(data[at + 4 : at + 4 + size]), kind_of))
        at += 4 + size
    (index,) = struct.unpack_from("<Q", data, len(data) - 8)
    width, out = 32 if kind == 2 else 4, []
    for b in range(-(-n // block)):
        planes = []
        for p in range(width):
            where, size = struct.unpack_from("<QI", data, index + 12 * (b * width + p))
            planes.append(z.decompress(data[where : where + size]))
        out.append(_unplanes(planes, min(block, n - b * block), kind == 2))
    return columns[0], columns[1], np.concatenate(out) if out else np.empty(0, "<u4")


def write_token_files(docs: DataFrame, path: str, end_id: int = 2, vocabulary: str | None = None, bits: bool = False) -> None:
    """Writes documents in ascending doc_id order as a table of token files at `path`.

    Rows: part (range of doc_ids), before (ids of the part before this file) and the file.
    Documents are dealt by range of doc_id; each task streams its range, so that memory
    holds one shard of about SHARD_IDS ids and never less than one document. Null doc_ids
    come first, and equal doc_ids are ordered by a hash of their texts.
    """
    vocab = vocabulary or vocabulary_path()
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dealt = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    end = array("I", [end_id]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, held = TaskContext.get().partitionId(), 0, ([], [], [])

        def shard(count: int) -> pa.RecordBatch:
            data = to_file(held[0], held[1], b"".join(held[2]), bits)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([before], pa.int64()), pa.array([count], pa.int64()), pa.array([data], pa.binary())], names=["part", "before", "n_ids", "file"])

        count = 0
        for b in slabs(batches, chars=2_000_000):
            encoded = encoder(vocab, 450_000).encode([t or "" for t in b.column(1).to_pylist()])
            for doc, ids in zip(b.column(0).to_pylist(), encoded):
                held[0].append(_NO_ID if doc is None else doc)
                held[1].append(len(ids) // 4 + 1)
                held[2].append(ids + end)
                count += held[1][-1]
                if count >= SHARD_IDS:
                    yield shard(count)
                    before, count, held = before + count, 0, ([], [], [])
        if held[0]:
            yield shard(count)
        forget(vocab)

    dealt.mapInArrow(run, "part int, before long, n_ids long, file binary").write.mode("overwrite").option("compression", "none").parquet(path)


#: Stands for a null doc_id in files.
_NO_ID = -(1 << 63)


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids as an array, if asked for) of each document in the files at `path`."""
    files = spark.read.parquet(path)
    starts = partition_sums(files, "part", "n_ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, before, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                begin = starts[part] + before
                doc_ids, lengths, ids = from_file(data.as_buffer().to_pybytes())
                ends = np.cumsum(lengths.astype(np.int64))
                first = ends - lengths
                raw = ids.tobytes()
                crc = [zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(first.tolist(), ends.tolist())]
                columns = [pa.array([None if d == _NO_ID else d for d in doc_ids.tolist()], pa.int64()), pa.array(begin + first), pa.array(lengths.astype(np.int64)), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.array([ids[i:j].astype(np.int32) for i, j in zip(first.tolist(), ends.tolist())], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    return files.select("part", "before", "file").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def op8_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null text is empty (one end id)."""
    path = scratch(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path)
    return read_token_files(spark, path)
