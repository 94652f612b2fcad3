"""Matroska files in binary columns: a small muxer for 8-bit PCM, and a parser to packet tables.

The parser reads variable-length EBML elements (also of unknown size, which end where an element begins that can't be
a part of them), clusters, simple blocks and block groups with no, Xiph, EBML or fixed-size lacing, and cues. Media are
values of a table in the shared folder, so that any executor can read what another wrote.

Damaged files: reading ends where bytes aren't an element, a part that runs over its parent's end is cut off there, and blocks
that can't be read are left out; what was read stays, and `parse` says that the file is damaged. Null and empty texts are one
frame of spaces; null and repeated doc_ids keep a row each; a very long text is one medium; other columns are left out.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewarden.llm.common import map_text, scratch, slabs, table, utf8

# Element ids of the Matroska specification (RFC 9559).
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
DOC_TYPE, TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x4282, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID = 0xAE, 0xD7, 0x73C5, 0x83, 0x86
AUDIO, SAMPLING, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0xE7, 0xA3, 0xA0, 0xA1
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
SEEK_HEAD, CHAPTERS, TAGS, ATTACHMENTS = 0x114D9B74, 0x1043A770, 0x1254C367, 0x1941A469
_LEVEL = {EBML: 0, SEGMENT: 0} | dict.fromkeys((INFO, TRACKS, CLUSTER, CUES, SEEK_HEAD, CHAPTERS, TAGS, ATTACHMENTS), 1)
_MASTERS = {SEGMENT, INFO, TRACKS, CLUSTER, CUES, TRACK_ENTRY, AUDIO, BLOCK_GROUP, CUE_POINT, CUE_POSITIONS}

RATE, FRAME = 8000, 192
FRAMES_A_BLOCK, BLOCKS_A_CLUSTER = 16, 12
FRAME_MS = FRAME * 1000 // RATE


def _id(x: int) -> bytes:
    return x.to_bytes((x.bit_length() + 7) // 8, "big")


def _size(n: int) -> bytes:
    for width in range(1, 9):
        if n < (1 << 7 * width) - 1:
            return (n | 1 << 7 * width).to_bytes(width, "big")
    raise ValueError("too large")


def _element(x: int, data: bytes) -> bytes:
    return _id(x) + _size(len(data)) + data


def _uint(x: int, n: int) -> bytes:
    return _element(x, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def mux(payload: bytes) -> bytes:
    """A file with one track of unsigned 8-bit samples; payload is a positive multiple of FRAME bytes."""
    head = _element(EBML, _uint(0x4286, 1) + _uint(0x42F7, 1) + _uint(0x42F2, 4) + _uint(0x42F3, 8) + _element(DOC_TYPE, b"matroska") + _uint(0x4287, 4) + _uint(0x4285, 2))
    frames = len(payload) // FRAME
    info = _element(INFO, _uint(TIMESTAMP_SCALE, 1_000_000) + _element(DURATION, struct.pack(">d", frames * FRAME_MS)) + _element(MUXING_APP, b"lakewarden") + _element(WRITING_APP, b"lakewarden"))
    audio = _element(AUDIO, _element(SAMPLING, struct.pack(">d", RATE)) + _uint(CHANNELS, 1) + _uint(BIT_DEPTH, 8))
    tracks = _element(TRACKS, _element(TRACK_ENTRY, _uint(TRACK_NUMBER, 1) + _uint(TRACK_UID, 1) + _uint(TRACK_TYPE, 2) + _element(CODEC_ID, b"A_PCM/INT/LIT") + audio))
    parts, cues, at = [info, tracks], [], len(info) + len(tracks)
    for c in range(0, frames, FRAMES_A_BLOCK * BLOCKS_A_CLUSTER):
        blocks = [_uint(TIMESTAMP, c * FRAME_MS)]
        for b in range(c, min(frames, c + FRAMES_A_BLOCK * BLOCKS_A_CLUSTER), FRAMES_A_BLOCK):
            n = min(FRAMES_A_BLOCK, frames - b)
            lacing = bytes([0x84, n - 1]) if n > 1 else b"\x80"
            blocks.append(_element(SIMPLE_BLOCK, b"\x81" + struct.pack(">h", (b - c) * FRAME_MS) + lacing + payload[b * FRAME : (b + n) * FRAME]))
        cues.append(_element(CUE_POINT, _uint(CUE_TIME, c * FRAME_MS) + _element(CUE_POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER, at))))
        parts.append(_element(CLUSTER, b"".join(blocks)))
        at += len(parts[-1])
    return head + _element(SEGMENT, b"".join([*parts, _element(CUES, b"".join(cues))]))


def _number(data: bytes, at: int, keep_mark: bool = False) -> tuple[int, int]:
    """A variable-length number and where it ends; -1 if all its bits are 1 (unknown). ValueError where there is none."""
    width = 9 - data[at].bit_length() if at < len(data) else 9
    if width > 8 or at + width > len(data):
        raise ValueError(f"no number at byte {at}")
    n = int.from_bytes(data[at : at + width], "big")
    if not keep_mark:
        n &= (1 << 7 * width) - 1
        if n == (1 << 7 * width) - 1:
            n = -1
    return n, at + width


def elements(data: bytes) -> Iterator[tuple[int, int, int, int]]:
    """(depth, id, start, end) of the data of each element, masters before their parts; an unknown end is that of the parent.

    A part that a damaged size lets run over its parent's end is cut off there. ValueError where bytes aren't an element."""
    # Open masters: end, id and whether the size is unknown.
    at, open_ = 0, []
    while at < len(data):
        while open_ and open_[-1][0] <= at:
            open_.pop()
        kind, at = _number(data, at, keep_mark=True)
        size, at = _number(data, at)
        level = _LEVEL.get(kind, 2)
        while open_ and open_[-1][2] and (kind == open_[-1][1] or level <= _LEVEL.get(open_[-1][1], 2) < 2 or level < 2 <= _LEVEL.get(open_[-1][1], 2)):
            open_.pop()
        end = open_[-1][0] if open_ else len(data)
        stop = end if size < 0 else min(end, at + size)
        yield len(open_), kind, at, stop
        if kind in _MASTERS:
            open_.append((stop, kind, size < 0))
        else:
            at = stop


def _laces(data: bytes, at: int, end: int, lacing: int) -> tuple[list[int], int]:
    """Sizes of a block's frames, and where the first begins. ValueError if they don't fit the block."""
    if not lacing:
        return [end - at], at
    n, at, sizes = data[at] + 1, at + 1, []
    if lacing == 2:
        return [(end - at) // n] * n, at
    for i in range(n - 1):
        if lacing == 1:
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
        else:
            begin = at
            size, at = _number(data, at)
            sizes.append(size if not i else sizes[-1] + size - ((1 << 7 * (at - begin) - 1) - 1))
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError(f"frames don't fit the block at byte {at}")
    return sizes, at


def _block(data: bytes, a: int, b: int) -> tuple[int, int, int, list[int], int]:
    """Track, relative timestamp, flags, sizes of the frames and where the first begins."""
    number, at = _number(data, a)
    if at + 3 > b:
        raise ValueError(f"no block at byte {a}")
    (relative,) = struct.unpack_from(">h", data, at)
    flags = data[at + 2]
    return number, relative, flags, *_laces(data, at + 3, b, flags >> 1 & 3)


def parse(data: bytes) -> dict:
    """Tracks, packets (track, ms, offset, size, cluster, key), cues (ms, track, offset of the cluster's element in the file), and whether the file is damaged."""
    state: dict = {}
    try:
        _read(data, state)
    except (ValueError, IndexError, ArithmeticError, struct.error):
        state["damaged"] = True
    return state


def _read(data: bytes, state: dict) -> None:
    tracks, packets, cues, cluster, base, scale, segment = {}, [], [], -1, 0, 1_000_000, 0
    track, cue = {}, {}
    state |= {"tracks": tracks, "packets": packets, "cues": cues, "clusters": 0, "damaged": False}
    for _, kind, a, b in elements(data):
        if kind in (SIMPLE_BLOCK, BLOCK):
            try:
                number, relative, flags, sizes, at = _block(data, a, b)
            except (ValueError, IndexError, struct.error):
                state["damaged"] = True
                continue
            step = tracks.get(number, {}).get("frame_ms")
            ms = (base + relative) * scale / 1e6
            for size in sizes:
                packets.append((number, ms, at, size, cluster, bool(flags & 0x80)))
                at += size
                if step:  # laced frames of PCM follow one another
                    ms += size * step
        elif kind == SEGMENT:
            segment = a
        elif kind == CLUSTER:
            cluster += 1
            state["clusters"] = cluster + 1
        elif kind == TIMESTAMP:
            base = int.from_bytes(data[a:b], "big")
        elif kind == TIMESTAMP_SCALE:
            scale = int.from_bytes(data[a:b], "big")
        elif kind == TRACK_ENTRY:
            track = {}
        elif kind in (TRACK_NUMBER, TRACK_TYPE, CHANNELS, BIT_DEPTH):
            track[{TRACK_NUMBER: "number", TRACK_TYPE: "type", CHANNELS: "channels", BIT_DEPTH: "bits"}[kind]] = int.from_bytes(data[a:b], "big")
            if kind == TRACK_NUMBER:
                tracks[track["number"]] = track
        elif kind == CODEC_ID:
            track["codec"] = data[a:b].decode("ascii", "replace")
        elif kind == SAMPLING:
            track["rate"] = struct.unpack(">d" if b - a == 8 else ">f", data[a:b])[0]
        if kind in (SAMPLING, CHANNELS, BIT_DEPTH) and track.get("codec", "").startswith("A_PCM") and {"rate", "channels", "bits"} <= track.keys():
            bits = track["rate"] * track["channels"] * track["bits"]
            track["frame_ms"] = 8000 / bits if 0 < bits < float("inf") else None
        if kind == CUE_POINT:
            cue = {}
        elif kind == CUE_TIME:
            cue["ms"] = int.from_bytes(data[a:b], "big") * scale // 1_000_000
        elif kind == CUE_TRACK:
            cue["track"] = int.from_bytes(data[a:b], "big")
        elif kind == CUE_CLUSTER:
            cues.append((cue.get("ms"), cue.get("track"), segment + int.from_bytes(data[a:b], "big")))


def payload_of(data: bytes, packets: list[tuple], track: int = 1) -> bytes:
    return b"".join(data[p[2] : p[2] + p[3]] for p in packets if p[0] == track)


def write_media(docs: DataFrame, path: str) -> None:
    """doc_id, n_bytes and media of each document, as a table at `path`. Null text is empty, which is stored as one frame of spaces."""

    def run(slab: pa.RecordBatch) -> pa.RecordBatch:
        texts = utf8(slab.column(1))
        media = [mux(t.ljust(max(FRAME, -(-len(t) // FRAME) * FRAME), b" ")) for t in texts]
        return pa.RecordBatch.from_arrays([slab.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    map_text(rows, run, "doc_id long, n_bytes long, media binary").write.mode("overwrite").option("compression", "zstd").parquet(path)


def packet_table(media: DataFrame) -> DataFrame:
    """doc_id, packet (number), track, ms, offset, size, cluster, key for each packet of each medium; null media have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slabs(batches, "media"):
            rows = [(d, i, *p) for d, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if m for i, p in enumerate(parse(m)["packets"])]
            kinds = [("doc_id", pa.int64()), ("packet", pa.int32()), ("track", pa.int32()), ("ms", pa.float64()), ("offset", pa.int64()), ("size", pa.int64()), ("cluster", pa.int32()), ("key", pa.bool_())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows) if rows else [[]] * 8, kinds)], names=[n for n, _ in kinds])

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, packet int, track int, ms double, offset long, size long, cluster int, key boolean")


def media_features(media: DataFrame) -> DataFrame:
    """Digests and features of stored media, all taken from the parsed packets."""
    kinds = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]

    def one(doc: int, n: int, m: bytes) -> tuple:
        at = parse(m)
        payload = payload_of(m, at["packets"])
        x = np.frombuffer(payload, np.uint8).astype(np.float64) - 128
        crossings = int(np.count_nonzero(np.signbit(x[1:]) != np.signbit(x[:-1])))
        last = at["packets"][-1]
        feature = f"packets={len(at['packets'])};clusters={at['clusters']};cues={len(at['cues'])};end_ms={last[1] + FRAME_MS:.0f};mean={x.mean():.6f};rms={np.sqrt((x * x).mean()):.6f};crossings={crossings}"
        return doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(m), hashlib.sha256(m).hexdigest(), feature

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slabs(batches, "media"):
            rows = [one(*r) for r in zip(*(c.to_pylist() for c in b.columns))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows), kinds)], names=[n for n, _ in kinds])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op7_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "media")
    write_media(table(spark, sf_dir, "documents"), path)
    return media_features(spark.read.parquet(path))
