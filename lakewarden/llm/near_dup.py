"""Near-duplicate documents by SetSketch registers.

A document's set is its distinct k-word shingles (lower-cased A-Z, words are runs of
non-white-space). Steps, each a Spark job over all documents:

1. Every document becomes its set's size, a 128-bit digest of the set (of two independent keyed hashes of each shingle), and `registers`
   SetSketch registers: exponentially spaced truncated minima, in which an element's j-th
   value lies in the j-th quantile interval of the exponential distribution, so that most
   elements need one value only. Sketches of two parts merge by the larger register.
2. Documents with equal sets form one class, kept once (its smallest id) from here on.
3. Bands of register values put classes into buckets. Buckets of one are left.
4. In each bucket all members meet one pivot; a joint likelihood estimate of the
   similarity from both sketches drops pairs far below the threshold, the rest are
   verified on full sets. Verified links give connected components.
5. In buckets whose members are still in several components, every member outside the
   bucket's largest component meets the members of other components, so many that ask by so many that
   answer in a block: first the likeliest of each component and block, and in a second round all that
   are likely. Again estimate, then verification. Pairs within a component can no longer
   change the result and are not made.

Verification compares the shingles' words themselves, in groups of texts bounded by number and bytes.
Nothing is capped: a bucket of any size is cut into blocks. The chance that a pair at
similarity 0.8 shares no band is (1 - 0.8^6)^42 = 3e-6.

Null or empty texts and texts of white space have an empty set and link with nothing.
A null doc_id is left out of classes (kept null component, kept false) as it can't be named.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewarden.llm import text as tx
from lakewarden.llm.common import cut, map_text, table, utf8
from lakewarden.llm.graphs import components

REGISTERS, ROWS, BANDS = 256, 6, 42
BASE = 1.001
#: Estimates of similarity have a standard error of about 0.025; pairs 4 of these below the threshold are dropped.
MARGIN = 0.1
#: Texts, and members of a bucket by their sketches, that one group holds: of those that ask and of those that answer each.
BLOCK, MEET = 256, 512
#: Bytes of text that one group holds, if no single pair of texts is longer.
BLOCK_BYTES = 8_000_000
#: Characters of pairs' texts whose words are numbered at a time.
CHECK_CHARS = 500_000
U = np.uint64


def sketch(s: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """The m registers (uint16) of a set of mixed 64-bit hashes; registers of an empty set are 0."""
    n = len(s)
    least = np.full(m, np.inf)
    if not n:
        return np.zeros(m, np.uint16)
    seed = tx.mix(s ^ U(0xA0761D6478BD642F))
    place = (seed & U(m - 1)).astype(np.int64)
    step = ((seed >> U(20)) | U(1)).astype(np.int64) & (m - 1)
    q, done = min(1.0, (np.log(m) + 4) / n), 0.0
    while True:
        # All values whose quantile lies in [done, q); stratum j covers [j/m, (j+1)/m).
        j = np.arange(int(done * m), int(np.ceil(q * m)))
        u = (j[:, None] + tx.uniform(tx.mix(s + ((j + 1).astype(U) * U(0x9E3779B97F4A7C15))[:, None]))) / m
        at, of = np.nonzero((u >= done) & (u < q))
        np.minimum.at(least, (place[of] + j[at] * step[of]) & (m - 1), u[at, of])
        if q >= 1 or np.isfinite(least).all():
            break
        done, q = q, min(1.0, q * 2)
    x = -np.log1p(-least)
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)) + 8000, 1, 65535).astype(np.uint16)


def digest(s: np.ndarray, t: np.ndarray) -> bytes:
    """128 bits that depend on the set only, given as two hashes of each element."""
    with np.errstate(over="ignore"):
        return np.array([tx.mix(s ^ U(0x2545F4914F6CDD1D)).sum(dtype=U), tx.mix(t ^ U(0x9FB21C651E98DF25)).sum(dtype=U)], U).tobytes()


def similarity(ku: np.ndarray, kv: np.ndarray, nu: np.ndarray, nv: np.ndarray) -> np.ndarray:
    """Most likely Jaccard similarity of pairs of sketches (rows) with known set sizes."""
    above, below = (ku > kv).sum(1), (ku < kv).sum(1)
    same = ku.shape[1] - above - below
    u = nu / (nu + nv)
    v = 1 - u
    lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)
    c = (BASE - 1) / BASE
    log_b = np.log(BASE)

    def slope(j: np.ndarray) -> np.ndarray:
        pa_, pb_ = np.maximum(u - v * j, 1e-12), np.maximum(v - u * j, 1e-12)
        p, q = -np.log1p(-pa_ * c) / log_b, -np.log1p(-pb_ * c) / log_b
        dp, dq = -v * c / (1 - pa_ * c) / log_b, -u * c / (1 - pb_ * c) / log_b
        return above * dp / p + below * dq / q - same * (dp + dq) / np.maximum(1 - p - q, 1e-12)

    for _ in range(20):
        mid = (lo + hi) / 2
        up = slope(mid) > 0
        lo, hi = np.where(up, mid, lo), np.where(up, hi, mid)
    return (lo + hi) / 2


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n (set size), bytes (of the text), digest and registers of every document. Hashes are keyed by bytes drawn for this run."""
    key = os.urandom(16)

    def run(slab: pa.RecordBatch) -> pa.RecordBatch:
        texts = utf8(slab.column(1))
        sets = tx.shingle_sets(texts, k, key)
        return pa.RecordBatch.from_arrays(
            [
                slab.column(0),
                pa.array([len(s) for s, _ in sets], pa.int64()),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([digest(s, t) for s, t in sets], pa.binary()),
                pa.array([sketch(s).tobytes() if len(s) else None for s, _ in sets], pa.binary()),
            ],
            names=["doc_id", "n", "bytes", "digest", "registers"],
        )

    return map_text(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, n long, bytes long, digest binary, registers binary")


def _bands(classes: DataFrame) -> DataFrame:
    """(key, band, id) for every band of every class; a band's key hashes its number and register values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = tx.mix(np.arange(1, BANDS + 1).astype(U))
        for b in batches:
            regs = [x.as_buffer() for x in b.column(1)]
            k = np.frombuffer(b"".join(regs), np.uint16).reshape(len(regs), REGISTERS)[:, : BANDS * ROWS].astype(U).reshape(len(regs), BANDS, ROWS)
            h = np.broadcast_to(salt, k.shape[:2]).copy()
            for r in range(ROWS):
                h = tx.mix(h ^ k[:, :, r])
            yield pa.RecordBatch.from_arrays([pa.array(h.reshape(-1).view(np.int64)), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(regs))), pa.array(np.repeat(b.column(0).to_numpy(), BANDS))], names=["key", "band", "id"])

    return classes.select("id", "registers").mapInArrow(run, "key long, band int, id long")


def _likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, bytes of both texts) whose sizes and sketches allow the threshold."""
    left = classes.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("registers").alias("ra"), F.col("bytes").alias("sa"))
    right = classes.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("registers").alias("rb"), F.col("bytes").alias("sb"))
    near = pairs.join(right, "b").join(left, "a").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                r = [np.frombuffer(b"".join(x.as_buffer() for x in b.column(c)), np.uint16).reshape(-1, REGISTERS) for c in (4, 5)]
                j = similarity(r[0], r[1], b.column(2).to_numpy().astype(float), b.column(3).to_numpy().astype(float))
                keep = pa.array(j * 100 >= percent - 100 * MARGIN)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(6)], names=["a", "b", "bytes"]).filter(keep)

    return near.select("a", "b", "na", "nb", "ra", "rb", (F.col("sa") + F.col("sb")).alias("bytes")).mapInArrow(run, "a long, b long, bytes long")


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets are as similar as asked for."""
    union = np.concatenate([a, b])
    union.sort(kind="stable")
    size = 1 + np.count_nonzero(union[1:] != union[:-1]) if len(union) else 0
    both = len(a) + len(b) - size
    return both > 0 and 100 * both >= percent * size


def _slots(rows: DataFrame) -> int:
    """Into how many groups rows are dealt that verification reads, by their number and their column of bytes."""
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    return max(1, n // BLOCK, size // BLOCK_BYTES)


def verified(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union on full sets.

    The texts of b travel to the pairs; the text of a is sent once to each block of about
    BLOCK partners or BLOCK_BYTES, so that an a with many partners is spread over many tasks.
    """
    pairs = cut(pairs)
    slots = _slots(pairs)
    slot = F.pmod(F.xxhash64("a", "block"), F.lit(slots)).alias("slot")
    blocks = pairs.groupBy("a").agg(F.ceil(F.greatest(F.count("*") / F.lit(BLOCK), F.sum("bytes") / F.lit(BLOCK_BYTES))).cast("int").alias("blocks"))
    placed = pairs.join(blocks, "a").withColumn("block", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int"))
    texts = docs.select(F.col("doc_id").cast("long").alias("b"), F.col("text").cast("string").alias("text"))
    right = placed.join(texts, "b").select(slot.alias("in_slot"), F.col("a").alias("of"), "b", F.col("text").alias("theirs"))
    left = blocks.join(texts.withColumnRenamed("b", "a"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "text").select(slot, "a", "text")

    def check(ours: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        texts, out = dict(zip(ours["a"], ours["text"])), []
        held: list[tuple[int, int, str]] = []  # pairs whose words are numbered together

        def link() -> None:
            mine = list(dict.fromkeys(of for of, _, _ in held))
            sets = tx.exact_sets([(t or "").encode() for t in [*map(texts.get, mine), *(t for _, _, t in held)]], k)
            firsts = dict(zip(mine, sets))
            out.extend((of, b) for (of, b, _), s in zip(held, sets[len(mine) :]) if _linked(firsts[of], s, percent))
            held.clear()

        size, last = 0, None
        for pair in sorted(zip(theirs["of"], theirs["b"], theirs["theirs"]), key=lambda p: p[:2]):
            size += len(pair[2] or "") + (len(texts[pair[0]] or "") if pair[0] != last else 0)
            held.append(pair)
            last = pair[0]
            if size > CHECK_CHARS:
                link()
                size, last = 0, None
        if held:
            link()
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return left.groupBy("slot").cogroup(right.groupBy("in_slot")).applyInPandas(check, "a long, b long")


def _crossing(buckets: DataFrame, comp: DataFrame, classes: DataFrame, percent: int, best: bool) -> DataFrame:
    """Who is to be compared in buckets that still hold several components: (key, block, part, id, bytes, partners).

    A row with partners asks, one without is among the partners of others of its part, and a part has at most BLOCK of
    either and about BLOCK_BYTES of text. A pair is asked about in the first band that it shares only. With `best`, each member asks
    about the likeliest of each other component and block; without, about all that are likely. The
    pivot has met all members already."""
    label = F.coalesce(F.col("component"), F.col("id"))
    others = buckets.where("id <> pivot").select("key", "band", "id")
    members = cut(others.join(comp.withColumnRenamed("node", "id"), "id", "left").select("key", "band", "id", label.alias("comp")))
    sizes = members.groupBy("key", "comp").agg(F.count("*").alias("c"))
    # All but the members of the largest component ask.
    parts = sizes.groupBy("key").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.sum("c").alias("all"), F.max("c").alias("most")).where("most < all")
    parts = parts.select("key", "main", F.ceil(F.col("all") / F.lit(MEET)).cast("int").alias("blocks"), F.ceil((F.col("all") - F.col("most")) / F.lit(MEET)).cast("int").alias("askers"))
    held = cut(members.join(parts, "key").join(classes.select("id", "n", "bytes", "registers"), "id"))
    # A member stands in as many blocks as answer or ask; groups of rows stay the same size in buckets of any size.
    stands = held.agg(F.coalesce(F.sum(F.col("askers") + F.when(F.col("comp") != F.col("main"), F.col("blocks")).otherwise(0)), F.lit(0))).first()[0]
    slots = max(1, stands // (2 * MEET))
    # A block is a block of those that ask by one of those that answer; a member stands in all blocks of its own row or column.
    row, column = F.pmod(F.xxhash64("id", F.lit(1)), F.col("askers")).cast("int"), F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    span = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    answer = F.transform(span("askers"), lambda r: F.struct((r * F.col("blocks") + column).alias("block"), F.lit(False).alias("asks")))
    ask = F.when(F.col("comp") != F.col("main"), F.transform(span("blocks"), lambda c: F.struct((row * F.col("blocks") + c).alias("block"), F.lit(True).alias("asks")))).otherwise(F.array().cast("array<struct<block:int,asks:boolean>>"))
    rows = held.withColumn("at", F.explode(F.concat(answer, ask)))
    rows = rows.select(F.pmod(F.xxhash64("key", "at.block"), F.lit(slots)).alias("slot"), "key", "band", "at.block", "id", "comp", "n", "bytes", "registers", "at.asks")

    def meet(slot: pd.DataFrame) -> pd.DataFrame:
        out = []
        for place, group in slot.groupby(["key", "block"]):
            who, group = group[group["asks"]], group[~group["asks"]]
            if not len(who) or not len(group):
                continue
            regs = np.frombuffer(b"".join(group["registers"]), np.uint16).reshape(len(group), REGISTERS)
            n, ids, comps, band = group["n"].to_numpy(), group["id"].to_numpy(), group["comp"].to_numpy(), group["band"].iloc[0]
            size_of = dict(zip([*ids.tolist(), *who["id"]], [*group["bytes"], *who["bytes"]]))
            asked: list[tuple[int, np.ndarray]] = []
            for i, c, size, r in zip(who["id"], who["comp"], who["n"], who["registers"]):
                mine = np.frombuffer(r, np.uint16)
                ok = np.flatnonzero((comps != c) & (np.minimum(n, size) * 100 >= np.maximum(n, size) * percent))
                if len(ok) and band:
                    earlier = (regs[ok, : band * ROWS] == mine[: band * ROWS]).reshape(len(ok), band, ROWS).all(axis=2).any(axis=1)
                    ok = ok[~earlier]
                if not len(ok):
                    continue
                j = similarity(np.broadcast_to(mine, (len(ok), REGISTERS)), regs[ok], np.full(len(ok), float(size)), n[ok].astype(float))
                near = j * 100 >= percent - 100 * MARGIN
                ok, j = ok[near], j[near]
                if best:
                    order = np.argsort(-j, kind="stable")
                    ok = ok[order[np.unique(comps[ok[order]], return_index=True)[1]]]
                if len(ok):
                    asked.append((i, ids[ok]))
            for x, y in _parts([(i, p.tolist()) for i, p in asked], size_of):
                part, here = len(out), set(y)
                out += [(*place, part, i, size_of[i], [p for p in partners if p in here]) for i, partners in x if not here.isdisjoint(partners)]
                out += [(*place, part, i, size_of[i], None) for i in y]
        return pd.DataFrame(out, columns=["key", "block", "part", "id", "bytes", "partners"])

    return rows.groupBy("slot").applyInPandas(meet, "key long, block int, part int, id long, bytes long, partners array<long>")


def _runs(ids: list[int], size_of: dict[int, int]) -> list[list[int]]:
    """ids in runs of at most BLOCK, and of half of BLOCK_BYTES if none alone is longer."""
    out, held = [[]], 0
    for i in ids:
        if out[-1] and (len(out[-1]) == BLOCK or held + size_of[i] > BLOCK_BYTES // 2):
            out.append([])
            held = 0
        out[-1].append(i)
        held += size_of[i]
    return out if out[-1] else []


def _parts(asked: list[tuple[int, list[int]]], size_of: dict[int, int]) -> Iterator[tuple[list[tuple[int, list[int]]], list[int]]]:
    """Runs of those that ask, each with runs of the partners that they ask about."""
    of = dict(asked)
    for who in _runs([i for i, _ in asked], size_of):
        for wanted in _runs(sorted({p for i in who for p in of[i]}), size_of):
            yield [(i, of[i]) for i in who], wanted


def _answered(asked: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) among the pairs that _crossing asks about, verified on full sets, a part's texts at a time."""
    asked = cut(asked)
    slots = _slots(asked)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    rows = asked.join(texts, "id").select(F.pmod(F.xxhash64("key", "block", "part"), F.lit(slots)).alias("slot"), "key", "block", "part", "id", "partners", "text")

    def check(group: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, rows in group.groupby(["key", "block", "part"]):
            sets = dict(zip(rows["id"], tx.exact_sets([(t or "").encode() for t in rows["text"]], k)))
            for i, partners in zip(rows["id"], rows["partners"]):
                out += [(min(i, x), max(i, x)) for x in (partners if partners is not None else ()) if x in sets and _linked(sets[i], sets[x], percent)]
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return rows.groupBy("slot").applyInPandas(check, "a long, b long").distinct()


def _merged(comp: DataFrame, more: DataFrame) -> DataFrame:
    """Components (node, component) after further links (a, b): links are drawn between components, which are few."""
    of = {x: comp.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")) for x in "ab"}
    drawn = more.join(of["a"], "a", "left").join(of["b"], "b", "left").select(F.coalesce("ca", "a").alias("u"), F.coalesce("cb", "b").alias("v"))
    joined = components(drawn)
    moved = comp.join(joined.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    # A component's smallest node isn't a row of its own; if it moved, it is one now, and so is a node new to comp.
    fresh = joined.join(comp.select("node"), "node", "left_anti")
    return cut(moved.unionByName(fresh))


def near_duplicates(docs: DataFrame, k: int = 4, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document; see the module's text. Repeated doc_ids share a row each."""
    found = cut(sketches(docs, k))
    full = found.where("n > 0 and doc_id is not null")
    rep = full.groupBy("n", "digest").agg(F.min("doc_id").alias("id"))
    # One row a class: its smallest id carries the registers, which are equal for all.
    own = full.join(rep.withColumnRenamed("id", "doc_id"), ["doc_id", "n", "digest"])
    classes = cut(own.groupBy("doc_id", "n", "digest").agg(F.min("registers").alias("registers"), F.max("bytes").alias("bytes")).withColumnRenamed("doc_id", "id"))
    texts = docs.select("doc_id", "text")

    bands = _bands(classes)
    # The pivot is the least by one hash, so that buckets of the same documents tend to share it.
    crowded = cut(bands.groupBy("key").agg(F.count("*").alias("c"), F.min(F.struct(F.xxhash64("id"), "id"))["id"].alias("pivot")).where("c > 1").drop("c"))
    buckets = cut(_bands(classes).join(crowded, "key"))
    # From here on only classes that share a bucket matter.
    active = cut(classes.join(buckets.select("id").distinct(), "id", "left_semi").select("id", "n", "bytes", "registers"))
    pairs = buckets.where("id <> pivot").select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct()
    links = cut(verified(_likely(pairs, active, percent), texts, k, percent))
    comp = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    for best in (True, False):
        more = cut(_answered(_crossing(buckets, comp, active, percent, best), texts, k, percent))
        if not more.isEmpty():
            comp = _merged(comp, more)

    by_class = classes.join(comp.withColumnRenamed("node", "id"), "id", "left").select("n", "digest", F.coalesce("component", "id").alias("component"))
    out = found.join(by_class, ["n", "digest"], "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def op3_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


#: Exact links by counting shared shingles; components by growing reach.
OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 4 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i+3], ' ') END AS sh
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM w WHERE len(ws) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), m AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM m JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)
), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l
), r AS (SELECT a AS doc_id, a AS to_id FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.to_id
), c AS (SELECT doc_id, min(to_id) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.component_id, d.doc_id)::BIGINT AS component_id, coalesce(c.component_id, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""
