"""Nearest neighbours by balanced posting lists.

Centroids are the leaves of a balanced bisection of a bounded sample, between one and two times the
square root of the number of vectors, so that lists are of even size and grow as slowly as their number does. A graph of each
centroid's nearest others lies in memory and is searched best first, for many vectors at a time. Every vector goes to the list of
its nearest centroid, and to those of other centroids hardly farther (boundary vectors). A query reads the lists whose centroid is
within a ratio of its nearest centroid's distance, up to a number of probes. Ratio and probes follow from a recall target: for TRIALS queries all vectors are compared,
in one pass, and of the lists in which their nearest lie so many are read that `recall` of these are found. Vectors in groups need few lists at any size; unrelated ones have
no structure to prune by, and need a share of all lists that grows with the number of dimensions. `nearest(exact=True)` reads all.

The nearest are those of the largest inner product: stored vectors get one coordinate more that makes them equally long, queries
are scaled to that length and have 0 there, and then the nearest by distance are those of the largest product.

Equal vectors are one class that is indexed once, with its 'keep' smallest ids: of equal vectors
no more can be among the nearest k of anything, as ties go to smaller ids. Queries of one class are
searched once. Lists are cut into blocks by a hash and put into shards of
bounded size; each shard scores its blocks against its queries as matrix products and
returns its best classes only. Scores are computed on the vectors found, in double precision.

Vectors that are null, zero, or hold null or non-finite components take no part. Vectors are compared with those of their own
length: each length of FEW vectors or more has an index, each other one is a list that its queries read whole, in blocks. Repeated rows
count once; rows without vec_id are left out; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakewarden.llm.common import cut, hash_sample, table

#: Vectors of the sample for each list, and vectors and their numbers in the sample at most.
LIST_SIZE, SAMPLE, SAMPLE_NUMBERS = 100, 200_000, 16_000_000
#: Vectors of the sample for each list at least in tables so small that the sample holds them all.
SMALL = 40
DEGREE = 16
#: A vector joins lists whose centroid's distance is within this ratio of its nearest centroid's, up to COPIES lists.
BOUNDARY, COPIES = 1.12, 4
#: A query reads its LEAST nearest lists in any case, as it may lie on a centroid.
LEAST = 8
#: Of the nearest of so many queries this share is to lie in the lists read.
RECALL, TRIALS = 0.98, 256
#: Vectors of a length from which on it is indexed.
FEW = 5_000
SHARD_ROWS = 40_000
#: Candidates of a list by single-precision products, beside those asked for, whose scores are computed in double precision.
SPARE = 8


@dataclass
class Index:
    centroids: np.ndarray
    graph: np.ndarray
    entry: np.ndarray


def bisect(x: np.ndarray, size: int) -> np.ndarray:
    """Means of equal parts: each part is cut at the median along the direction between the means of two groups."""
    parts, done = [x], []
    while parts:
        p = parts.pop()
        if len(p) <= size:
            done.append(p.mean(axis=0))
            continue
        a, b = p[0], p[np.argmax(((p - p[0]) ** 2).sum(axis=1))]
        for _ in range(6):
            near = ((p - a) ** 2).sum(axis=1) <= ((p - b) ** 2).sum(axis=1)
            if near.all() or not near.any():
                break
            a, b = p[near].mean(axis=0), p[~near].mean(axis=0)
        order = np.argsort(p @ (a - b), kind="stable")
        parts += [p[order[: len(p) // 2]], p[order[len(p) // 2 :]]]
    return np.array(done)


def build(x: np.ndarray, list_size: int = LIST_SIZE) -> Index:
    c = bisect(x, list_size)
    degree, norm, near = max(1, min(DEGREE, len(c) - 1)), (c * c).sum(axis=1), []
    for a in range(0, len(c), 256):  # a block of centroids at a time
        d = norm - 2 * c[a : a + 256] @ c.T
        d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
        part = np.argpartition(d, degree - 1, axis=1)[:, :degree]
        near.append(np.take_along_axis(part, np.argsort(np.take_along_axis(d, part, axis=1), axis=1, kind="stable"), axis=1))
    graph = np.concatenate(near)
    if len(c) > 1:  # a few far edges keep the graph in one piece
        far = np.random.default_rng(7).integers(0, len(c), (len(c), 4))
        ring = (np.arange(len(c))[:, None] + 1) % len(c)
        graph = np.concatenate([graph, far, ring], axis=1)
    return Index(c, graph, np.unique(np.linspace(0, len(c) - 1, min(8, len(c))).astype(int)))


def walk(index: Index, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """The `beam` nearest centroids that a best-first walk of the graph finds for each row of x, and their distances."""
    c, g = index.centroids, index.graph
    n, beam = len(x), min(beam, len(c))
    norm = (c * c).sum(axis=1)
    own = (x * x).sum(axis=1)
    ids = np.tile(index.entry, (n, 1))
    if len(c) <= beam:
        ids = np.tile(np.arange(len(c)), (n, 1))
    dist = own[:, None] - 2 * np.einsum("nd,ned->ne", x, c[ids]) + norm[ids]
    seen = np.zeros((n, len(c)), bool)
    np.put_along_axis(seen, ids, True, axis=1)
    opened = np.zeros(ids.shape, bool)
    if len(c) > beam:
        while True:
            best = np.where(opened, np.inf, dist)
            pick = best.argmin(axis=1)
            live = np.flatnonzero(np.isfinite(best[np.arange(n), pick]))
            if not len(live):
                break
            opened[live, pick[live]] = True
            new = g[ids[live, pick[live]]]
            known = np.take_along_axis(seen[live], new, axis=1)
            new = np.sort(np.where(known, len(c), new), axis=1)
            new[:, 1:][new[:, 1:] == new[:, :-1]] = len(c)
            fresh = new < len(c)
            safe = np.where(fresh, new, 0)
            d = np.full((n, new.shape[1]), np.inf)
            d[live] = np.where(fresh, own[live, None] - 2 * np.einsum("nd,ned->ne", x[live], c[safe]) + norm[safe], np.inf)
            rows, cols = np.nonzero(fresh)
            seen[live[rows], new[rows, cols]] = True
            wide = np.zeros((n, new.shape[1]), ids.dtype)
            wide[live] = safe
            ids, dist = np.concatenate([ids, wide], axis=1), np.concatenate([dist, d], axis=1)
            opened = np.concatenate([opened, ~np.isfinite(d)], axis=1)
            if ids.shape[1] > beam:
                keep = np.argpartition(dist, beam - 1, axis=1)[:, :beam]
                ids, dist, opened = (np.take_along_axis(z, keep, axis=1) for z in (ids, dist, opened))
    order = np.argsort(dist, axis=1, kind="stable")
    return np.take_along_axis(ids, order, axis=1), np.sqrt(np.maximum(np.take_along_axis(dist, order, axis=1), 0))


def distances(index: Index, x: np.ndarray) -> np.ndarray:
    """From each row of x to each centroid."""
    c = index.centroids
    return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ c.T + (c * c).sum(axis=1), 0))


def chosen(index: Index, x: np.ndarray, ratio: float, most: int, least: int = 1) -> list[np.ndarray]:
    """The lists of each row of x: those whose centroids are within `ratio` of the nearest one's distance, `least` to `most` of them."""
    out = []
    for a in range(0, len(x), 512):
        if 4 * most >= len(index.centroids):  # a walk would see nearly all
            dist = distances(index, x[a : a + 512])
            ids = np.argsort(dist, axis=1, kind="stable")
            dist = np.take_along_axis(dist, ids, axis=1)
        else:
            ids, dist = walk(index, x[a : a + 512], 2 * most)
        ok = ((dist <= ratio * dist[:, :1] + 1e-12) | (np.arange(dist.shape[1]) < least)) & np.isfinite(dist)
        out += [i[k][:most] for i, k in zip(ids, ok)]
    return out


def _matrix(column: pa.Array | pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column]) if len(column) else np.empty((0, 0))


def _valid(vectors: DataFrame) -> DataFrame:
    e = F.col("embedding")
    fine = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf"))) & F.exists(e, lambda v: v != 0)
    return vectors.where(F.col("vec_id").isNotNull() & e.isNotNull() & fine).select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding"))


def lifted(x: np.ndarray, longest: float, query: bool) -> np.ndarray:
    """Vectors with a coordinate more, all as long as the longest stored one, so that distances order as inner products do."""
    size = np.sqrt((x * x).sum(axis=1))
    if query:
        return np.concatenate([x * (longest / size)[:, None], np.zeros((len(x), 1))], axis=1)
    return np.concatenate([x, np.sqrt(np.maximum(longest * longest - size * size, 0))[:, None]], axis=1)


def _listed(rows: DataFrame, index: Index, longest: float, query: bool, ratio: float, most: int) -> DataFrame:
    """rows (class, embedding), once for each of their lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                where = chosen(index, lifted(_matrix(b.column(1).to_numpy(zero_copy_only=False)), longest, query), ratio, most, LEAST if query else 1)
                at = pa.array(np.repeat(np.arange(b.num_rows), [len(w) for w in where]))
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(np.concatenate(where).astype(np.int32))], names=["class", "embedding", "list"])

    kind = rows.schema["embedding"].dataType.simpleString()
    return rows.select("class", "embedding").mapInArrow(run, f"class long, embedding {kind}, list int")


def tuned(index: Index, queries: np.ndarray, found: list[np.ndarray], recall: float) -> tuple[float, int]:
    """A ratio and a number of probes by which queries read lists that hold `recall` of what they should find; all are lifted vectors.

    found: each query's nearest. What a nearest vector needs is the first of the query's lists that it is in."""
    dist = distances(index, queries)
    place = np.argsort(np.argsort(dist, axis=1, kind="stable"), axis=1, kind="stable")
    homes = chosen(index, np.concatenate(found), BOUNDARY, COPIES)
    of = np.repeat(np.arange(len(queries)), [len(f) for f in found])
    first = [h[np.argmin(place[q, h])] for q, h in zip(of, homes)]
    ranks = place[of, first] + 1
    ratios = dist[of, first] / np.maximum(dist.min(axis=1)[of], 1e-12)
    share = (1 + recall) / 2  # half of what may be missed goes to each
    # Lists read in any case need no ratio.
    ratio = max(1.0, float(np.quantile(np.where(ranks <= LEAST, 1.0, ratios), share))) * 1.001
    probes = max(LEAST, int(np.quantile(ranks, share, method="higher")))
    while probes < len(index.centroids):  # the walk may miss lists
        read = [set(x) for x in chosen(index, queries, ratio, probes, LEAST)]
        if np.mean([not read[q].isdisjoint(h) for q, h in zip(of, homes)]) >= recall:
            break
        probes, ratio = min(len(index.centroids), probes + probes // 4 + 1), ratio * 1.02
    return ratio, probes


def _trials(classes: DataFrame, chosen_: DataFrame, k: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The vectors of the chosen classes (TRIALS at most) and the k nearest other classes of each, by comparison with all: one pass over classes, k rows a query and task."""
    asked = chosen_.collect()
    ids, u = np.array([r["class"] for r in asked], np.int64), _matrix([r["embedding"] for r in asked])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.empty(0), np.empty(0, np.int64), np.empty((0, u.shape[1])))] * len(ids)
        for b in batches:
            for a in range(0, b.num_rows, 4096):
                part = b.slice(a, 4096)
                number, v = part.column(0).to_numpy(zero_copy_only=False), _matrix(part.column(1).to_numpy(zero_copy_only=False))
                s = u @ v.T
                s[ids[:, None] == number[None, :]] = -np.inf
                top = np.argpartition(s, s.shape[1] - k, axis=1)[:, -k:] if s.shape[1] > k else np.tile(np.arange(s.shape[1]), (len(ids), 1))
                for q in range(len(ids)):
                    mine = tuple(np.concatenate(x) for x in zip(best[q], (s[q, top[q]], number[top[q]], v[top[q]])))
                    order = np.argsort(-mine[0], kind="stable")[:k]
                    best[q] = tuple(x[order] for x in mine)
        rows = [(q, float(s), v.tolist()) for q in range(len(ids)) for s, v in zip(best[q][0], best[q][2]) if np.isfinite(s)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.float64(), pa.list_(pa.float64())))], names=["q", "score", "v"])

    place = Window.partitionBy("q").orderBy(F.desc("score"))
    rows = classes.select("class", "embedding").mapInArrow(run, "q int, score double, v array<double>")
    found: list[list] = [[] for _ in ids]
    for r in rows.withColumn("r", F.row_number().over(place)).where(F.col("r") <= k).collect():
        found[r["q"]].append(r["v"])
    some = [i for i, f in enumerate(found) if f]
    return u[some], [_matrix(found[i]) for i in some]


def _indexed(classes: DataFrame, total: int, length: int, longest: float, k: int, rows: int, list_size: int, recall: float) -> tuple[Index, float, int]:
    """An index of classes of one length, and the ratio and number of probes of its queries."""
    lists = int(np.ceil(np.sqrt(total)))
    wanted = min(rows, SAMPLE_NUMBERS // length, lists * list_size)
    sample = _matrix([r["embedding"] for r in hash_sample(classes, ["class"], wanted, total).select("embedding").collect()])
    index = build(lifted(sample, longest, False), max(SMALL if total <= len(sample) else 1, len(sample) // lists))
    queries, found = _trials(classes, hash_sample(classes, ["class"], TRIALS, total).select("class", "embedding"), k)
    if not found:
        return index, 1.0, len(index.centroids)
    return index, *tuned(index, lifted(queries, longest, True), [lifted(f, longest, False) for f in found], recall)


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, recall: float = RECALL, rows: int = SAMPLE, list_size: int = LIST_SIZE, exact: bool = False) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found of each query: rows whose vec_id is divisible by `every`.

    Centroids of a length are fitted to at most `rows` vectors (and SAMPLE_NUMBERS numbers), `list_size` of them a list or fewer, as there are to be at least as many lists as
    the square root of the number of vectors. With exact=True queries are compared with all vectors of their length."""
    spark = vectors.sparkSession
    valid = _valid(vectors).distinct()
    # The smallest k + 1 ids of each class; a class of any size is first thinned in parts.
    for part in ([F.pmod(F.xxhash64("vec_id"), F.lit(32))], []):
        order = Window.partitionBy("embedding", *part).orderBy("vec_id")
        kept = (kept if not part else valid).withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= k + 1).drop("__r")
    members = cut(kept.withColumn("class", F.min("vec_id").over(Window.partitionBy("embedding"))))
    every_class = members.where("class = vec_id").select("class", "embedding", F.size("embedding").alias("length"))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    lengths = cut(every_class.groupBy("length").agg(F.count("*").alias("n"), F.max(norm).alias("longest")))
    out = "query_id long, rank int, vec_id long, score double"
    total = lengths.agg(F.sum("n")).first()[0]
    if not total:
        return spark.createDataFrame([], out)
    # The commonest length has an index in small tables too; at most total / FEW lengths have one.
    most = lengths.orderBy(F.desc("n"), "length").first()["length"]
    large = [] if exact else lengths.where((F.col("n") >= FEW) | (F.col("length") == most)).orderBy("length").collect()

    shards = max(1, -(-total * 2 // SHARD_ROWS), min(12, total // 500))
    # A list of many vectors is cut into `spread` blocks; which shard has a block is fixed by list and block.
    shard = F.pmod(F.xxhash64("list", "block"), F.lit(shards)).cast("int")
    block = F.pmod(F.xxhash64("class"), F.col("spread")).cast("int")
    queries = valid.where(F.col("vec_id") % every == 0).join(members.where("class = vec_id").select("class", F.col("embedding").alias("e")), F.col("embedding") == F.col("e")).select(F.col("vec_id").alias("query_id"), "class", "embedding")
    queries = cut(queries)
    asking = cut(queries.select("class", "embedding").dropDuplicates(["class"]).withColumn("length", F.size("embedding")))
    # Lists of negative numbers, one a length, for lengths without an index.
    others = lengths.where(~F.col("length").isin([r["length"] for r in large])) if large else lengths

    def whole(rows: DataFrame) -> DataFrame:
        of = others.select("length", (-F.col("length")).alias("list"), F.ceil(F.col("n") / F.lit(SHARD_ROWS)).cast("int").alias("spread"))
        return rows.join(F.broadcast(of), "length").drop("length")  # a row a length

    stored, asked, before = whole(every_class), whole(asking), 0
    asks = asking.count()
    for r in large:
        classes = every_class.where(F.col("length") == r["length"])
        index, ratio, probes = _indexed(classes, r["n"], r["length"], r["longest"], k, rows, list_size, recall)
        spread = max(1, -(-r["n"] // (len(index.centroids) * SHARD_ROWS)))
        named = (F.col("list") + before).alias("list")
        before += len(index.centroids)
        placed = _listed(classes, index, r["longest"], False, BOUNDARY, COPIES)
        stored = stored.unionByName(placed.select("class", "embedding", named, F.lit(spread).alias("spread")))
        # Walking the graph takes far longer than moving queries, of which a table has few bytes; AQE would put all into one task.
        mine = asking.where(F.col("length") == r["length"]).repartition(max(1, asks // 512), "class")
        asked = asked.unionByName(_listed(mine, index, r["longest"], True, ratio, probes).select("class", "embedding", named, F.lit(spread).alias("spread")))
    stored = stored.withColumn("block", block).select(shard.alias("shard"), "list", F.col("class").alias("c"), F.col("embedding").alias("v"))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("spread") - 1))).select(shard.alias("to_shard"), "list", F.col("class").alias("q"), F.col("embedding").alias("u"))

    def search(ours: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        parts = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        at_list, who, numbers = theirs.groupby("list").indices, ours["q"].to_numpy(), theirs["c"].to_numpy()
        for x, rows in ours.groupby("list").indices.items():
            if x not in at_list:
                continue
            at = at_list[x]
            u, v = _matrix(ours["u"].iloc[rows]), _matrix(theirs["v"].iloc[at])
            u_, v_, most = u.astype(np.float32), v.astype(np.float32).T, k + 1 + SPARE
            for a in range(0, len(u), 256):
                s = u_[a : a + 256] @ v_
                top = np.argpartition(s, s.shape[1] - most, axis=1)[:, -most:] if s.shape[1] > most else np.tile(np.arange(s.shape[1]), (len(s), 1))
                i, t = np.repeat(np.arange(a, a + len(s)), top.shape[1]), top.reshape(-1)
                parts.append((who[rows[i]], numbers[at[t]], (u[i] * v[t]).sum(axis=1)))
        q, c, s = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((c, -s, q))
        q, c, s = q[order], c[order], s[order]
        fresh = np.ones(len(q), bool)  # a boundary vector is found in several lists
        fresh[1:] = (q[1:] != q[:-1]) | (c[1:] != c[:-1])
        q, c, s = q[fresh], c[fresh], s[fresh]
        first = np.searchsorted(q, q)
        best = np.arange(len(q)) - first <= k
        return pd.DataFrame({"q": q[best], "c": c[best], "score": s[best]})

    near = asked.groupBy("to_shard").cogroup(stored.groupBy("shard")).applyInPandas(search, "q long, c long, score double").distinct()
    best = Window.partitionBy("q").orderBy(F.desc("score"), "c")
    near = cut(near.withColumn("__r", F.row_number().over(best)).where(F.col("__r") <= k + 1).drop("__r"))
    ids = members.groupBy("class").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))  # k + 1 at most
    # One row a query class with its nearest ids, so that queries of one class are expanded last.
    hits = near.join(ids, F.col("c") == F.col("class")).select("q", "score", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    best = hits.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= k + 1)
    found = cut(best.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("__r", "vec_id", "score"))).alias("top")))
    answered = queries.select("query_id", "class").join(found, F.col("class") == F.col("q"))
    own = F.slice(F.filter("top", lambda t: t["vec_id"] != F.col("query_id")), 1, k)
    return answered.select("query_id", F.posexplode(own).alias("p", "t")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("t.vec_id").alias("vec_id"), F.col("t.score").alias("score"))


def op2_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
