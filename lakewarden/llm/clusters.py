"""Clusters of vectors round integer centroids, by exponion search.

Vectors of one length become integers floor(scale * x). Each round gives every vector to its nearest centroid (squared Euclidean
distance; ties to the smaller number), then moves each centroid that has vectors to the exact floor of their mean.

Nearest centroids are found without looking at all. A vector carries its centroid, an upper bound u of the distance to it and a lower bound l of the
distance to any other. Between rounds u grows by what its centroid moved, and l shrinks by the most that another one moved. While u is below
l, or below half the distance from its centroid to that one's nearest other, nothing can have changed. Else u is made exact, and if that doesn't
settle it, only centroids in the ball of radius 2u + s round its centroid are looked at, s being the distance to that centroid's nearest other: they are a
prefix of its list of others, sorted by distance, which is cut by binary search. The ball is inclusive and bounds are widened by
far more than rounding errs, so that centroids at equal distance are all compared; distances compared are exact integers.

A round is one pass over the vectors, which are kept with their bounds in a table of the shared folder (the one before is removed then), and an
aggregate of partial sums. The driver holds centroids and their distances to each other: k * k numbers, k being at most MOST.

Kept are vectors with exactly `length` components, none null or non-finite. A component whose integer lies beyond 2^26 can't have
its distances held in a long, so such vectors are left out as well. Repeated rows each count. A null vec_id is given a cluster as any other, but is no
starting centroid. With fewer vectors than k there are as many centroids as distinct starting rows. Ties of starting rows (a repeated vec_id) go to
the smaller vector. Other columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewarden.llm.common import Stored, table

#: Centroids at most, so that their distances to each other fit the driver and every task (128 MB).
MOST = 4096
#: Bounds are widened by this share, and by this much; doubles err by about 1e-16 of the value.
SHARE, LEAST = 1e-9, 1e-6
_ROW = "vec_id long, vector array<int>, cluster int, upper double, lower double"


class Search:
    """Centroids, their distances to each other, and each one's list of all by distance, itself first."""

    def __init__(self, centroids: np.ndarray) -> None:
        self.c = centroids
        gaps = np.stack([np.sqrt(((centroids - x) ** 2).sum(axis=1).astype(np.float64)) for x in centroids])
        order = np.argsort(gaps, axis=1, kind="stable")
        for i, row in enumerate(order):  # equal centroids are at distance 0 too
            at = np.flatnonzero(row == i)[0]
            row[1 : at + 1] = row[:at].copy()
            row[0] = i
        self.order = order
        self.gaps = np.take_along_axis(gaps, order, axis=1)
        self.alone = self.gaps[:, 1] if len(centroids) > 1 else np.full(len(centroids), np.inf)

    def exact(self, x: np.ndarray, j: np.ndarray) -> np.ndarray:
        d = x - self.c[j]
        return (d * d).sum(axis=1)

    def assign(self, x: np.ndarray, at: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Clusters and bounds of the vectors x, given clusters that were right once and bounds that hold; and how many distances that took."""
        at, upper, lower, looked = at.copy(), upper.copy(), lower.copy(), 0
        floor = np.maximum(lower, self.alone[at] / 2)
        open_ = np.flatnonzero(upper * (1 + SHARE) + LEAST >= floor)
        upper[open_] = np.sqrt(self.exact(x[open_], at[open_]))
        looked += len(open_)
        open_ = open_[upper[open_] * (1 + SHARE) + LEAST >= floor[open_]]
        if not len(open_) or len(self.c) == 1:
            return at, upper, lower, looked
        radius = (2 * upper[open_] + self.alone[at[open_]]) * (1 + SHARE) + LEAST
        for a in np.unique(at[open_]):
            mine = open_[at[open_] == a]
            inside = np.searchsorted(self.gaps[a], radius[at[open_] == a], side="right")
            best, who, second = np.full(len(mine), np.iinfo(np.int64).max), np.full(len(mine), a), np.full(len(mine), np.inf)
            for r in range(int(inside.max())):
                in_ball = np.flatnonzero(inside > r)
                j = self.order[a, r]
                d = self.exact(x[mine[in_ball]], np.full(len(in_ball), j))
                looked += len(in_ball)
                better = (d < best[in_ball]) | (d == best[in_ball]) & (j < who[in_ball])
                second[in_ball] = np.minimum(second[in_ball], np.where(better, np.sqrt(best[in_ball].astype(np.float64)), np.sqrt(d)))
                best[in_ball[better]], who[in_ball[better]] = d[better], j
            at[mine], upper[mine] = who, np.sqrt(best)
            # What lies outside the ball is farther than the second nearest, which is inside unless the ball holds one centroid only.
            lower[mine] = np.where(np.isinf(second), 0.0, second * (1 - SHARE))
        return at, upper, lower, looked


def moved(before: np.ndarray, after: np.ndarray, at: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds that hold after centroids have moved."""
    step = np.sqrt(((after - before) ** 2).sum(axis=1).astype(np.float64)) * (1 + SHARE)
    far = np.argsort(step)[::-1]
    others = np.full(len(step), step[far[0]])
    others[far[0]] = step[far[1]] if len(step) > 1 else 0.0
    return upper * (1 + SHARE) + step[at], np.maximum(lower - others[at], 0.0)


def integers(vectors: DataFrame, length: int, scale: int) -> DataFrame:
    """vec_id and vector of the vectors kept."""
    fine: Column = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(F.floor(v.cast("double") * scale).cast("double")) <= float(1 << 26)))
    kept = vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") == length)).where(F.forall("embedding", lambda v: v.isNotNull() & (F.abs(v.cast("double")) < float("inf")))).where(fine)
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda v: F.floor(v.cast("double") * scale).cast("int")).alias("vector"))


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(np.int64)


def _round(rows: DataFrame, search: Search, before: np.ndarray | None) -> DataFrame:
    """rows with clusters and bounds by `search`; those they have are by the centroids `before` (none: there are none yet)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(1), b.num_rows)
            if before is None:
                at, upper, lower = np.zeros(len(x), np.int64), np.full(len(x), np.inf), np.zeros(len(x))
            else:
                at, upper, lower = (b.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4))
                upper, lower = moved(before, search.c, at, upper, lower)
            at, upper, lower, _ = search.assign(x, at.astype(np.int64), upper, lower)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(at.astype(np.int32)), pa.array(upper), pa.array(lower)], names=["vec_id", "vector", "cluster", "upper", "lower"])

    return rows.mapInArrow(run, _ROW)


def _means(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Floors of the means of each cluster's vectors; a cluster without vectors keeps its centroid. k rows a task reach the driver's aggregate."""
    width = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
        for b in batches:
            if b.num_rows:
                x, at = _matrix(b.column(0), b.num_rows), b.column(1).to_numpy(zero_copy_only=False)
                for j in np.unique(at):
                    sums[j] += x[at == j].sum(axis=0)
                counts += np.bincount(at, minlength=len(counts))
        have = np.flatnonzero(counts)
        if len(have):
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(have) + 1) * width, pa.int32()), pa.array(sums[have].reshape(-1)))
            yield pa.RecordBatch.from_arrays([pa.array(have.astype(np.int32)), pa.array(counts[have]), flat], names=["cluster", "n", "sums"])

    parts = rows.select("vector", "cluster").mapInArrow(run, "cluster int, n long, sums array<long>")
    total = parts.select("cluster", "n", F.posexplode("sums").alias("i", "s")).groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    out = centroids.copy()
    for r in total.collect():  # k * length numbers
        out[r["cluster"], r["i"]] = int(r["s"]) // r["n"]
    return out


def clusters(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, length: int = 64, scale: int = 1024) -> tuple[DataFrame, list[list[int]]]:
    """vec_id, cluster and distance (squared) of every vector kept, and the final centroids."""
    if k > MOST:
        raise ValueError(f"at most {MOST} centroids")
    spark = vectors.sparkSession
    kept = integers(vectors, length, scale)
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = kept.where(F.col("vec_id").isNotNull()).select(mark.alias("mark"), "vector").orderBy("mark", "vector").limit(k).collect()
    if not first:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), []
    now, before = np.array([r["vector"] for r in first], np.int64), None
    with Stored(spark, "clusters") as keep:
        rows = kept
        for step in range(rounds + 1):
            rows = keep(_round(rows, Search(now), before), last=step == rounds)
            before = now
            if step < rounds:
                keep.drop()
                now = _means(rows, now)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                at = b.column(2).to_numpy(zero_copy_only=False)
                d = ((_matrix(b.column(1), b.num_rows) - now[at]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(d)], names=["vec_id", "cluster", "distance"])

    return rows.select("vec_id", "vector", "cluster").mapInArrow(run, "vec_id long, cluster int, distance long"), now.tolist()


def summed(vectors: DataFrame, **how: int) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector kept."""
    rows, centroids = clusters(vectors, **how)
    if not centroids:
        return rows.selectExpr("vec_id", "cluster", "distance", "distance AS cluster_inertia", "distance AS inertia", "'' AS centroid_sha256")
    marks = [(j, sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(centroids)]
    sums = {r["cluster"]: r["s"] for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows
    known = [(j, int(sums.get(j) or 0), int(sum(sums.values())), mark) for j, mark in marks]
    facts = vectors.sparkSession.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_exponion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summed(table(spark, sf_dir, "embeddings"))


def _sql(k: int = 8, rounds: int = 10, seed: int = 3, length: int = 64) -> str:
    """Every distance of every round, plainly."""
    parts = [
        f"kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings "
        f"WHERE len(embedding) = {length} AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false))))",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY mark, v) - 1 AS c, v FROM (SELECT sha256('{seed}:' || vec_id) AS mark, v FROM kept WHERE vec_id IS NOT NULL ORDER BY mark, v LIMIT {k}))",
    ]
    for i in range(rounds + 1):
        parts.append(
            f"a{i} AS MATERIALIZED (SELECT r, min(struct_pack(d := list_sum(list_transform(range(1, {length + 1}), lambda i: (kept.v[i] - c{i}.v[i]) * (kept.v[i] - c{i}.v[i]))), c := c)) AS best FROM kept, c{i} GROUP BY r)"
        )
        if i < rounds:
            parts.append(f"s{i} AS MATERIALIZED (SELECT best.c AS c, i, sum(kept.v[i])::BIGINT AS s, count(*) AS n FROM a{i} JOIN kept USING (r), range(1, {length + 1}) t(i) GROUP BY ALL)")
            parts.append(f"m{i} AS MATERIALIZED (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM s{i} GROUP BY c)")
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c, coalesce(m{i}.v, c{i}.v) AS v FROM c{i} LEFT JOIN m{i} USING (c))")
    last = f"c{rounds}"
    return (
        "WITH " + ",\n".join(parts) + f"\nSELECT vec_id, best.c::INT AS cluster, best.d::BIGINT AS distance, (sum(best.d) OVER (PARTITION BY best.c))::BIGINT AS cluster_inertia, "
        f"(sum(best.d) OVER ())::BIGINT AS inertia, sha256(array_to_string({last}.v, ',')) AS centroid_sha256\nFROM kept JOIN a{rounds} USING (r) JOIN {last} ON {last}.c = best.c"
    )


OP12_SQL = _sql()
