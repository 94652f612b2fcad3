"""Exact nearest vectors by inner product, from balls whose bounds rule most of them out.

Vectors are dealt to balls: each goes to the nearest of some pivots, which are far apart in a bounded sample. A ball knows its pivot c, its radius r (the distance of its
farthest vector) and its longest vector's length. For a query q no inner product in it is more than q . c + |q| r (Cauchy-Schwarz, on what a vector differs from
the pivot by), nor than |q| times that length.

1. A query meets the ball with the highest q . c: the k-th best product there is a threshold.
2. It then meets all balls whose bound reaches the threshold, and no others.

Queries and vectors meet in groups of a bounded number of each, as products of matrices; of a group each query keeps its k best of those that reach its threshold, ties to the smaller number.
Tasks hold and pass on PRODUCTS numbers at a time, however many queries, balls or vectors there are. Products that are returned are sums in the order of the components, in double precision, so that they equal those of the expression `dot`. Nothing is capped, and results are exact.

Vectors that are null, hold null or non-finite components, or are of another length than the query, are in no result. Numbers are to be unique and not null. Where vectors
have no structure all bounds may reach the threshold; then all are compared, still without a cross join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import ROUND_HALF_EVEN, Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewarden.operators.ranking import top_k
from lakewarden.sources.tables import shared_folder

#: Vectors that pivots are chosen from, and pivots, at most; vectors and queries that meet in one group.
SAMPLE, PIVOTS, BLOCK, ASKERS = 10_000, 512, 8192, 4096
#: Numbers that a task makes, or passes on, at a time.
PRODUCTS = 1 << 20
#: Scores are rounded to so many digits by those who rank them.
DIGITS = 4


@dataclass
class Balls:
    """vectors: ball, block, number, vector. The rest is an entry a ball."""

    vectors: DataFrame
    number: np.ndarray
    pivots: np.ndarray
    radius: np.ndarray
    longest: np.ndarray
    blocks: np.ndarray


def _fine(v: Column) -> Column:
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))


def _matrix(column: pa.Array | pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column]) if len(column) else np.empty((0, 0))


def slices(n: int, each: int) -> Iterator[slice]:
    """n rows in turn, as many at a time as have PRODUCTS entries of `each`."""
    step = max(1, PRODUCTS // max(1, each))
    return (slice(i, min(n, i + step)) for i in range(0, n, step))


def far_apart(x: np.ndarray, n: int) -> np.ndarray:
    """At most n different rows of x, each the farthest from those before it."""
    chosen = [0]
    gap = ((x - x[0]) ** 2).sum(axis=1)
    while len(chosen) < n and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return x[chosen]


def build_balls(vectors: DataFrame, length: int, pivots: int | None = None, block: int | None = None) -> Balls | None:
    """Balls of the vectors (chunk_no, embedding) with `length` components, or None where there are none. Those of one block make one ball, unless a number of pivots is asked for."""
    block = block or BLOCK
    rows = vectors.where(_fine(F.col("embedding")) & (F.size("embedding") == length)).select(F.col("chunk_no").alias("number"), F.col("embedding").cast("array<double>").alias("vector"))
    total = rows.count()
    if not total:
        return None
    share = min(1.0, 1.2 * SAMPLE / total)
    some = rows.where(F.pmod(F.xxhash64("number"), F.lit(1 << 20)) <= int(share * (1 << 20))).limit(SAMPLE)
    sample = _matrix([r["vector"] for r in some.select("vector").collect()]) if total > SAMPLE else _matrix([r["vector"] for r in rows.select("vector").collect()])
    centres = far_apart(sample if len(sample) else np.zeros((1, length)), pivots or (1 if total <= block else min(PIVOTS, int(np.ceil(np.sqrt(total))))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in slices(whole.num_rows, max(len(centres), length)):
                b = whole.slice(at.start, at.stop - at.start)
                x = _matrix(b.column(1).to_numpy(zero_copy_only=False))
                d = (centres * centres).sum(axis=1) - 2 * x @ centres.T
                ball = d.argmin(axis=1)
                away = np.sqrt(((x - centres[ball]) ** 2).sum(axis=1))
                cols = [pa.array(ball.astype(np.int32)), pa.array(away), pa.array(np.sqrt((x * x).sum(axis=1)))]
                yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=["number", "vector", "ball", "away", "norm"])

    kind = rows.schema["number"].dataType.simpleString()
    shared_folder(vectors.sparkSession)
    placed = rows.mapInArrow(place, f"number {kind}, vector array<double>, ball int, away double, norm double").checkpoint()
    facts = placed.groupBy("ball").agg(F.count("*").alias("n"), F.max("away").alias("radius"), F.max("norm").alias("longest")).orderBy("ball").collect()  # a row a ball
    number = np.array([r["ball"] for r in facts])
    blocks = np.array([-(-r["n"] // block) for r in facts])
    of = F.element_at(F.create_map(*[F.lit(int(x)) for pair in zip(number, blocks) for x in pair]), F.col("ball"))
    stored = placed.select("ball", F.pmod(F.xxhash64("number"), of).cast("int").alias("block"), "number", "vector")
    return Balls(stored, number, centres[number], np.array([r["radius"] for r in facts]), np.array([r["longest"] for r in facts]), blocks)


def rounded(x: float) -> Decimal:
    """As bround does: half to even of the shortest decimal that reads as x."""
    return Decimal(repr(x)).quantize(Decimal(1).scaleb(-DIGITS), rounding=ROUND_HALF_EVEN)


def best(scores: np.ndarray, numbers: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores as rounded, ties to smaller numbers; more where that needn't be settled here."""
    if len(scores) <= 4 * k:
        return np.arange(len(scores))
    values, of = np.unique(scores, return_inverse=True)
    ranks = np.unique([rounded(float(v)) for v in values], return_inverse=True)[1][of]
    return np.lexsort((numbers, -ranks))[:k]


def meet(theirs: pd.DataFrame, ours: pd.DataFrame, k: int) -> pd.DataFrame:
    """The best of one group's vectors (number, vector) for each of its queries (query, asked, least), of those that reach its threshold if it has one."""
    out = []
    if len(theirs) and len(ours):
        u, v, numbers, asking = _matrix(ours["asked"]), _matrix(theirs["vector"]), theirs["number"].to_numpy(), ours["query"].to_numpy()
        least = ours["least"].astype(float).fillna(-np.inf).to_numpy()
        for rows in slices(len(u), len(v)):
            rough = u[rows] @ v.T
            slack = 2 * 10.0**-DIGITS + 1e-9 * (1 + max(rough.max(), -rough.min()))
            limit = least[rows] - slack
            many = np.flatnonzero((rough >= limit[:, None]).sum(axis=1) > 4 * k)
            if len(many):
                limit[many] = np.maximum(limit[many], np.partition(rough[many], -k, axis=1)[:, -k] - slack)
            of, at = np.nonzero(rough >= limit[:, None])
            exact = np.zeros(len(at))
            for d in range(u.shape[1]):
                exact = exact + u[rows][of, d] * v[at, d]
            ends = np.searchsorted(of, np.arange(rough.shape[0] + 1))
            kept = np.ones(len(at), bool)
            for i in np.flatnonzero(np.diff(ends) > 4 * k):
                own = slice(ends[i], ends[i + 1])
                kept[own] = False
                kept[ends[i] + best(exact[own], numbers[at[own]], k)] = True
            out.append(pd.DataFrame({"query_id": asking[rows][of[kept]], "chunk_no": numbers[at[kept]], "score": exact[kept]}))
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=["query_id", "chunk_no", "score"])


def nearest(balls: Balls, queries: DataFrame, k: int) -> DataFrame:
    """query_id, chunk_no and score of pairs among which are the k best of each query (query_id, embedding), as rounded; ties to smaller numbers."""
    length = balls.pivots.shape[1]
    kind, named = (queries.schema["query_id"].dataType.simpleString(), balls.vectors.schema["number"].dataType.simpleString())
    asked = queries.where(_fine(F.col("embedding")) & (F.size("embedding") == length)).select(F.col("query_id").alias("query"), F.col("embedding").cast("array<double>").alias("asked"))

    def chosen(rows: DataFrame, first: bool, counted: bool = False) -> DataFrame:
        """rows (query, asked, least), once for each block of the balls that a query meets: in the first round the nearest, later those that reach its threshold. Or how many meet each block, `counted`."""
        number, pivots, radius, longest, blocks = balls.number, balls.pivots, balls.radius, balls.longest, balls.blocks

        def meets(u: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            near, size = u @ pivots.T, np.sqrt((u * u).sum(axis=1))[:, None]
            if first:
                take = near >= near.max(axis=1, keepdims=True)
                take &= np.cumsum(take, axis=1) == 1
            else:
                bound = np.minimum(near + size * radius, size * longest)
                bound = bound + 1e-9 * (1 + np.abs(bound)) + 10.0**-DIGITS  # thresholds are rounded
                take = bound >= least[:, None]
            return np.nonzero(take)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for rows in slices(whole.num_rows, max(len(pivots), length, int(blocks.sum()))):
                    b = whole.slice(rows.start, rows.stop - rows.start)
                    q, ball = meets(_matrix(b.column(1).to_numpy(zero_copy_only=False)), b.column(2).fill_null(-np.inf).to_numpy())
                    if counted:
                        ball, n = np.unique(ball, return_counts=True)
                        q = n
                    many = blocks[ball]
                    q, ball = np.repeat(q, many), np.repeat(ball, many)
                    block = np.arange(len(q)) - np.repeat(np.cumsum(many) - many, many)
                    cols = [pa.array(number[ball].astype(np.int32)), pa.array(block.astype(np.int32))]
                    if counted:
                        yield pa.RecordBatch.from_arrays([*cols, pa.array(q.astype(np.int64))], names=["ball", "block", "n"])
                        continue
                    for part in slices(len(q), length):
                        at = pa.array(q[part])
                        yield pa.RecordBatch.from_arrays([*(c.take(at) for c in b.columns), *(c[part] for c in cols)], names=["query", "asked", "least", "ball", "block"])

        return rows.mapInArrow(run, "ball int, block int, n long" if counted else f"query {kind}, asked array<double>, least double, ball int, block int")

    def met(rows: DataFrame, first: bool) -> DataFrame:
        # A block that more than ASKERS queries ask is sent to several groups.
        crowd = chosen(rows, first, True).groupBy("ball", "block").agg(F.ceil(F.sum("n") / F.lit(ASKERS)).cast("int").alias("groups"))
        part = F.pmod(F.xxhash64("query"), F.col("groups")).cast("int").alias("part")
        ours = chosen(rows, first).join(crowd, ["ball", "block"]).select(F.col("ball").alias("b"), F.col("block").alias("k"), part, "query", "asked", "least")
        theirs = balls.vectors.join(crowd, ["ball", "block"]).withColumn("p", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).select("ball", "block", "p", "number", "vector")
        return theirs.groupBy("ball", "block", "p").cogroup(ours.groupBy("b", "k", "part")).applyInPandas(lambda a, b: meet(a, b, k), f"query_id {kind}, chunk_no {named}, score double")

    unknown = asked.withColumn("least", F.lit(None).cast("double"))
    if balls.blocks.sum() == 1:  # no threshold can spare anything
        return met(unknown, False)
    first = top_k(met(unknown, True).withColumn("score", F.bround("score", DIGITS)), k, None)
    least = first.where(F.col("rank") == k).select(F.col("query_id").alias("query"), F.col("score").alias("least"))
    return met(asked.join(least, "query", "left").select("query", "asked", "least"), False)
