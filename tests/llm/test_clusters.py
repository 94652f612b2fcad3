import math
import random
from hashlib import sha256

import numpy as np
import pytest

from lakewarden.llm import clusters, registry


def brute(rows, k=8, rounds=10, seed=3, length=64):
    """All distances in all rounds, in Python's integers."""
    kept = [(i, tuple(math.floor(1024 * x) for x in v)) for i, v in rows if v is not None and len(v) == length and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted((sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    c = [v for _, v in start]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, x)), j) for j, x in enumerate(c))

    for _ in range(rounds):
        at = [nearest(v)[1] for _, v in kept]
        for j in range(len(c)):
            own = [v for (_, v), a in zip(kept, at) if a == j]
            if own:
                c[j] = tuple(sum(col) // len(own) for col in zip(*own))
    done = [(i, *nearest(v)[::-1]) for i, v in kept]
    per = {j: sum(d for _, a, d in done if a == j) for j in range(len(c))}
    marks = [sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    return sorted(((i, j, d, per[j], sum(per.values()), marks[j]) for i, j, d in done), key=repr)


def found(df, **how):
    return sorted((tuple(r) for r in clusters.summed(df, **how).collect()), key=repr)


def test_the_query_equals_all_distances(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = sorted((tuple(r) for r in registry.QUERIES["op12_exponion"](spark, sf).collect()), key=repr)
    assert got == brute(rows)


@pytest.mark.parametrize("seed", range(3))
def test_ties_on_a_grid(spark, seed):
    # Points of a coarse grid: many equal distances, equal vectors and equal centroids.
    rng = random.Random(seed)
    rows = [(i, [rng.choice([0.0, 1.0, 2.0]) / 1024 for _ in range(3)]) for i in range(150)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    assert found(df, k=12, length=3, rounds=4, seed=seed) == brute(rows, 12, 4, seed, 3)


def test_odd_rows(spark):
    rng = random.Random(4)
    ok = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(30)]
    odd = [(50, None), (51, []), (52, [1.0, 2.0]), (53, [1.0, None, 0.0, 0.0]), (54, [1.0, float("nan"), 0.0, 0.0]), (55, [float("inf"), 0.0, 0.0, 0.0]), (None, [0.5] * 4), (None, None)]
    rows = ok + odd + ok[:3] + [(7, [0.25] * 4)]  # repeated rows, a repeated vec_id with another vector
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, cluster string, n int")
    assert found(df, k=5, length=4, rounds=6) == brute(rows, 5, 6, 3, 4)
    huge = spark.createDataFrame([(1, [1e30, 0.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert [r[:3] for r in found(huge, length=2)] == [(2, 0, 0)]


def test_few_and_no_rows(spark):
    two = spark.createDataFrame([(4, [1.0, 2.0]), (9, [3.0, -1.0])], "vec_id long, embedding array<float>")
    assert found(two, length=2) == brute([(4, [1.0, 2.0]), (9, [3.0, -1.0])], length=2)
    assert clusters.summed(two).collect() == []
    assert set(clusters.summed(two).columns) == {"vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"}
    with pytest.raises(ValueError):
        clusters.clusters(two, k=clusters.MOST + 1)


def test_bounds_hold_and_save_distances():
    rng = np.random.default_rng(1)
    centres = rng.integers(-20_000, 20_000, (40, 8))
    x = (centres[rng.integers(0, 40, 4000)] + rng.integers(-300, 300, (4000, 8))).astype(np.int64)
    c, before, looked = x[:40].copy(), None, 0
    at, u, l = np.zeros(len(x), np.int64), np.full(len(x), np.inf), np.zeros(len(x))
    for i in range(8):
        if before is not None:
            u, l = clusters.moved(before, c, at, u, l)
        at, u, l, n = clusters.Search(c).assign(x, at, u, l)
        d = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
        assert (at == d.argmin(axis=1)).all()
        own = np.sqrt(d[np.arange(len(x)), at])
        d[np.arange(len(x)), at] = np.iinfo(np.int64).max
        assert (u >= own - 1e-6).all() and (l <= np.sqrt(d.min(axis=1)) + 1e-6).all()
        looked += n if i else 0
        before = c
        c = np.array([x[at == j].sum(axis=0) // max(1, (at == j).sum()) if (at == j).any() else c[j] for j in range(len(c))])
    assert looked < 7 * len(x) * len(c) / 4
