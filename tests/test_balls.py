"""Exact vector search by balls against all products."""

import numpy as np
import pytest

from lakewarden.operators import balls, retrieval


def brute(queries, passages, k):
    out = set()
    for q, u in queries:
        scored = []
        for p, v in passages:
            if u is not None and v is not None and len(u) == len(v) and None not in (*u, *v) and np.isfinite([*u, *v]).all():
                s = 0.0
                for a, b in zip(u, v):
                    s += a * b
                scored.append((-float(balls.rounded(s)), p))
        out |= {(q, p, -s, i) for i, (s, p) in enumerate(sorted(scored)[:k], 1)}
    return out


def found(spark, queries, passages, k, **how):
    q = spark.createDataFrame(queries, "query_id long, embedding array<double>")
    p = spark.createDataFrame(passages, "chunk_no long, embedding array<double>").repartition(3)
    return {(r["query_id"], r["chunk_no"], r["score"], r["rank"]) for r in retrieval.vector_search(q, p, k, **how).collect()}


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.fixture(params=[64, 8192])
def blocks(request, monkeypatch):
    """Many balls and blocks, or one."""
    monkeypatch.setattr(balls, "BLOCK", request.param)


def test_groups_copies_and_ties(spark, blocks):
    rng = np.random.default_rng(2)
    centres = unit(rng.normal(size=(12, 8)))
    x = unit(centres[rng.integers(0, 12, 600)] + rng.normal(size=(600, 8)) * 0.02)
    x[100:180] = x[5]  # copies: more than four times k
    passages = [(int(i), v.tolist()) for i, v in zip(rng.permutation(600), x)]
    queries = passages[:40] + [(1000 + i, x[5].tolist()) for i in range(3)]
    assert found(spark, queries, passages, 7) == brute(queries, passages, 7)


@pytest.mark.parametrize("k", [1, 50, 500])
def test_unrelated_vectors_and_more_than_there_are(spark, blocks, k):
    rng = np.random.default_rng(k)
    passages = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(200, 5)) * rng.gamma(2, size=(200, 1)))]
    queries = passages[::20]
    assert found(spark, queries, passages, k) == brute(queries, passages, k)


def test_odd_vectors(spark):
    nan = float("nan")
    passages = [(1, [1.0, 0.0]), (2, None), (3, []), (4, [1.0, None]), (5, [nan, 1.0]), (6, [1.0, 2.0, 3.0]), (7, [0.0, 0.0]), (8, [-1.0, 0.0]), (9, [1.0, 0.0])]
    queries = [(10, [1.0, 0.0]), (11, None), (12, [1.0, 1.0, 1.0]), (13, [0.0, 0.0]), (14, []), (15, [nan, 0.0]), (16, [1.0] * 5)]
    got = found(spark, queries, passages, 3)
    assert got == brute([q for q in queries if q[0] != 14], passages, 3)
    assert found(spark, [], passages, 3) == found(spark, queries, [], 3) == set()
    assert {r[:2] for r in found(spark, queries, passages, 3, floor=0.5)} == {(10, 1), (10, 9), (12, 6)}


def test_many_queries_of_one_block(spark, blocks, monkeypatch):
    monkeypatch.setattr(balls, "ASKERS", 7)
    rng = np.random.default_rng(5)
    passages = [(i, v.tolist()) for i, v in enumerate(unit(rng.normal(size=(90, 3))))]
    assert found(spark, passages, passages, 4) == brute(passages, passages, 4)


def test_bounds_rule_balls_out(spark):
    rng = np.random.default_rng(7)
    centres = unit(rng.normal(size=(30, 16)))
    x = unit(centres[np.arange(1500) % 30] + rng.normal(size=(1500, 16)) * 0.01)
    p = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "chunk_no long, embedding array<double>")
    held = balls.build_balls(p, 16, pivots=30, block=100)
    u = x[:60]
    reach = np.minimum(u @ held.pivots.T + held.radius, held.longest)
    kth = np.sort(u @ x.T, axis=1)[:, -5]
    assert (reach >= kth[:, None] - 1e-4).sum() <= 2 * len(u)  # of 30 balls a query meets one or two
    for i, v in zip(held.vectors.select("ball").distinct().collect(), held.number):
        assert i["ball"] in held.number
    rows = {r["number"]: (r["ball"], r["block"]) for r in held.vectors.collect()}
    assert len(rows) == 1500
    for n, (ball, _) in rows.items():
        at = list(held.number).index(ball)
        assert np.linalg.norm(x[n] - held.pivots[at]) <= held.radius[at] + 1e-12


def test_rounding_is_that_of_the_expression(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(1)
    values = [0.00005, 0.00015, -0.00005, 0.99995, 1.00005, 0.12345, 2.5e-5, 1e-300, 123456.78905, *rng.normal(size=300).tolist(), *(np.round(rng.normal(size=300), 5)).tolist()]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", F.bround("v", 4).alias("r")).collect()
    assert all(float(balls.rounded(r["v"])) == r["r"] for r in got)


def test_no_cross_join(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    plan = retrieval.vector_search(e.selectExpr("vec_id AS query_id", "embedding"), e.selectExpr("vec_id AS chunk_no", "embedding"), 3)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_tasks_hold_and_pass_on_a_bounded_part_at_a_time(spark, monkeypatch):
    """Many queries in one batch that meet many balls, and a group of many queries."""
    import tracemalloc

    import pandas as pd
    import pyarrow as pa

    made, kept = [], {}
    frame = type(spark.range(1))

    def noted(self, run, schema, *rest, go=frame.mapInArrow):
        made.append((run, schema))
        return go(self, run, schema, *rest)

    rng = np.random.default_rng(9)
    monkeypatch.setattr(balls, "BLOCK", 8)
    monkeypatch.setattr(frame, "mapInArrow", noted)
    passages = [(i, v.tolist()) for i, v in enumerate(unit(rng.normal(size=(900, 16))))]
    found(spark, passages[:2], passages, 3)
    x = unit(rng.normal(size=(6000, 16)))
    for run, schema in made:
        if schema.startswith("query"):
            columns = {"query": pa.array(range(6000)), "asked": pa.array(list(x)), "least": pa.nulls(6000, pa.float64())}
            out = list(run(iter([pa.RecordBatch.from_pydict(columns)])))
            assert max(b.num_rows for b in out) * 16 <= 1 << 20
            kept[schema, len(kept)] = sum(b.num_rows for b in out)
    assert min(kept.values()) >= 6000 and max(kept.values()) > 6000 * 30

    theirs = pd.DataFrame({"number": range(8000), "vector": list(rng.normal(size=(8000, 4)))})
    ours = pd.DataFrame({"query": range(2000), "asked": list(rng.normal(size=(2000, 4))), "least": [None] * 2000})
    tracemalloc.start()
    got = balls.meet(theirs, ours, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20  # products of all take 128 MB
    v, u = np.stack(theirs["vector"]), np.stack(ours["asked"])
    assert got.groupby("query_id").size().min() == 3 and got["score"].sum() == pytest.approx(np.sort(u @ v.T, axis=1)[:, -3:].sum(), rel=1e-6)
    ours["least"] = np.sort(u @ v.T, axis=1)[:, -1] - 1e-3
    assert set(got.loc[got.groupby("query_id")["score"].idxmax(), "chunk_no"]) <= set(balls.meet(theirs, ours, 3)["chunk_no"])
