import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from lakewarden.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, score int"


def exact(ids, x, every=20, k=20):
    out = {}
    for i, q in zip(ids, x):
        if i % every == 0:
            s = (x * q).sum(axis=1)
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
            out[int(i)] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_ties_copies_and_unusable_vectors(spark):
    r = np.random.default_rng(1)
    base = r.normal(size=(30, 8)).astype(np.float32)
    x = base[r.integers(0, 30, 400)]
    x[:150] = base[0]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    bad = [(1000, None, 1), (1020, [0.0] * 8, 1), (1040, [float("nan")] + [1.0] * 7, 1), (1060, [None] + [1.0] * 7, 1), (1080, [float("inf")] + [1.0] * 7, 1), (None, [1.0] * 8, 1), (1100, [1.0] * 7, 1), (1120, [], 1)]
    got = found(vectors.nearest(spark.createDataFrame(rows + bad + rows[:3], SCHEMA)))
    assert got.pop(1100, []) == []  # alone with its length
    want = exact(np.arange(400), x.astype(float))
    assert got.keys() == want.keys()
    for q in want:
        assert [v for v, _ in got[q]] == [v for v, _ in want[q]]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=0, atol=1e-12)


def test_recall(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(3000, 32)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = found(vectors.nearest(spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], SCHEMA)))
    want = exact(np.arange(3000), x.astype(float))
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert got.keys() == want.keys() and hits >= 0.9 * 20 * len(want)


def test_recall_with_vectors_of_unequal_norms(spark):
    r = np.random.default_rng(4)
    x = (r.normal(size=(3000, 24)) * r.lognormal(0, 0.8, (3000, 1))).astype(np.float32)
    got = found(vectors.nearest(spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], SCHEMA)))
    want = exact(np.arange(3000), x.astype(float))
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert got.keys() == want.keys() and hits >= 0.95 * 20 * len(want)


def test_each_length_is_searched_among_its_own(spark):
    r = np.random.default_rng(6)
    length = np.where(r.random(900) < 0.6, 8, np.where(r.random(900) < 0.5, 5, 12))
    x = [r.normal(size=n).astype(np.float32) for n in length]
    got = found(vectors.nearest(spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], SCHEMA)))
    for n in (5, 8, 12):
        ids = np.flatnonzero(length == n)
        want = exact(ids, np.array([x[i] for i in ids], float))
        hits = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
        assert hits >= (0.9 if n == 8 else 1.0) * sum(map(len, want.values()))


def test_recall_of_the_registered_query_over_a_whole_table(spark):
    sf = "/root/testdata/sf0.1"
    t = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").toPandas()
    got, want = found(vectors.op2_posting_lists(spark, sf)), exact(t["vec_id"].to_numpy(), np.stack(t["embedding"]).astype(float))
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert got.keys() == want.keys() and hits >= 0.95 * sum(map(len, want.values()))
    score = {q: dict(v) for q, v in want.items()}
    assert all(abs(s - score[q].get(v, s)) < 1e-12 for q, pairs in got.items() for v, s in pairs)


def test_few_rows_and_none(spark):
    assert vectors.nearest(spark.createDataFrame([], SCHEMA)).count() == 0
    assert vectors.nearest(spark.createDataFrame([(0, [1.0, 0.0], 1)], SCHEMA)).count() == 0
    two = found(vectors.nearest(spark.createDataFrame([(0, [1.0, 0.0], 1), (1, [0.5, 0.5], 1)], SCHEMA)))
    assert two == {0: [(1, 0.5)]}


def test_lists_are_balanced_and_the_graph_finds_them():
    r = np.random.default_rng(3)
    x = r.normal(size=(6000, 16))
    index = vectors.build(x, 20)
    ids, _ = vectors.walk(index, x[:200], 32)
    nearest = np.argmin(((x[:200, None] - index.centroids[None]) ** 2).sum(axis=2), axis=1)
    assert len(index.centroids) >= 256 and np.mean(ids[:, 0] == nearest) > 0.9


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    base, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{sf}/documents.parquet"), {}
    out["input"] = docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(str(base / name))
        out[name] = docs = spark.read.parquet(str(base / name))
    return out


def test_stages(stages):
    from collections import Counter

    from lakewarden.llm import pii

    columns = stages["input"].columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dup", "pii", "mixing", "packing"]
    assert all(stages[n].columns == columns for n in ("quality", "near_dup", "pii", "mixing"))
    n = {k: v.count() for k, v in stages.items()}
    assert n["input"] > n["quality"] > n["near_dup"] == n["pii"] > 0
    assert all(not pii.base_spans(r["text"]) for r in stages["pii"].collect())
    mixed = Counter(r["doc_id"] for r in stages["mixing"].collect())
    packed = Counter(r["doc_id"] for r in stages["packing"].where("start = 0").collect())
    assert mixed == packed and max(mixed.values()) <= 3


def test_near_dup_stage_equals_all_pairs(stages):
    from test_near_dup import brute

    docs = sorted((r["doc_id"], r["text"]) for r in stages["quality"].collect())
    want = [docs[i][0] for i, (_, root) in enumerate(brute([t for _, t in docs], k=5)) if root == i]
    assert sorted(r["doc_id"] for r in stages["near_dup"].collect()) == want


def test_run_equals_stages(spark, sf, stages):
    key = ["doc_id", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).select(*key).collect())) == sorted(map(tuple, stages["packing"].select(*key).collect()))


def test_all_are_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))


@pytest.mark.parametrize("n", [20_000, 80_000])
def test_probes_follow_the_recall_target(n):
    """Unrelated vectors: lists read grow with the table, so that recall stays; the sample has fewer vectors than the table."""
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = vectors.build(vectors.lifted(x[: n // 4], 1.0, False), 60)

    def near(q):
        s = x[q] @ x.T
        s[np.arange(len(q)), q] = -9
        return np.argpartition(s, -20, axis=1)[:, -20:]

    q = rng.permutation(n)
    ratio, probes = vectors.tuned(index, vectors.lifted(x[q[:200]], 1.0, True), [vectors.lifted(x[i], 1.0, False) for i in near(q[:200])], 0.95)
    other = q[200:350]
    read = [set(r) for r in vectors.chosen(index, vectors.lifted(x[other], 1.0, True), ratio, probes, vectors.LEAST)]
    homes = vectors.chosen(index, vectors.lifted(x[near(other).ravel()], 1.0, False), vectors.BOUNDARY, vectors.COPIES)
    assert np.mean([not read[i // 20].isdisjoint(h) for i, h in enumerate(homes)]) >= 0.93
    assert np.mean([len(r) for r in read]) < 0.8 * len(index.centroids)


def test_two_large_lengths_and_an_exact_search(spark, monkeypatch):
    monkeypatch.setattr(vectors, "FEW", 300)
    rng = np.random.default_rng(6)
    x = [rng.normal(size=8 if i % 2 else 6) for i in range(1600)] + [rng.normal(size=3) for _ in range(50)]
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], SCHEMA)
    plans = {True: found(vectors.nearest(df, exact=True)), False: found(vectors.nearest(df))}
    hits = total = 0
    for q in range(0, len(x), 20):
        same = [i for i, v in enumerate(x) if i != q and len(v) == len(x[q])]
        want = sorted(same, key=lambda i: (-sum(x[q] * x[i]), i))[:20]
        assert [i for i, _ in plans[True][q]] == want
        total += len(want)
        hits += len({i for i, _ in plans[False][q]} & set(want))
    assert hits >= 0.95 * total


def test_the_graph_has_each_centroids_nearest():
    rng = np.random.default_rng(3)
    index = vectors.build(rng.normal(size=(9000, 5)), 12)
    c = index.centroids
    d = ((c[:, None] - c[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    assert len(c) > 512
    assert (np.sort(np.take_along_axis(d, index.graph[:, : vectors.DEGREE], axis=1), axis=1) == np.sort(d, axis=1)[:, : vectors.DEGREE]).mean() > 0.999
