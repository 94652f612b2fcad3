import random

import duckdb
import numpy as np
import pytest

from lakewarden.llm import near_dup as nd
from lakewarden.llm import text as tx
from lakewarden.llm.graphs import components


def brute(texts, k=4, percent=80):
    """component of each position, from all pairs of sets."""
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    at = list(range(len(sets)))

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                at[b] = a
    return [(len(s), root(i)) for i, s in enumerate(sets)]


def corpus(seed, n):
    """Texts with chains of near copies, exact copies, short texts and a large group."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [" ".join(r.choices(vocabulary, k=r.randint(1, 60))) for _ in range(n // 3)]
    base = " ".join(r.choices(vocabulary, k=80)).split()
    while len(texts) < n:
        words = base[:] if r.random() < 0.6 else r.choice(texts).split()
        for _ in range(r.randint(0, 4)):
            words[r.randrange(len(words))] = r.choice(vocabulary)
        texts.append(" ".join(words).upper() if r.random() < 0.2 else " ".join(words))
    r.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_all_pairs(spark, seed):
    texts = corpus(seed, 300) + [None, "", " \t\n", "one", "One", "one two three", "x y a b c", "ONE two THREE"]
    df = spark.createDataFrame([(i, t, "a", "b") for i, t in enumerate(texts)], "doc_id long, text string, component_id string, n string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in nd.near_duplicates(df).collect()}
    assert got == dict(enumerate(brute(texts)))


def test_a_group_larger_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(nd, "MEET", 16)
    monkeypatch.setattr(nd, "BLOCK", 8)
    texts = corpus(5, 200)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in nd.near_duplicates(df).collect()}
    assert got == dict(enumerate(brute(texts)))


def test_very_long_repeated_and_nameless_rows(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    df = spark.createDataFrame([(5, long), (9, long + " tail"), (9, long + " tail"), (None, long), (7, "other words stand here alone")], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"], r["kept"]) for r in nd.near_duplicates(df).collect())
    assert got == [(-1, 59997, None, False), (5, 59997, 5, True), (7, 2, 7, True), (9, 59998, 5, False), (9, 59998, 5, False)]


def test_empty_table(spark):
    assert nd.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_equals_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert sorted(map(tuple, nd.op3_near_dup(spark, sf).collect())) == sorted(con.sql(nd.OP3_SQL).fetchall())


def test_sketches_estimate_and_merge():
    r = np.random.default_rng(3)
    for n, share in ((500, 0.8), (500, 0.5), (40, 0.9), (3000, 0.3)):
        common = int(2 * n * share / (1 + share))
        x = r.integers(0, 1 << 63, 2 * n - common).astype(np.uint64)
        a, b = np.sort(x[:n]), np.sort(x[n - common :])
        ka, kb = nd.sketch(a), nd.sketch(b)
        j = nd.similarity(ka[None], kb[None], np.array([float(n)]), np.array([float(n)]))[0]
        assert abs(j - common / (2 * n - common)) < 0.13
        assert (np.maximum(ka, kb) == nd.sketch(np.unique(np.concatenate([a, b])))).all()


def test_words_are_split_at_ascii_white_space_only():
    assert tx.split(b"A\x0bb\x1cC") == [b"a", b"b\x1cc"] and tx.split(" \t É\u00a0x\n".encode()) == ["É\u00a0x".encode()]
    a, b = tx.shingle_sets([b"A\x0bb\x1cc", b"a b\x1cc  "], 4)
    assert a[0] == b[0] and a[1] == b[1]


@pytest.mark.parametrize("k", [1, 2, 3, 4, 5, 7])
def test_exact_sets_equal_tuples(k):
    r = random.Random(k)
    texts = [" ".join(r.choice("abc") for _ in range(r.randint(0, 12))).encode() for _ in range(200)]
    want = []
    for t in texts:
        w = t.split()
        want.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    got = tx.exact_sets(texts, k)
    hashed = tx.shingle_sets(texts, k)
    for i in range(200):
        assert len(got[i]) == len(hashed[i][0]) == len(want[i])
        for j in range(0, 200, 17):
            assert len(np.intersect1d(got[i], got[j])) == len(np.intersect1d(hashed[i][0], hashed[j][0])) == len(want[i] & want[j])
    assert tx.exact_sets([], k) == []


def test_words_that_collide_as_polynomials_are_not_linked(spark):
    # The Thue-Morse word and its complement have equal polynomial hashes modulo 2^64, whatever the odd base.
    morse = [bin(i).count("1") % 2 for i in range(4096)]
    a, b = ("".join("ab"[x ^ flip] for x in morse) for flip in (0, 1))
    df = spark.createDataFrame([(1, a), (2, b), (3, f"x {a} y z"), (4, f"x {b} y z")], "doc_id long, text string")
    got = {r["doc_id"]: (r["component_id"], r["kept"]) for r in nd.near_duplicates(df).collect()}
    assert got == {i: (i, True) for i in (1, 2, 3, 4)}


def test_groups_are_bounded_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK_BYTES", 2000)
    texts = corpus(6, 120)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in nd.near_duplicates(df).collect()}
    assert got == dict(enumerate(brute(texts)))
    sizes = {i: 700 for i in range(10)}
    assert nd._runs(list(range(4)), sizes) == [[0], [1], [2], [3]]


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 100), (50, 51)], "u long, v long")
    assert {r["node"]: r["component"] for r in components(edges).collect()} == {i: 0 for i in range(1, 31)} | {51: 50}
