import random
from hashlib import sha256

import pytest

from lakewarden.llm import registry, repeats


def brute(rows, window=13):
    """(doc_id, words, removed, kept text) of each row, window by window."""
    first = {}
    words = [(t or "").encode().split() for _, t in rows]
    for (d, _), w in zip(rows, words):
        for i in range(len(w) - window + 1 if d is not None else 0):
            s = tuple(w[i : i + window])
            first[s] = min(first.get(s, d), d)
    out = []
    for (d, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - window + 1 if d is not None else 0):
            if first[tuple(w[i : i + window])] < d:
                gone |= set(range(i, i + window))
        out.append((d, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out, key=repr)


def found(spark, rows, parts=3):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    return sorted((tuple(r) for r in repeats.without_repeats(df).collect()), key=repr)


def test_edges_of_repeats_against_windows(spark):
    # Few different words, passages at all offsets, in documents that cut them at different places.
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(70)]
    rows = []
    for d in rng.sample(range(1000), 60):
        a = rng.randrange(50)
        middle = passage[a : a + rng.randrange(5, 60)]
        rows.append((d, " ".join([rng.choice("xyz") for _ in range(rng.randrange(20))] + middle + [rng.choice("xyz") for _ in range(rng.randrange(20))])))
    assert found(spark, rows) == brute(rows)


def test_small_alphabets(spark):
    rng = random.Random(9)
    rows = [(d, " ".join(rng.choice("ab") for _ in range(rng.randrange(80)))) for d in range(60)]
    want = brute(rows)
    assert any(0 < r[2] < r[1] for r in want)
    assert found(spark, rows) == want


def test_odd_rows(spark):
    copy, other = " ".join(f"w{i}" for i in range(40)), " ".join(f"v{i}" for i in range(40))
    rows = [(5, copy), (5, copy), (9, copy), (2, other), (2, copy + " " + other), (None, copy), (None, None), (7, None), (8, ""), (10, "  \t\n "), (11, "one two")]
    rows += [(12, copy.replace(" ", "\x0b\n")), (13, copy.upper()), (14, copy.replace("w", "w "))]  # other white space, other case, no white space
    rows += [(20, " ".join(["again"] * 300)), (21, " ".join(["again"] * 13)), (22, " ".join(["again"] * 12))]
    got = found(spark, rows)
    assert got == brute(rows)
    assert (20, 300, 0, " ".join(["again"] * 300)) in got and (21, 13, 13, "") in got and (22, 12, 0, " ".join(["again"] * 12)) in got


def test_a_long_text_and_many_copies(spark):
    rng = random.Random(3)
    long = " ".join(rng.choice(["a", "b", "c", "d", "e"]) + str(rng.randrange(30)) for _ in range(150_000))
    words = long.split()
    rows = [(1, long), (2, " ".join(words[1000:1100])), (3, " ".join(["z"] + words[70_000:70_020] + ["z"]))] + [(10 + i, " ".join(words[500:540])) for i in range(400)]
    assert found(spark, rows) == brute(rows)


def test_windows_of_other_sizes(spark):
    rng = random.Random(2)
    rows = [(d, " ".join(rng.choice("abc") for _ in range(30))) for d in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in repeats.without_repeats(df, window=6, gram=3).collect()), key=repr)
    assert got == brute(rows, 6)


def test_no_rows_and_clashing_names(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, key string, spans string")
    assert repeats.without_repeats(empty).collect() == []
    copy = " ".join(f"w{i}" for i in range(20))
    rows = [(1, copy, "k", "s", 4), (2, copy, None, "t", 5)]
    df = spark.createDataFrame(rows, "doc_id int, text string, seed string, spans string, least long")
    assert sorted(r[2] for r in repeats.without_repeats(df).collect()) == [0, 20]
    assert [(r["doc_id"], [tuple(s) for s in r["spans"]] != []) for r in repeats.removed_spans(df).collect()] == [(2, True)]


def test_segments_share_out_all_windows():
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcdef") for _ in range(n)).encode() for n in (0, 5, 12, 13, 14, 300)]
    s = repeats.segments(texts)
    windows = {(t, i) for t, a, b in zip(s.text, s.first, s.last) for i in range(a, b + 1)}
    assert windows == {(t, i) for t, x in enumerate(texts) for i in range(len(x.split()) - 12)}
    assert sum(s.last - s.first + 1) == len(windows)


@pytest.mark.parametrize("parts", [1, 40])
def test_spans_do_not_depend_on_partitions(spark, parts):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(d, f"a{d} b{d} " + passage + f" c{d}") for d in range(30)]
    got = found(spark, rows, parts)
    assert [r[2] for r in sorted(got)] == [0] + [60] * 29


def test_the_query(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in registry.QUERIES["op11_seed_extend"](spark, sf).collect()), key=repr)
    assert got == sorted(((d, n, m, sha256(t.encode()).hexdigest()) for d, n, m, t in brute(rows)), key=repr)
