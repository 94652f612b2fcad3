import random
import re
from itertools import permutations

from lakewarden.llm import interactions

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, labels):
    """Every order, filter by filter, over lists of documents."""
    good, toxic = {d for d, q, _ in labels if d is not None and q == 1}, {d for d, _, t in labels if d is not None and t == 1}
    firsts = {}
    for d, t, _ in docs:
        if d is not None:
            firsts[t or ""] = min(firsts.get(t or "", d), d)

    def fails(d, t):
        t, w = t or "", WORDS.findall(t or "")
        found = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t))}
        return {x for x, bad in found.items() if bad} | ({"E"} if d is not None and firsts[t] < d else set())

    out, total = {}, {}
    for part in {p or "" for _, _, p in docs}:
        rows = [(d, fails(d, t)) for d, t, p in docs if (p or "") == part]
        for order in permutations("ABCDE"):
            left = rows
            for step, x in enumerate(order, 1):
                gone, stay = [r for r in left if x in r[1]], [r for r in left if x not in r[1]]
                out[part, "".join(order), step] = [len(stay), len(gone), sum(x in f for _, f in rows) - len(gone), sum(f == {x} for _, f in rows), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)]
                total[part, x] = total.get((part, x), 0) + len(gone)
                left = stay
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def found(spark, docs, labels, more=""):
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string" + more).repartition(3)
    rows = interactions.audit(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    out = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for r in rows}
    assert len(out) == len(rows)
    return out


def text(rng):
    words = [rng.choice("abcdefgh") + str(rng.randrange(rng.choice([3, 400]))) for _ in range(rng.choice([5, 99, 100, 150]))]
    t = " ".join(words)
    return t.upper() if rng.random() < 0.2 else t + rng.choice(["", "", " 5%", " #x"])


def test_all_orders_against_lists(spark):
    rng = random.Random(7)
    docs = [(i, text(rng), rng.choice(["en", "de"])) for i in range(60)]
    docs += [(100 + i, docs[rng.randrange(60)][1], rng.choice(["en", "de", None, ""])) for i in range(25)]
    labels = [(i, rng.randrange(2), rng.randrange(2)) for i in range(0, 125, 2)]
    assert found(spark, docs, labels) == brute(docs, labels)


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(20_000))
    docs = [(1, None, "en"), (2, "", None), (3, "  \n", ""), (None, long, "en"), (None, long, "en"), (5, long, "en"), (5, long, "en"), (6, long, "fr"), (None, None, None), (9, long, "FR")]
    labels = [(5, 1, 0), (5, 0, 1), (6, None, None), (None, 1, 1), (1, 1, None), (9, 2, 1)]
    got = found(spark, docs, labels)
    assert got == brute(docs, labels)
    assert {p for p, _, _ in got} == {"", "en", "fr", "FR"} and len(got) == 4 * 600
    assert got["fr", "ABCDE", 5][:2] == (0, 1) and got["en", "EABCD", 1][1] == 0


def test_thresholds_exactly(spark):
    exactly = " ".join(f"a{i}" for i in range(80)) + " a0" * 20  # 100 words, 80 of them different
    one_less = " ".join(f"a{i}" for i in range(79)) + " a0" * 21
    capitals, more = "A" + "b" * 9, "AA" + "b" * 9
    docs = [(1, exactly, "x"), (2, one_less, "y"), (3, capitals, "z"), (4, more, "v"), (5, "ÄÄÄ", "w")]
    got = found(spark, docs, [])
    assert got == brute(docs, [])
    assert [got["x", "ABCDE", s][1] for s in (1, 2)] == [0, 0] and got["y", "BACDE", 1][1] == 1
    assert (got["z", "CABDE", 1][1], got["v", "CABDE", 1][1], got["w", "CABDE", 1][1]) == (0, 1, 0)


def test_no_rows_and_clashing_names(spark):
    labels = [(1, 1, 1)]
    assert found(spark, [], labels) == {}
    docs = [(1, "x", "en", 5, "b", True), (2, "x", "en", 6, None, False)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, part long, digest string, A boolean")
    rows = interactions.audit(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).where("filter_order = 'EABCD' and step = 1").collect()
    assert [(r["part"], r["kept"], r["removed"], r["good_lost"]) for r in rows] == [("en", 1, 1, 0)]
