import hashlib
import random
import re

import pytest

from lakewarden.llm import pii

BASE = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def brute(t):
    out = []
    for k, p in enumerate(BASE):
        for m in re.finditer(p, t):
            s, d = m.group(), re.sub("[^0-9]", "", m.group())
            if [True, k == 1 and all(int(x) <= 255 for x in s.split(".")), 14 <= len(d) <= 19 and pii.luhn(d), 10 <= len(d) <= 15][k]:
                out.append((m.start(), m.end(), k))
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_base_equals_patterns():
    r = random.Random(4)
    parts = ["4532015112830366", "1.2.3.4.5.6.7.8", "+1 (555) 123-4567", "a@b.c@d.e", "300.1.1.1", "x@y", "é@é.fr", "4532 0151-1283 0366", "0007.1.02.3"]
    for _ in range(3000):
        t = " ".join("".join(r.choice("1234509..@@a-b+ ()%é\n") for _ in range(r.randint(0, 25))) if r.random() < 0.6 else r.choice(parts) for _ in range(3))
        assert pii.base_spans(t) == brute(t), t


@pytest.mark.parametrize("text", ["1" * 200_000, "a" * 200_000 + "@", "@" * 200_000, "1." * 100_000, "+" * 100_000, "1 " * 100_000, "a.b@" * 50_000])
def test_long_runs_take_linear_time(text):
    pii.base_spans(text)


@pytest.fixture(scope="module")
def weights():
    r = random.Random(1)
    texts = []
    for i in range(150):
        texts.append(f"word user{i}.x@mail{i % 9}.example.com then {r.randint(1, 255)}.{r.randint(0, 255)}.7.{i % 250} and +1 ({200 + i}) 555-{1000 + i} or order {r.randint(10**5, 10**11)} in {1900 + i}")
    return pii.train(texts)


def test_field_adds_what_patterns_miss(weights):
    base, every = pii.all_spans("call (988) 555-2485 now, mail a.b@c.org", weights)
    assert set(base) <= set(every) and (5, 19, 3) in every and (5, 19, 3) not in base
    assert pii.all_spans("order 404189497460 of 1987, 25 boxes", weights)[1] == []


def test_expected_and_best_cut_equal_all_cuts():
    import numpy as np

    segments = [(0, 1, -1), (0, 2, 0), (0, 3, 1), (1, 2, -1), (1, 3, 2), (2, 3, -1)]
    scores = np.array([0.3, 0.9, -0.2, 0.1, 1.4, 0.2])
    cuts = [[0, 3, 5], [0, 4], [1, 5], [2]]
    weight = [np.exp(scores[c].sum()) for c in cuts]
    expected = np.zeros(6)
    for c, w in zip(cuts, weight):
        expected[c] += w / sum(weight)
    assert np.allclose(pii._expected(3, segments, scores), expected)
    best = cuts[int(np.argmax(weight))]
    halves = [(segments[:3], scores[:3]), (segments[3:], scores[3:])]
    assert pii.decode(3, halves) == [segments[i] for i in best if segments[i][2] >= 0]


def test_candidates_are_all_plausible_segments():
    r = random.Random(7)
    for _ in range(400):
        text = "".join(r.choice("0123456789012345678901234567899  .-+()@ab") for _ in range(r.randint(1, 60)))
        edges, segments, rows = pii.lattice(text, 0, len(text))
        n, want = len(edges) - 1, []
        for i in range(n):
            want.append((i, i + 1, -1))
            c = text[edges[i]]
            if not (c.isalnum() or c in "+(") or text[max(edges[i] - 1, 0) : edges[i]].isalnum():
                continue
            for j in range(i + 1, min(n, i + pii.LONGEST) + 1):
                s = text[edges[i] : edges[j]]
                if s[-1].isalnum() and not text[edges[j] : edges[j] + 1].isalnum():
                    d = sum(x.isdigit() for x in s)
                    want += [(i, j, k) for k in range(4) if pii._PLAUSIBLE_DIGITS[k][0] <= d <= pii._PLAUSIBLE_DIGITS[k][1] and pii._PLAUSIBLE[k].fullmatch(s)]
        assert segments == want and len(rows) == len(want)
        for (i, j, k), row in zip(segments, rows.tolist()):
            if k >= 0:
                names = pii._whole(text[edges[i] : edges[j]], text[max(edges[i] - 1, 0) : edges[i]], text[edges[j] : edges[j] + 1])
                assert row == pii._numbers([f"{k}:{x}" for x in names])


def test_spans_do_not_depend_on_steps_and_overlap_nothing(weights, monkeypatch):
    r = random.Random(9)
    texts = [" ".join(r.choice(["4532015112830366", "10.1.2.3", "(212) 555-1234", "+1 (212) 555-1234", "77", "a@b.org", str(r.randint(0, 10**12))]) for _ in range(80)) for _ in range(20)]
    want = [pii.all_spans(t, weights) for t in texts]
    for base, every in want:
        added = [s for s in every if s not in base]
        assert all(not (a < y and x < b) for a, b, _ in added for x, y, _ in base)
    monkeypatch.setattr(pii, "STEP", 7)
    assert [pii.all_spans(t, weights) for t in texts] == want


def test_a_megabyte_of_numbers(weights):
    import time
    import tracemalloc

    r, begin = random.Random(2), time.process_time()
    text = " ".join(str(r.randint(0, 99999)) for _ in range(180_000))[:1_000_000]
    pii.all_spans(text[:250_000], weights)
    tracemalloc.start()
    pii.all_spans(text[500_000:520_000], weights)
    assert tracemalloc.get_traced_memory()[1] < 30_000_000
    tracemalloc.stop()
    part = time.process_time() - begin
    begin = time.process_time()
    pii.all_spans(text, weights)
    assert time.process_time() - begin < 6 * part + 2 and part < 30


def test_registered_query_equals_patterns(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = pii.op10_pii(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        base = brute(texts[r["doc_id"]] or "")
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(s[2] == k for s in base) for k in range(4)]
        assert r["base_sha256"] == hashlib.sha256(pii.written(base).encode()).hexdigest()
        assert set(pii.written(base).split(",")) <= set(r["spans"].split(","))


def test_detected_and_redacted(spark, weights):
    texts = [None, "", "plain words", "漢 a@b.org 10.0.0.1 x 4532015112830366", "漢 a@b.org 10.0.0.1 x 4532015112830366", "x " * 60_000 + "a@b.org"]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)] + [(None, "+44 20 7946 0958", "s")], "doc_id long, text string, spans string")
    got = {r["doc_id"]: r for r in pii.detected(df, weights).collect()}
    assert got[3]["spans"] == "email:2:9,ip:10:18,card:21:37" and got[3]["base_sha256"] == hashlib.sha256(got[3]["spans"].encode()).hexdigest()
    assert (got[3]["n_email"], got[3]["n_ip"], got[3]["n_card"], got[3]["n_phone"]) == (1, 1, 1, 0)
    assert got[0]["spans"] == got[1]["spans"] == "" and got[0]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert got[5]["spans"] == "email:120000:120007" and got[None]["n_phone"] == 1
    out = {r["doc_id"]: r["text"] for r in pii.redacted(df, weights).collect()}
    assert out[0] is None and out[2] == "plain words" and out[3] == "漢 <EMAIL> <IP> x <CARD>"
    assert pii.detected(df.limit(0), weights).count() == 0


def test_odd_digits_do_not_crash(weights):
    pii.all_spans("²³.¹.1.2 ٣٤٥.1.1.1 1²3@é.com ²³.¹.111.222 11.22.33.٤4", weights)
