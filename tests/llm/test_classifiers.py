import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakewarden.llm import quality, toxicity
from lakewarden.llm.common import held_out

SCHEMA = "doc_id long, text string, lang string, source string, score string"


def made(n, seed=0):
    r = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = [r.choice(["sun", "sea", "hill", "tree", "rain", "road", "lamp", "door"]) + r.choice(["", "s", "ed"]) for _ in range(r.randint(5, 40))]
        toxic, bad = r.random() < 0.3, r.random() < 0.3
        if toxic:
            words.insert(r.randrange(len(words)), "grumf" + r.choice(["", "ly", "ing"]))
        if bad:
            words = [w + "!!" for w in words]
        docs.append((i, " ".join(words).upper() if bad else " ".join(words), "en", "s", "x"))
        labels.append((i, int(not bad), int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = made(800)
    extra = [(9001, None, None, None, None), (9002, "", "", "", ""), (9003, " \n", "", "", ""), (None, "sun sea", "", "", ""), (9004, "sun " * 50_000, "", "", ""), (5, docs[5][1], "en", "s", "x")]
    return spark.createDataFrame(docs + extra, SCHEMA), spark.createDataFrame(labels + [(9001, None, None), (7, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("module, scored, label", [(quality, quality.scored, "quality"), (toxicity, toxicity.scored, "toxic")])
def test_held_out_accuracy_and_odd_rows(tables, module, scored, label):
    docs, labels = tables
    got = scored(docs, module.fit(docs, labels)).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    want = {r["doc_id"]: r[label] for r in labels.where("doc_id <> 7").collect()}
    test = [r for r in got if r["held_out"] and want.get(r["doc_id"]) is not None]
    assert len(test) > 80 and np.mean([r["predicted"] == want[r["doc_id"]] for r in test]) > 0.95
    for r in got:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    assert len({r["score"] for r in got if r["doc_id"] in (9001, 9002, 9003)}) == 1
    assert len({r["score"] for r in got if r["doc_id"] == 5}) == 1


def test_held_out_labels_are_not_read(tables):
    docs, labels = tables
    flipped = labels.withColumn("quality", F.when(held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert (quality.fit(docs, labels) == quality.fit(docs, flipped)).all()


def test_no_labels_and_empty_table(spark, tables):
    docs, labels = tables
    for module in (quality, toxicity):
        model = module.fit(docs, labels.limit(0))
        assert module.scored(docs, model).count() == docs.count()
        assert module.scored(docs.limit(0), model).count() == 0


def test_passing_keeps_all_columns(tables):
    docs, labels = tables
    kept = quality.passing(docs, quality.fit(docs, labels))
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()


def test_marginals_equal_all_taggings():
    r = np.random.default_rng(0)
    e, head = r.normal(size=9), np.array([1, 0, 0, 0, 1, 1, 0, 0, 0], bool)
    trans, init = r.normal(size=(2, 2)), 0.3
    total, ones = 0.0, np.zeros(9)
    for code in range(512):
        tags = [(code >> i) & 1 for i in range(9)]
        s = sum(e[i] * tags[i] + (init * tags[i] if head[i] else trans[tags[i - 1], tags[i]]) for i in range(9))
        total += np.exp(s)
        ones += np.exp(s) * np.array(tags)
    assert np.allclose(toxicity.marginals(e, head, trans, init)[0], ones / total)


def test_long_chains_are_stable():
    e = np.tile([8.0, -8.0, 0.1], 30_000)
    head = np.zeros(len(e), bool)
    head[::5000] = True
    p = toxicity.marginals(e, head, np.array([[2.0, -2.0], [-1.0, 1.0]]), -1.0)[0]
    assert np.isfinite(p).all() and np.allclose(p[20_010:20_100], toxicity.marginals(e[20_000:25_000], head[20_000:25_000], np.array([[2.0, -2.0], [-1.0, 1.0]]), -1.0)[0][10:100])


def test_spans_are_code_points(spark, tables):
    docs, labels = tables
    model = toxicity.fit(docs, labels)
    r = toxicity.scored(spark.createDataFrame([(1, "é漢 sun grumfly sea")], "doc_id long, text string"), model).first()
    assert r["spans"] == "7-14" and r["predicted"] == 1


def test_training_and_scores_equal_plain_ftrl():
    """One update after the other with dictionaries, on the features named in the module's text."""
    docs, labels = made(60)
    texts, y = [(t or "").encode() for _, t, *_ in docs], [q for _, q, _ in labels]
    f, first = quality.features(texts)
    rows = []
    for a, b in zip(first[:-1], first[1:]):
        x = {}
        for i in f[a:b].tolist():
            x[i] = x.get(i, 0.0) + quality.SCALE / (b - a)
        rows.append(x | {1 << quality.BITS: 1.0})
    alpha, beta, l1, l2 = 0.3, 1.0, 0.02, 0.1
    z, n = {}, {}

    def weight(i):
        v = z.get(i, 0.0)
        return 0.0 if abs(v) <= l1 else -(v - (l1 if v > 0 else -l1)) / ((beta + n.get(i, 0.0) ** 0.5) / alpha + l2)

    for _ in range(2):
        for x, label in zip(rows, y):
            w = {i: weight(i) for i in x}
            p = 1 / (1 + np.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g, m = (p - label) * v, n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - ((m + g * g) ** 0.5 - m**0.5) / alpha * w[i]
                n[i] = m + g * g
    got = quality.train(texts, y, epochs=2)
    assert np.allclose([got[i] for i in z], [weight(i) for i in z], atol=1e-9) and np.count_nonzero(got) == sum(weight(i) != 0 for i in z)
    dots = [sum(weight(i) * v for i, v in x.items()) for x in rows]
    assert np.allclose(quality.score(texts, got), 1 / (1 + np.exp(-np.array(dots))), atol=2e-9)


def test_features_are_words_pairs_shapes_and_repeats():
    names = lambda text: {tuple(r) for r in quality.features([text])[0].reshape(-1, 4).tolist()}
    assert len(names(b"Sun sun sun SUN")) == 3  # the first of a text, repeats, and a repeat in capitals
    a, b = quality.features([b"sea SUN!! 12", b"sea sun!! 13"])[0].reshape(2, 4, 4)
    assert (a[:, 0] == b[:, 0]).tolist() == [True, True, True, False]
    assert (a[:, 1] == b[:, 1]).tolist() == [True, True, True, False]
    assert (a[:, 2] == b[:, 2]).tolist() == [True, False, True, True]


def test_toxic_scores_equal_sums_over_all_taggings(tables):
    """A document's score from the marginals of every tagging of its words, one by one."""
    docs, labels = tables
    model = toxicity.fit(docs, labels)
    for text in (b"sun grumfly sea", b"Grumf grumfing hills", b"lamp door rain roads tree", b"grumf", b"a b c d e f g"):
        f, *_ = toxicity.tokens([text])
        e = np.clip(model["w"][f].sum(axis=1) + model["bias"], -30, 30)
        total, ones = 0.0, np.zeros(len(e))
        for code in range(1 << len(e)):
            tags = [code >> i & 1 for i in range(len(e))]
            s = sum(e[i] * tags[i] + (model["trans"][tags[i - 1], tags[i]] if i else model["init"] * tags[0]) for i in range(len(e)))
            total += np.exp(s)
            ones += np.exp(s) * np.array(tags)
        p = np.clip(ones / total, 1e-6, 1 - 1e-6)
        odds = sorted(np.log(p / (1 - p)), reverse=True)
        x = np.array([odds[0], odds[1] if len(odds) > 1 else -12.0, np.log1p(p.sum()), 1.0])
        want = 1 / (1 + np.exp(-np.clip(x @ model["scale"], -35, 35)))
        got, spans = toxicity.score([text], model)
        assert abs(got[0] - want) < 1e-6
        words = list(__import__("re").finditer(rb"[A-Za-z]+", text))
        assert spans[0] == [m.span() for m, q in zip(words, p) if q >= 0.5]


@pytest.mark.parametrize("module, query, label, at", [(quality, quality.op5_quality, "quality", 0.3), (toxicity, toxicity.op1_toxicity, "toxic", 0.5)])
def test_registered_scores_of_whole_tables(spark, module, query, label, at):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{x}.parquet") for x in ("documents", "labels"))
    got = {r["doc_id"]: r for r in query(spark, sf).collect()}
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    assert got.keys() == texts.keys()
    model = module.fit(docs, labels)
    for d in list(texts)[::37]:  # one text at a time gives the same score
        s = module.score([texts[d]], model)
        s = (s[0] if module is toxicity else s)[0]
        assert got[d]["score"] == pytest.approx(s, abs=2e-9) and got[d]["predicted"] == int(got[d]["score"] >= at)
    held = [r for r in labels.collect() if got[r["doc_id"]]["held_out"] and r[label] is not None]
    assert np.mean([got[r["doc_id"]]["predicted"] == r[label] for r in held]) >= 0.95
