import corpus_pipeline


def changed(words, n):
    """words with n of them replaced, far apart."""
    out = words[:]
    for i in range(n):
        out[20 + 35 * i] = f"other{i}"
    return " ".join(out)


def kept(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.near_dup_stage(spark, df, "").collect()), key=str)


def test_sets_of_five_words(spark):
    a, b = [f"a{i}" for i in range(200)], [f"b{i}" for i in range(200)]
    # Five changed words: 0.82 on sets of four words, 0.77 on sets of five. Three: 0.86 on sets of five.
    got = kept(spark, [(1, " ".join(a)), (2, changed(a, 5)), (3, " ".join(b)), (4, changed(b, 3))])
    assert [i for i, _ in got] == [1, 2, 3]


def test_null_and_repeated_ids(spark):
    a, b, c, d = ([f"{x}{i}" for i in range(200)] for x in "abcd")
    text = {x[0][0]: " ".join(x) for x in (a, b, c, d)}
    rows = [(None, text["a"]), (None, text["a"]), (None, changed(a, 1))]  # copies without an id
    rows += [(7, text["b"])] * 3  # one row three times
    rows += [(5, text["c"]), (9, changed(c, 2)), (9, text["d"])]  # one of the two texts of 9 is a near-copy
    rows += [(None, None), (None, ""), (3, ""), (3, "")]  # no words, no group
    got = kept(spark, rows)
    assert len([t for i, t in got if i is None and t]) == 1 and got.count((7, text["b"])) == 1
    assert [r for r in got if r[0] in (5, 9)] == [(5, text["c"]), (9, text["d"])]
    assert sorted((r for r in got if not r[1]), key=str) == sorted([(None, None), (None, ""), (3, ""), (3, "")], key=str)


def test_a_named_row_stands_for_nameless_copies(spark):
    a = [f"a{i}" for i in range(200)]
    got = kept(spark, [(None, " ".join(a)), (12, changed(a, 1)), (4, changed(a, 2))])
    assert [i for i, _ in got] == [4]
