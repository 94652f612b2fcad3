"""Edge cases of the operators: empty and odd tables, nulls, ties, names."""

import datetime as dt
import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lakewarden import config, narrative
from lakewarden.functions import columns as fx
from lakewarden.operators import evaluate, privacy, profiling, quality, retrieval, review, risk, typing
from lakewarden.plans import pipeline
from lakewarden.sources import tables
from lakewarden.streaming import monitors



def rows(df):
    """A DataFrame's rows as sorted tuples."""
    return sorted((tuple(r) for r in df.collect()), key=repr)


FRAMES = {
    "no_rows": ([], "email string, n double"),
    "single_row": ([("a@b.com",)], "email string"),
    "all_null_column": ([(None, i) for i in range(1, 6)], "a string, b int"),
    "sentinels": ([("",), ("N/A",), ("null",), ("-",), ("?",)], "a string"),
    "no_personal_data": ([(1, 2.5), (3, 4.5)], "widget_count int, price double"),
    "odd_names": ([("a@b.com", 1)], "`Customer E-Mail` string, `Order #` int"),
    "dotted_names": ([("x", 1)], "`a.b` string, `c d` int"),
    "unicode_names": ([("x", "y")], "`名前` string, `prénom` string"),
    "constant": ([("same", f"u{i}@e.com") for i in range(20)], "c string, e string"),
    "long_strings": ([("word " * 400,)] * 3, "t string"),
    "five_digits": ([("12345",), ("23456",), ("34567",)], "stock string"),
    "dates_and_flags": ([(dt.date(2020, 1, 1), True), (None, None)], "d date, f boolean"),
    "nan": ([(float("nan"),), (1.0,)], "x double"),
    "nested": ([([1, 2], "a")], "v array<int>, s string"),
}


@pytest.mark.parametrize("name", FRAMES)
def test_any_table_is_assessed(spark, name):
    data, schema = FRAMES[name]
    a = pipeline.assess(spark.createDataFrame(data, schema), name)
    doc = json.dumps(tables.plain(pipeline.report(a)), allow_nan=False)
    assert json.loads(doc)["summary"]["rows"] == len(data)
    if not data:
        assert a.overall_score is None and all(d.score is None and "no rows" in d.reason for d in a.dimensions)
    if name == "five_digits":
        assert a.findings.where("source = 'compliance'").count() == 0
    if name == "sentinels":
        assert a.dimensions[0].score == 0.0
    if name == "odd_names":
        assert a.types[0].semantic_type == "email"
    assert "|" in pipeline.markdown(pipeline.report(a))


def test_duplicate_headers(spark):
    df = spark.createDataFrame([(1, 2, 3)], "x int, y int, z int").toDF("x", "x", "x.1")
    renamed, changes = pipeline.distinct_headers(df)
    assert len(set(renamed.columns)) == 3 and renamed.columns[0] == "x" and changes


def test_profile_values(spark):
    df = spark.createDataFrame([("a", 1), ("b", None), ("N/A", 3), ("a", 3), (None, 3)], "s string, n int")
    p = {r["name"]: r for r in profiling.profile(tables.with_row_id(df.coalesce(1))).collect()}
    assert (p["s"]["null_count"], p["s"]["distinct_count"], p["s"]["samples"]) == (2, 2, ["a", "b"])
    assert (p["n"]["numeric_max"], p["n"]["null_pct"], p["n"]["mean_length"]) == (3.0, 20.0, None)


def test_row_ids_are_dense(spark, sf):
    df = tables.with_row_id(spark.read.parquet(f"{sf}/lineitem.parquet"))
    assert [r[0] for r in df.select(tables.ROW).orderBy(tables.ROW).collect()] == list(range(df.count()))


def test_integers_that_look_like_phones(spark):
    df = spark.createDataFrame([(2025550100 + i,) for i in range(10)], "v bigint")
    assert typing.typed_columns(df, profiling.basics(df))[0].semantic_type == "phone"


@pytest.mark.parametrize("name, kind", [("Customer ID", "customer_id"), ("email_address", "email"), ("company", "credit_card"), ("city", None), ("fname", "person_name")])
def test_type_from_name(name, kind):
    assert typing.type_from_name(name) == kind


def test_whole_match_refuses_a_last_line_break(spark):
    df = spark.createDataFrame([("123-45-6789",), ("123-45-6789\n",)], "v string")
    assert [r[0] for r in df.select(fx.whole_match(F.col("v"), config.PATTERNS["national_id"])).collect()] == [True, False]


def test_repeats_treat_nulls_as_equal(spark):
    df = spark.createDataFrame([(0, None), (1, "a"), (2, None), (3, "a"), (4, "b")], "_row_id long, k string")
    assert sorted(r["_row_id"] for r in quality.repeated_rows(df, ["k"]).collect()) == [2, 3]
    assert sorted(r["_row_id"] for r in quality.all_copies(df, ["k"]).collect()) == [0, 1, 2, 3]


def test_odd_spellings_tie_goes_to_the_first(spark):
    df = spark.createDataFrame([(0, "Texas"), (1, "TX"), (2, "TX"), (3, "Texas"), (4, "Paris"), (5, None)], "_row_id long, state string")
    got = {r["row_id"]: r["odd"] for r in quality.odd_spellings(df, "state", config.CANONICAL["state"]).collect()}
    assert got == {0: False, 1: True, 2: True, 3: False}


def test_broken_rule_is_noted_not_fatal(spark):
    df = spark.createDataFrame([("a", 1)], "s string, n int")
    a = pipeline.assess(df, "t", config.Profile("t", rules=[("bad", ["n"], "n >=< 1")]))
    assert any(e["action"] == "rule_failed" for e in a.audit)


def test_masks(spark):
    df = spark.createDataFrame([("ann@x.org",), ("@x.org",), ("a@b@c",), ("none",), (None,), ("",)], "v string")
    got = [r[0] for r in df.select(fx.mask(F.col("v"), "email")).collect()]
    assert got[:3] == ["a***@x.org", "****@x.org", "a***@b@c"] and got[3].startswith("ema_") and got[4] == ""
    assert [r[0] for r in df.select(fx.mask(F.col("v"), "person_name")).collect()][3:] == ["n.", "", ""]


def test_risk_of_empty_totals(spark):
    df = spark.createDataFrame([("quality", "new_issue", "c", "d", "new_class", 0, "row", "rule", 0, "k")], "source string, issue_type string, column string, description string, data_class string, total_rows long, scope string, detection string, affected_rows long, finding_key string")
    r = risk.scored(df).first()
    assert (r["risk"], r["band"], r["status"]) == (3, "Low", "auto_logged")
    assert risk.recommendations(risk.scored(df)).first()["effort"] == "Unknown"


def test_keyword_search_ranks_and_drops(spark):
    passages = spark.createDataFrame([(0, "accuracy of personal data"), (1, "security and encryption of processing"), (2, "")], "chunk_no int, text string")
    queries = spark.createDataFrame([("q", "encryption, security"), ("none", "zebra")], "query_id string, text string")
    assert [(r["query_id"], r["chunk_no"]) for r in retrieval.keyword_search(queries, passages, 2).collect()] == [("q", 1)]


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_keyword_search_either_way(spark, monkeypatch, most):
    monkeypatch.setattr(retrieval, "MOST_BYTES", most)
    passages = spark.createDataFrame([(i, f"common words {'rare' if i % 7 == 0 else ''} number{i % 5}") for i in range(60)] + [(99, None)], "chunk_no int, text string")
    queries = spark.createDataFrame([("a", "rare number3"), ("b", "common"), ("c", ""), ("d", None)], "query_id string, text string")
    found = [(r["query_id"], r["chunk_no"], r["rank"]) for r in retrieval.keyword_search(queries, passages, 3).orderBy("query_id", "rank").collect()]
    assert found == [("a", 28, 1), ("a", 3, 2), ("a", 8, 3), ("b", 1, 1), ("b", 2, 2), ("b", 3, 3)]


def test_character_references(spark):
    import html
    import random

    r = random.Random(3)
    parts = ["&", "#", "amp", "notit;", "not", "eacute", "&eacute;", "&#8217;", "&#x41;", "&#X1F600", "&#0;", "&#128;", "&#129;", "&#xD800;", "&#99999999999;", "&#x110000;", "&#13;", "&#1;", "&#xFEFF;", "&NotEqualTilde;", "&lt", ";", " ", "x", "9"]
    texts = ["", "plain", "&amp;lt;", "&ampx", "&unknown;", "&#;", "&#x;", "a&"] + ["".join(r.choices(parts, k=6)) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    for row in df.select("t", fx.decoded(F.col("t")).alias("d")).collect():
        assert row["d"] == (None if row["t"] is None else html.unescape(row["t"])), row["t"]


def test_regulations_and_index(spark, tmp_path):
    (tmp_path / "a.md").write_text("PLACEHOLDER text\n\n## Art. 1 | First\nOne  line.\nMore\n\n## Art. 2 | Empty\n\n## Art. 3 | Last\nEnd")
    chunks = tables.read_regulations(spark, str(tmp_path))
    assert [(r["reference"], r["title"], r["text"], r["is_placeholder"]) for r in chunks.orderBy("chunk_no").collect()] == [("Art. 1", "First", "One line. More", True), ("Art. 3", "Last", "End", True)]
    assert tables.load_index(spark, str(tmp_path / "none")) is None
    tables.save_index(chunks, str(tmp_path / "index"))
    assert rows(tables.load_index(spark, str(tmp_path / "index"))) == rows(chunks)
    assert tables.corpus_summary(chunks).first()["chunks"] == 2
    assert retrieval.uses_placeholders(chunks).first()[0]


def test_review_log(spark, tmp_path):
    path = str(tmp_path / "log")
    assert review.current(review.log(spark, path)).count() == 0
    with pytest.raises(ValueError):
        review.record(spark, path, "f1", "maybe", "ann")
    with pytest.raises(ValueError):
        review.record(spark, path, "f1", "approved", "  ")
    review.record(spark, path, "f1", "approved", "ann")
    review.record(spark, path, "f1", "rejected", "bob", "no")
    review.record(spark, path, "f2", "approved", "ann")
    review.clear(spark, path, "f2", "ann")
    assert [(r["finding_id"], r["decision"]) for r in review.current(review.log(spark, path)).collect()] == [("f1", "rejected")]


def test_decisions_are_audited(spark, tmp_path):
    path, audit = str(tmp_path / "log"), str(tmp_path / "audit")
    review.record(spark, path, "f1", "approved", " ann ", "seen", audit=audit, dataset="d", finding="3 rows repeat")
    review.record(spark, path, "f1", "rejected", "bob", audit=audit, dataset="d")
    review.clear(spark, path, "f1", "ann", audit=audit, dataset="d")
    got = [(r["action"], r["actor"], r["dataset"], json.loads(r["detail"])) for r in tables.audit_tail(spark, audit).collect()]
    assert got == [
        ("review_reopened", "ann", "d", {"finding_id": "f1", "previous_decision": "rejected"}),
        ("review_rejected", "bob", "d", {"finding_id": "f1", "note": "", "finding": ""}),
        ("review_approved", "ann", "d", {"finding_id": "f1", "note": "seen", "finding": "3 rows repeat"}),
    ]
    assert review.current(review.log(spark, path)).count() == 0
    with pytest.raises(ValueError):
        review.record(spark, path, "f1", "reopened", "ann")


def test_every_decision_is_audited_and_only_decisions_are_taken_back(spark, tmp_path):
    path = str(tmp_path / "log")
    assert review.clear(spark, path, "f1", "ann") is None
    review.record(spark, path, "f1", "approved", "ann")
    assert review.clear(spark, path, "f2", "ann") is None and review.clear(spark, path, "f1", "bob") is not None and review.clear(spark, path, "f1", "bob") is None
    assert review.log(spark, path).count() == 2
    assert [r["action"] for r in tables.audit_tail(spark, review.audit_path(path)).collect()] == ["review_reopened", "review_approved"]
    with pytest.raises(ValueError):
        review.clear(spark, path, "f1", " ")


def test_why_there_are_no_vectors(spark):
    passages = spark.createDataFrame([(0, "one"), (1, "two")], "chunk_no int, text string")
    made, why = retrieval.embedded(passages, F.array(F.length("text").cast("double"), F.lit(4.0)))
    assert why is None and retrieval.backend(made) == "vector" and made.first()["embedding"] == [0.6, 0.8]

    @F.pandas_udf("array<double>")
    def lengths(t: pd.Series) -> pd.Series:
        return t.map(lambda x: [3.0, float(len(x) + 1)])

    assert retrieval.embedded(passages, lengths("text"))[0].first()["embedding"] == [0.6, 0.8]

    @F.pandas_udf("array<double>")
    def broken(t: pd.Series) -> pd.Series:
        raise RuntimeError("no model here")

    same, why = retrieval.embedded(passages, broken("text"))
    assert retrieval.backend(same) == "keyword" and why.startswith("PythonException")
    assert retrieval.embedded(passages, F.when(F.col("chunk_no") > 0, F.array(F.lit(1.0))))[1] == "1 passages have no vector"
    assert retrieval.embedded(passages, None) == (passages, "no expression for vectors is given")


def test_audit_of_one_second_keeps_its_order(spark, tmp_path):
    for actions in (["profiled", "assessed", "not_cited"], ["b", "a"]):
        rows = [{"timestamp": "2026-01-01T00:00:00", "actor": "a", "action": x, "dataset": "d", "detail": ""} for x in actions]
        tables.append_audit(pipeline.audit_table(spark, rows), str(tmp_path / "log"))
    assert [r["action"] for r in tables.audit_tail(spark, str(tmp_path / "log")).collect()] == ["a", "b", "not_cited", "assessed", "profiled"]


def test_answers_outlive_a_run(spark, tmp_path):
    asked, path = [], str(tmp_path / "answers")
    ask = lambda p: asked.append(p) or "Fine."
    for _ in range(2):
        w = narrative.Writer(ask).load(spark, path)
        assert w.write("x", {"a": 1}) == "Fine."
        w.save(spark, path)
    assert len(asked) == 1 and narrative.Writer(ask).load(spark, path).cache.keys() == w.cache.keys()


DATES = (
    "2024-01-05,2024-1-5,2024/01/05,2024.01.05,01/02/2024,13/02/2024,01-02-2024,31-12-2023,1.2.2024,13.2.2024,5 Jan 2024,05-Jan-2024,January 5 2024,5 January 2024,5th Jan 2024,20240105,12345,01/02/24,2024-01-05T10:20,"
    "2024-01-05 10:20:30.123456,01/02/2024 3:04 PM,01/02/2024 12:04 AM,2024-13-05,2024-02-30,2024-02-29,Friday,5,1/2,99/99/2024,12/31/99,12/31/70,3-September-2020,2024 Jan 5,2024-Jan-05, 2024-01-05 ,05Jan2024,1/2/2024 25:00,May,+1 555,x,"
    "31 Xyz 2024,99999-01-01,555-0100,2024-01-05 10:20:30Z,2024-01-05T10:20:30+02:00,2024-01-05T10:20:30-0530"
).split(",") + ["Jan 5, 2024", "Sept 3, 2020", "Mon, 05 Jan 2024", "", "\u0661\u0662-\u0661\u0662-\u0662\u0660\u0662\u0664"]


def test_dates_of_any_form_are_read_cell_by_cell(spark):
    from pyspark.sql import types as T

    df = spark.createDataFrame([(d,) for d in DATES], "c string")
    got = {r["c"]: r["t"] for r in df.select("c", fx.as_timestamp(F.col("c"), T.StringType()).cast("string").alias("t")).collect()}
    for d in DATES:
        at = pd.to_datetime(d, errors="coerce") if d.isascii() else pd.NaT
        at = at.tz_convert("UTC").tz_localize(None) if at is not pd.NaT and at.tzinfo else at
        want = None if at is pd.NaT else str(at)
        assert got[d] == want, (d, got[d], want)


def test_a_column_of_mixed_dates_is_a_date_and_its_rules_see_every_row(spark):
    forms = ["2024-03-{:02}", "03/{:02}/2024", "{} Mar 2024", "March {}, 2024"]
    rows_ = [(i, forms[i % 4].format(i % 28 + 1), f"2024-03-{15:02}") for i in range(56)]
    df = spark.createDataFrame(rows_, "_row_id long, a string, b string")
    types = typing.typed_columns(df, profiling.basics(df))
    assert [t.semantic_type for t in types] == ["date", "date"]
    out, found, _ = quality.consistency(df, types, [("order", ["a", "b"], "a <= b")], 56)
    assert out.findings[0].evidence["rows_evaluated"] == 56
    assert {r["row_id"] for r in found[0].collect()} == {i for i in range(56) if i % 28 + 1 > 15}


def test_metrics_of_nothing(spark):
    none = spark.createDataFrame([], "defect_type string, column string, row_id long")
    m = evaluate.metrics(evaluate.compared(none, none)).first()
    assert (m["precision"], m["recall"]) == (1.0, 1.0)
    one = spark.createDataFrame([("a", "c", None), ("a", "c", 1)], "defect_type string, column string, row_id long")
    m = evaluate.metrics(evaluate.compared(one, one)).first()
    assert (m["tp"], m["fp"], m["fn"], m["f1"]) == (2, 0, 0, 1.0)


def test_csv_with_missing_tokens(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,x,n,s\n1,N/A,2.5,-\n2,,NA,b\n")
    df = tables.read_csv(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["x", "x.1", "n", "s"] and [t for _, t in df.dtypes] == ["bigint", "string", "double", "string"]
    assert rows(df) == [(1, None, 2.5, "-"), (2, None, None, "b")]


def test_report_and_audit_files(spark, tmp_path):
    tables.write_report(spark, {"a": float("nan"), "b": [1, float("inf")]}, str(tmp_path / "r"))
    assert tables.read_report(spark, str(tmp_path / "r")) == {"a": None, "b": [1, None]}
    for i in range(3):
        tables.append_audit(pipeline.audit_table(spark, [{"timestamp": f"t{i}", "actor": "a", "action": "x", "dataset": "d", "detail": "y" * 200}]), str(tmp_path / "log"))
    tail = tables.audit_tail(spark, str(tmp_path / "log"), 2).collect()
    assert [r["timestamp"] for r in tail] == ["t2", "t1"] and len(tail[0]["detail"]) == 120


def test_narrative_guards():
    w = narrative.Writer(lambda prompt: "The score is 93 of 100.")
    assert w.write("Explain.", {"score": 92.5, "most": 100}) and w.write("Explain.", {"score": 47}) is None and w.rejected_numbers == 2
    w = narrative.Writer(lambda prompt: "This is unlawful.")
    assert w.write("Explain.", {"a": "b"}) is None and w.rejected_terms == 2
    assert narrative.Writer("off").write("x", {}) is None
    assert narrative.invented("95 and 96", {95.0}) == {96.0}


def test_no_cell_of_a_personal_column_reaches_a_prompt(spark):
    df = spark.createDataFrame([("ann.secret@x.org", "red"), ("bob.secret@x.org", "blue")], "email string, colour string")
    prompts = []
    narrative.narrate(pipeline.report(pipeline.assess(df)), narrative.Writer(lambda p: prompts.append(p) or "Fine."))
    assert prompts and not any("secret" in p for p in prompts) and any("red" in p for p in prompts)


def test_stream_counts_equal_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    q = monitors.counts(monitors.read(spark, str(tmp_path / "in"), events, files=10)).writeStream.format("memory").queryName("monitored").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("monitored").agg(F.sum("n")).first()[0] == events.count()


def test_masked_columns(spark):
    df = spark.createDataFrame([("a@b.com", 1)], "email string, n int")
    assert privacy.masked(df, {"email": "email"}).first()["email"] == "a***@b.com"


def test_approximate_profile(spark, sf):
    df = spark.read.parquet(f"{sf}/orders.parquet")
    exact = {r["name"]: r for r in profiling.profile(tables.with_row_id(df)).collect()}
    near = {r["name"]: r for r in profiling.profile(df, exact=False).collect()}
    assert exact.keys() == near.keys()
    for name, r in exact.items():
        assert abs(near[name]["distinct_count"] - r["distinct_count"]) <= max(3, 0.1 * r["distinct_count"])
        assert near[name]["samples"] == r["samples"] and near[name]["near_constant"] == r["near_constant"]


def test_the_number_of_jobs_does_not_depend_on_the_number_of_checks(spark):
    rows_ = [(i, f"a{i}@x.org", float(i - 2), float(i % 3), ["TX", "Texas", "FL", "Florida", "TX"][i % 5]) for i in range(40)]
    df = spark.createDataFrame(rows_, "row_id long, email string, a double, b double, state string")
    jobs, scores = [], []
    for n in (1, 12):
        rules = config.Profile(key=["email"], rules=[(f"rule{i}", ["a", "b"], f"a + {i} >= b") for i in range(n)])
        spark.sparkContext.setJobGroup(f"rules{n}", "")
        a = pipeline.assess(df, "t", rules, row="row_id")
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"rules{n}")))
        scores.append({d.dimension: d for d in a.dimensions}["consistency"])
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1] > 0
    good = [sum(r[2] + i >= r[3] for r in rows_) / 40 for i in range(12)]
    spelt = 1 - 16 / 40  # the commonest spelling of TX is TX; of FL the two are as common, and the first one counts
    assert scores[0].score == round(100 * (spelt + good[0]) / 2, 2) and scores[1].score == round(100 * (spelt + sum(good)) / 13, 2)


def test_rules_and_spellings_of_one_name_and_rules_that_cannot_be_evaluated(spark):
    df = spark.createDataFrame([(0, "TX", 1.0), (1, "Texas", -1.0), (2, "TX", None), (3, None, 2.0)], "_row_id long, state string, x double")
    rules = [("state", ["x"], "x > 0"), ("broken", ["x"], "nowhere > x"), ("absent", ["y"], "y > 0"), ("null", ["x"], "nullif(x, 2.0) > 0")]
    out, found, broken = quality.consistency(df, [], rules, 4)
    assert out.score == round(100 * (2 / 3 + 2 / 3 + 1 / 3) / 3, 2) and [b.split(":")[0] for b in broken] == ["broken"]
    assert sorted((r["column"], r["kind"], r["row_id"]) for f in found for r in f.collect()) == [("state", "spelling", 1), ("x", "null", 1), ("x", "null", 3), ("x", "state", 1)]


def test_numbers_beyond_a_long_keep_their_digits(spark, tmp_path):
    """Against the SQL of the query, up to what its decimals hold; larger ones as text."""
    import random

    import duckdb

    from lakewarden.plans import catalogue

    rng = random.Random(3)
    texts = ["909955422195631329054", "9223372036854775807 9223372036854775808", "4611686018427387904.5", "100000000000000000000000", "98765432109876543210987654321098765432", "0.9 007 555", ""]
    texts += [" ".join(str(rng.randrange(10 ** rng.randrange(1, 38))) for _ in range(20)) for _ in range(50)]
    spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "doc_id long, text string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = rows(catalogue.invented_numbers(spark, str(tmp_path)))
    assert got == sorted(con.sql(catalogue.ORACLES["invented_numbers"]).fetchall(), key=repr)
    assert (0, "909955422195631390720") in got
    large = [r[0] for r in spark.createDataFrame([(1e38,), (float("inf"),), (None,)], "x double").select(fx.whole(F.col("x"))).collect()]
    assert large == ["1.0E38", "Infinity", None]
