"""Decisions as a stream against the batch operators, with failures in mid-batch."""

import json
import random

import pytest
from pyspark.sql import Row

from lakewarden.operators import review
from lakewarden.streaming import decisions


def entry(finding, decision, at, actor="ann", note=""):
    return Row(finding_id=finding, decision=decision, actor=actor, note=note, decided_at=f"2026-01-01T00:00:{at:02}.000000+00:00")


def add(spark, log, *entries):
    spark.createDataFrame(list(entries), review.DECISION).coalesce(1).write.mode("append").json(log)


def listed(df):
    return sorted(tuple(r[c] for c in ("finding_id", "decision", "actor", "note", "decided_at")) for r in df.collect())


def told(spark, out):
    return sorted((r["timestamp"], r["action"], json.loads(r["detail"])["finding_id"]) for r in decisions.audit(spark, out).collect())


def test_follows_the_log_over_restarts(spark, tmp_path):
    log, out, rng, at, kept = str(tmp_path / "log"), str(tmp_path / "out"), random.Random(3), list(range(1, 60)), []
    rng.shuffle(at)  # entries come out of order
    for _ in range(6):
        new = [entry(f"f{rng.randrange(5)}", rng.choice(["approved", "rejected", "reopened"]), at.pop()) for _ in range(4)]
        kept += new
        add(spark, log, *new)
        decisions.follow(spark, log, out, "d").awaitTermination()
        assert listed(decisions.current(spark, out)) == listed(review.current(review.log(spark, log)))
    assert len([t for t in told(spark, out) if t[1] != "review_reopened"]) == len([e for e in kept if e.decision != "reopened"])
    assert len(decisions._complete(spark, out)) <= decisions._KEPT


@pytest.mark.parametrize("where", ["audit", "state"])
def test_a_failure_in_mid_batch_leaves_each_entry_once(spark, tmp_path, monkeypatch, where):
    log, out = str(tmp_path / "log"), str(tmp_path / "out")
    add(spark, log, entry("f1", "approved", 1), entry("f2", "rejected", 2))
    decisions.follow(spark, log, out).awaitTermination()
    add(spark, log, entry("f1", "reopened", 3, "bob"), entry("f3", "approved", 4), entry("f9", "reopened", 5))
    real, done = decisions._latest, []

    def failing(entries):
        if where == "state":  # the state is written, but the batch isn't reported as done
            real(entries).coalesce(1).write.mode("overwrite").parquet(f"{out}/state/batch=1")
        raise RuntimeError("lost")

    monkeypatch.setattr(decisions, "_latest", failing)
    with pytest.raises(Exception, match="lost"):
        decisions.follow(spark, log, out).awaitTermination()
    monkeypatch.setattr(decisions, "_latest", real)
    done = decisions.follow(spark, log, out)
    done.awaitTermination()
    assert [t[1:] for t in told(spark, out)] == [("review_approved", "f1"), ("review_rejected", "f2"), ("review_reopened", "f1"), ("review_approved", "f3")]
    assert listed(decisions.current(spark, out)) == listed(review.current(review.log(spark, log)))
    previous = [json.loads(r["detail"]).get("previous_decision") for r in decisions.audit(spark, out).where("action = 'review_reopened'").collect()]
    assert previous == ["approved"]


def test_nothing_yet(spark, tmp_path):
    assert decisions.current(spark, str(tmp_path)).count() == decisions.audit(spark, str(tmp_path)).count() == 0
