"""Decisions on findings, kept as an append-only log; the latest of each finding counts."""

from __future__ import annotations

import json
from datetime import datetime, timezone
from enum import StrEnum

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from lakewarden.sources.tables import AUDIT, append_audit

DECISION = "finding_id string, decision string, actor string, note string, decided_at string"


class Decision(StrEnum):
    """What a person may decide, and the taking back of a decision."""

    APPROVED = "approved"
    REJECTED = "rejected"
    REOPENED = "reopened"


#: The statuses that a summary always lists.
STATUSES = ["pending_review", "approved", "rejected", "auto_logged"]


def audit_path(path: str) -> str:
    """Where decisions of the log at path are audited if no other place is named."""
    return path.rstrip("/") + "-audit"


def _append(spark: SparkSession, path: str, row: Row, audit: str | None, dataset: str, **told: str) -> Row:
    """Appends row to the log and tells the audit log of it."""
    spark.createDataFrame([row], DECISION).write.mode("append").json(path)
    detail = json.dumps({"finding_id": row.finding_id, **told}, sort_keys=True)
    entry = (row.decided_at, row.actor, f"review_{row.decision}", dataset, detail)
    append_audit(spark.createDataFrame([entry], AUDIT), audit or audit_path(path))
    return row


def _named(actor: str) -> str:
    name = actor.strip()
    if name == "":
        raise ValueError("who decides? actor is empty")
    return name


def _now() -> str:
    return datetime.now(timezone.utc).isoformat(timespec="microseconds")


def record(spark: SparkSession, path: str, finding_id: str, decision: str, actor: str, note: str = "", audit: str | None = None, dataset: str = "", finding: str = "") -> Row:
    """Appends a person's approval or rejection of a finding to the log at path.

    It always goes to an audit log as well (`audit`, or the one beside the log), as `review_approved` or `review_rejected` with the note and `finding`, what the finding says."""
    settled = Decision(decision)  # ValueError for what isn't a decision
    if settled is Decision.REOPENED:
        raise ValueError("clear() reopens a finding")
    row = Row(finding_id=finding_id, decision=settled.value, actor=_named(actor), note=note.strip(), decided_at=_now())
    return _append(spark, path, row, audit, dataset, note=row.note, finding=finding)


def clear(spark: SparkSession, path: str, finding_id: str, actor: str, audit: str | None = None, dataset: str = "") -> Row | None:
    """Takes a decision back by an entry of its own, and tells the audit log (`review_reopened`) what had been decided; nothing is deleted.

    Where nothing is decided nothing is written, and None returned."""
    name = _named(actor)
    held = current(log(spark, path).where(F.col("finding_id") == finding_id)).first()
    if held is None:
        return None
    row = Row(finding_id=finding_id, decision=Decision.REOPENED.value, actor=name, note="", decided_at=_now())
    return _append(spark, path, row, audit, dataset, previous_decision=held["decision"])


def log(spark: SparkSession, path: str) -> DataFrame:
    """All entries; none where there is no log. Lines that aren't entries are left out."""
    try:
        return spark.read.schema(DECISION).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException:
        return spark.createDataFrame([], DECISION)


def current(entries: DataFrame) -> DataFrame:
    """The latest entry of each finding, unless that reopened it."""
    order = Window.partitionBy("finding_id").orderBy(F.desc("decided_at"), "decision", "actor")
    return entries.withColumn("__r", F.row_number().over(order)).where(f"__r = 1 and decision <> '{Decision.REOPENED.value}'").drop("__r")


def decorated(findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """findings with decision, actor and effective_status."""
    d = decisions.select(F.col("finding_id").alias("id"), "decision", "actor")
    return findings.join(d, "id", "left").withColumn("effective_status", F.coalesce("decision", "status"))


def summary(findings: DataFrame) -> DataFrame:
    """effective_status and n, with 0 for statuses that don't occur."""
    keys = findings.sparkSession.createDataFrame([(s,) for s in STATUSES], "effective_status string")
    counts = findings.groupBy("effective_status").agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(keys), "effective_status", "full").select("effective_status", F.coalesce("n", F.lit(0)).alias("n"))
