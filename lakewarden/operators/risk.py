"""Scores, bands, review gate and recommendations for findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewarden import config


def _lookup(key: Column, table: dict, default: object) -> Column:
    """A value by key from a small fixed table, inlined as a literal map."""
    entries = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*entries), key), F.lit(default))


def volume(affected: Column, total: Column) -> Column:
    floor = F.lit(config.VOLUME_FLOOR)
    return F.when(total <= 0, floor).otherwise(floor + (1 - floor) * F.least(affected.cast("double") / total, F.lit(1.0)))


def risk_score(issue: Column, data_class: Column, affected: Column, total: Column) -> Column:
    raw = _lookup(issue, config.SEVERITY, 1) * _lookup(data_class, config.EXPOSURE, 1) * volume(affected, total)
    return F.bround(raw / config.MAX_RAW * 100, 0).cast("int")


def band(risk: Column) -> Column:
    out = F.when(risk <= config.BANDS[0][0], config.BANDS[0][1])
    for ceiling, name in config.BANDS[1:]:
        out = out.when(risk <= ceiling, name)
    return out.otherwise(config.BANDS[-1][1])


def status(risk: Column, detection: Column) -> Column:
    """Findings that no rule made, or of high risk, wait for a person."""
    return F.when((detection == "llm_unconfirmed") | (risk >= config.REVIEW_AT), "pending_review").otherwise("auto_logged")


def finding_id() -> Column:
    """The first 10 hex digits of a digest of source, issue, column and scope (kinds of one column share it)."""
    return F.left(F.sha1(F.concat_ws("|", "source", "issue_type", "column", "scope").cast("binary")), F.lit(10))


def scored(findings: DataFrame) -> DataFrame:
    """findings with id, risk, band and status."""
    risk = risk_score(F.col("issue_type"), F.col("data_class"), F.col("affected_rows"), F.col("total_rows"))
    return findings.withColumn("id", finding_id()).withColumn("risk", risk).withColumn("band", band(F.col("risk"))).withColumn("status", status(F.col("risk"), F.col("detection")))


def ranked(findings: DataFrame) -> DataFrame:
    return findings.orderBy(F.desc("risk"), "column", "finding_key")


def pending(findings: DataFrame) -> DataFrame:
    return findings.where("status = 'pending_review'")


def rationale() -> Column:
    return F.format_string(config.RATIONALE, "band", "risk", "description", "affected_rows", "total_rows")


def recommendations(findings: DataFrame) -> DataFrame:
    """The worst finding of each issue and column with the playbook's action. The worst is found by an aggregate that is combined before the shuffle."""
    kept = F.struct((-F.col("risk")).alias("least"), (-F.col("affected_rows")).alias("fewest"), "finding_key", *[c for c in ("id", "risk", "band", "status", "description", "affected_rows", "total_rows")])
    first = findings.groupBy("issue_type", "column").agg(F.min(kept).alias("worst")).select("issue_type", "column", "worst.*")
    actions = {i: F.create_map(*[F.lit(x) for k, v in config.PLAYBOOK.items() for x in (k, v[i])]) for i in range(3)}
    part = lambda i: F.coalesce(F.element_at(actions[i], F.col("issue_type")), F.lit(config.DEFAULT_ACTION[i]))
    out = first.select(F.col("id").alias("finding_id"), "column", "issue_type", part(0).alias("action"), part(1).alias("suggested_owner"), part(2).alias("effort"), rationale().alias("rationale"), "risk", "band", "status", "affected_rows")
    return out.orderBy(F.desc("risk"), F.desc("affected_rows"), "column", "issue_type").drop("affected_rows")


def band_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("band").agg(F.count("*").alias("findings"), F.count_if(F.col("status") == "pending_review").alias("pending"), F.sum("affected_rows").alias("affected_rows"))


def top(findings: DataFrame, n: int = 10) -> DataFrame:
    return ranked(findings).limit(n)
