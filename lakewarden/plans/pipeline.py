"""A table's whole assessment: profile, types, quality, personal data, risk, citations, gate, recommendations, report."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import datetime, timezone
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from lakewarden import config
from lakewarden.operators import privacy, quality, retrieval, risk
from lakewarden.operators.findings import Finding, as_table
from lakewarden.operators.profiling import basics, profile, profiled_fields
from lakewarden.operators.quality import CELL, Dimension
from lakewarden.operators.typing import Typed, catalog, match_rates, typed_columns
from lakewarden.sources.tables import ROW, unique_names, with_row_id

NO_ROWS = "the table has no rows"


@dataclass
class Assessment:
    """Small things as values, the rest as lazy DataFrames. `cells` has the rows at fault. The catalog's exact profile is planned when it is asked for."""

    dataset: str
    total_rows: int
    listing: Callable[[], DataFrame]
    types: list[Typed]
    dimensions: list[Dimension]
    overall_score: float | None
    findings: DataFrame
    cells: DataFrame
    recommendations: DataFrame
    audit: list[dict] = field(default_factory=list)

    @cached_property
    def catalog(self) -> DataFrame:
        return self.listing()


def _now() -> str:
    return datetime.now(timezone.utc).isoformat(timespec="seconds")


def distinct_headers(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    names, renamed = unique_names(df.columns)
    return (df.toDF(*names), renamed) if renamed else (df, {})


def together(spark: SparkSession, *jobs: Callable[[], object]) -> list:
    """Results of jobs that don't depend on each other, run at the same time; each sees the session's settings. The first failure is raised."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]]


def assess(df: DataFrame, dataset: str = "table", rules: config.Profile | None = None, passages: DataFrame | None = None, row: str | None = None) -> Assessment:
    """Runs every step on df. `row` names a column that numbers the rows; without it rows are numbered in reading order."""
    spark, rules, audit = df.sparkSession, rules or config.profile_for(dataset), []

    def note(action: str, **detail: object) -> None:
        audit.append({"timestamp": _now(), "actor": "system", "action": action, "dataset": dataset, "detail": str(detail)})

    df, renamed = distinct_headers(df)
    if renamed:
        note("headers_renamed", renamed=renamed)
    df = df.withColumnRenamed(row, ROW) if row else with_row_id(df)
    base, types = [], []
    if profiled_fields(df):
        base, rates = together(spark, lambda: basics(df).collect(), lambda: match_rates(df).collect())
        types = typed_columns(df, base, rates)
    total = base[0]["rows"] if base else df.count()
    note("profiled", columns=len(types), rows=total)

    found: list[Finding] = []
    cells = [spark.createDataFrame([], CELL)]
    if not total or not types:
        dimensions = [Dimension(d, None, t, reason=NO_ROWS) for d, t in config.THRESHOLDS.items()]
    else:
        hidden = privacy.high_confidence_scan(df, types)
        free = [t.name for t in types if t.is_freetext]
        if free:
            hidden = hidden.unionByName(privacy.freetext_scan(df, free))
        (unique, repeated), (consistent, odd, broken), counts = together(
            spark,
            lambda: quality.uniqueness(df, types, rules.key, total),
            lambda: quality.consistency(df, types, rules.rules, total),
            lambda: hidden.groupBy("issue_type", "column", "kind").agg(F.count("*").alias("n")).collect(),
        )
        valid, invalid = quality.validity(df, types, total)
        dimensions = [quality.completeness(df, types, rules.required, base), unique, valid, consistent]
        cells += [c for c in (repeated, invalid, *odd) if c is not None]
        for b in broken:
            note("rule_failed", rule=b)
        found += [f for d in dimensions for f in d.findings]
        found += privacy.classify(types, total)
        found += privacy.scan_findings(counts, types, total)
        cells.append(hidden)
    dimensions += quality.unassessed()
    if not total:
        for d in dimensions:
            d.reason = NO_ROWS
    note("assessed", findings=len(found))

    findings = risk.scored(as_table(spark, found))
    if passages is not None:
        findings = retrieval.cited(findings, passages)
        note("cited", backend=retrieval.backend(passages))
    else:
        note("not_cited", reason="no passages are loaded")
    findings = risk.ranked(findings)
    out = cells[0]
    for c in cells[1:]:
        out = out.unionByName(c.select("issue_type", "column", "kind", F.col("row_id").cast("long").alias("row_id")))
    return Assessment(dataset, total, lambda: catalog(df, profile(df), types), types, dimensions, quality.overall(dimensions), findings, out, risk.recommendations(findings), audit)


def report(a: Assessment, df: DataFrame | None = None) -> dict:
    """The report as one document; what it lists is a few entries a column. With df, masked previews of personal columns."""
    findings = [r.asDict(recursive=True) for r in a.findings.collect()]
    bands: dict[str, int] = {}
    for f in findings:
        bands[f["band"]] = bands.get(f["band"], 0) + 1
    personal = [f["column"] for f in findings if f["issue_type"] == "unmasked_pii_column"]
    kinds = {t.name: t.semantic_type for t in a.types}
    previews = {}
    if df is not None and personal:
        numbered = with_row_id(df)
        previews = {c: [r["masked"] for r in privacy.masked_preview(numbered, c, kinds[c]).collect()] for c in personal}
    return {
        "dataset": a.dataset,
        "generated_at": _now(),
        "summary": {"rows": a.total_rows, "columns": len(a.types), "overall_quality_score": a.overall_score, "findings_total": len(findings), "findings_by_band": bands, "pending_review": sum(f["status"] == "pending_review" for f in findings)},
        "catalog": [r.asDict(recursive=True) for r in a.catalog.collect()],
        "quality_report": [{"dimension": d.dimension, "score": d.score, "threshold": d.threshold, "failing_columns": d.failing, "evidence": d.evidence, "not_assessed_reason": d.reason, "assessed": d.score is not None, "passed": d.passed} for d in a.dimensions],
        "compliance_report": {"pii_columns": personal, "freetext_columns": [t.name for t in a.types if t.is_freetext], "masked_preview": previews},
        "findings": findings,
        "recommendations": [r.asDict() for r in a.recommendations.collect()],
    }


def markdown(doc: dict) -> str:
    """The report's headline, findings and recommendations as markdown."""
    s = doc["summary"]
    score = "not assessed" if s["overall_quality_score"] is None else f"{s['overall_quality_score']:.2f}"
    lines = [f"# {doc['dataset']}", "", f"{s['rows']} rows, {s['columns']} columns; overall quality {score}; {s['findings_total']} findings, {s['pending_review']} pending review.", "", "| risk | band | column | issue | status |", "|-|-|-|-|-|"]
    lines += [f"| {f['risk']} | {f['band']} | {f['column']} | {f['issue_type']} | {f['status']} |" for f in doc["findings"]]
    lines += ["", *[f"- **{r['issue_type']}** on {r['column']}: {r['action']} ({r['suggested_owner']}, effort {r['effort']})" for r in doc["recommendations"]]]
    return "\n".join(lines)


def audit_table(spark: SparkSession, entries: list[dict]) -> DataFrame:
    from lakewarden.sources.tables import AUDIT

    return spark.createDataFrame(entries, AUDIT)
