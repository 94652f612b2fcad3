"""Findings as rows: what was found in which column, how many rows it touches, and under which articles."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from lakewarden import config

SCHEMA = "source string, issue_type string, column string, description string, data_class string, total_rows long, scope string, detection string, evidence map<string,string>, articles array<string>, affected_rows long, finding_key string"


@dataclass(frozen=True)
class Finding:
    """scope is `column` (all rows) or `row`; kind tells findings of one issue and column apart."""

    source: str
    issue_type: str
    column: str
    description: str
    data_class: str
    total_rows: int
    affected: int = 0
    scope: str = "row"
    evidence: dict = field(default_factory=dict)
    articles: tuple[str, ...] = ()
    kind: str = ""
    detection: str = "rule"

    def row(self) -> tuple:
        rows = self.total_rows if self.scope == "column" else self.affected
        return (self.source, self.issue_type, self.column, self.description, self.data_class, self.total_rows, self.scope, self.detection,
                {k: str(v) for k, v in self.evidence.items()}, list(self.articles), rows, "|".join([self.source, self.issue_type, self.column, self.scope, self.kind]))


def articles(data_class: str, issue: str | None = None) -> tuple[str, ...]:
    """Articles of the class, then of the issue, each once."""
    return tuple(dict.fromkeys([*config.CLASS_ARTICLES.get(data_class, []), *(config.ISSUE_ARTICLES.get(issue, []) if issue else [])]))


def as_table(spark: SparkSession, found: list[Finding]) -> DataFrame:
    """A row a finding: as many as columns have issues, not as rows have."""
    return spark.createDataFrame([f.row() for f in found], SCHEMA)
