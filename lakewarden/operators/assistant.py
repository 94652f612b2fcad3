"""Answers to questions from a report's findings only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewarden import config
from lakewarden.functions.columns import question_tokens


@dataclass(frozen=True)
class Answer:
    text: str
    finding_ids: list[str]
    grounded: bool


def searchable(has_citations: bool = False) -> Column:
    parts = ["column", "issue_type", "description", "data_class", "band", "status"]
    extra = [F.array_join(F.transform("citations", lambda c: c["reference"]), " ")] if has_citations else []
    return F.concat_ws(" ", *parts, *extra)


def matches(findings: DataFrame, question: Column, k: int = 4) -> DataFrame:
    """The k findings that share most words with the question, then by risk."""
    have = question_tokens(searchable("citations" in findings.columns))
    overlap = F.size(F.array_intersect(question_tokens(question), have))
    return findings.withColumn("overlap", overlap).where("overlap > 0").orderBy(F.desc("overlap"), F.desc("risk"), "finding_key").limit(k)


def line() -> Column:
    return F.format_string(config.ANSWER_LINE, "id", "column", F.replace("issue_type", F.lit("_"), F.lit(" ")), "description", "risk", "band", "status")


def ask(findings: DataFrame, question: str) -> Answer:
    rows = matches(findings, F.lit(question)).select("id", line().alias("line")).collect()
    if not rows:
        return Answer("No finding of this report matches the question, and nothing else is known here.", [], False)
    return Answer("\n".join(r["line"] for r in rows), [r["id"] for r in rows], True)
