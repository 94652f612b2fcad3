"""Personal data: columns that hold it, and cells in which it hides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewarden import config
from lakewarden.functions.columns import as_text, contains, mask, normalised_column
from lakewarden.operators.findings import Finding, articles
from lakewarden.operators.quality import CELL
from lakewarden.operators.typing import Typed, type_from_name
from lakewarden.sources.tables import ROW, column


def classify(types: list[Typed], total: int) -> list[Finding]:
    """Columns of a personal class, by name, value or both."""
    out = []
    for t in types:
        by_name, by_value = type_from_name(t.name) is not None, t.rate >= config.VALUE_MATCH
        if t.data_class == config.NON_PERSONAL or not (by_name or by_value):
            continue
        evidence = "name+value" if by_name and by_value else "value" if by_value else "name"
        out.append(Finding("compliance", "unmasked_pii_column", t.name, config.DESCRIPTIONS["unmasked_pii_column"].format(column=t.name, data_class=t.data_class.replace("_", " "), kind=t.semantic_type), t.data_class, total, scope="column", evidence={"classified_by": evidence, "match_rate_pct": round(t.rate * 100, 2), "semantic_type": t.semantic_type}, articles=articles(t.data_class, "unmasked_pii_column")))
    return out


def scan(df: DataFrame, wanted: dict[str, list[str]], issue: str, row: str = ROW) -> DataFrame:
    """issue_type, column, kind, row_id of cells that contain a pattern: every column and kind in one pass, without a shuffle."""
    if not any(wanted.values()):
        return df.sparkSession.createDataFrame([], CELL)
    records = []
    for name, kinds in wanted.items():
        text = as_text(normalised_column(name, df.schema[name].dataType), df.schema[name].dataType)
        records += [F.struct(F.lit(issue).alias("issue_type"), F.lit(name).alias("column"), F.lit(k).alias("kind"), F.coalesce(contains(text, config.PATTERNS[k]), F.lit(False)).alias("hit")) for k in kinds]
    return df.select(F.inline(F.array(*records)), F.col(row).cast("long").alias("row_id")).where("hit").drop("hit")


def freetext_scan(df: DataFrame, columns: list[str], row: str = ROW) -> DataFrame:
    return scan(df, {c: config.FREETEXT_KINDS for c in columns}, "pii_in_freetext", row)


def high_confidence_scan(df: DataFrame, types: list[Typed], row: str = ROW) -> DataFrame:
    """Unmistakable formats in columns that aren't free text and aren't typed as that kind."""
    wanted = {t.name: [k for k in config.HIGH_CONFIDENCE_KINDS if k != t.semantic_type] for t in types if not t.is_freetext}
    return scan(df, wanted, "pii_in_mislabeled_column", row)


def scan_findings(counts: list, types: list[Typed], total: int) -> list[Finding]:
    """Findings from (issue_type, column, kind, n) rows."""
    by = {t.name: t for t in types}
    out = []
    for r in sorted(counts, key=lambda r: (r["issue_type"], list(by).index(r["column"]), list(config.PATTERNS).index(r["kind"]))):
        kind, data_class = r["kind"].replace("_", " "), config.DATA_CLASS.get(r["kind"], config.NON_PERSONAL)
        text = config.DESCRIPTIONS[r["issue_type"]].format(n=r["n"], column=r["column"], kind=kind)
        evidence = {"pii_type": r["kind"]}
        if r["issue_type"] == "pii_in_mislabeled_column":
            evidence["column_classified_as"] = by[r["column"]].semantic_type
        out.append(Finding("compliance", r["issue_type"], r["column"], text, data_class, total, r["n"], evidence=evidence, articles=articles(data_class, "pii_in_freetext"), kind=r["kind"]))
    return out


def masked_preview(df: DataFrame, name: str, kind: str, rows: int = 3, row: str = ROW) -> DataFrame:
    """row_id and mask of the first non-null values (not normalised), in row order."""
    c = column(name)
    return df.where(c.isNotNull()).orderBy(row).limit(rows).select(F.col(row).alias("row_id"), mask(c, kind).alias("masked"))


def masked(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """df with the named columns masked by their kinds."""
    return df.withColumns({n: mask(column(n), k) for n, k in kinds.items()})
