"""Found keys against expected keys: hits, misses and false alarms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["defect_type", "column", "row_id"]


def keys(findings: DataFrame, cells: DataFrame) -> DataFrame:
    """Distinct (defect_type, column, row_id): a row a cell, and a null row for findings of whole columns."""
    whole = findings.where("scope = 'column'").select(F.col("issue_type").alias("defect_type"), "column", F.lit(None).cast("long").alias("row_id"))
    return cells.select(F.col("issue_type").alias("defect_type"), "column", "row_id").unionByName(whole).distinct()


def ground_truth(entries: DataFrame) -> DataFrame:
    """Keys from entries (defect_type, column, rows): a row each, null for entries without rows."""
    return entries.select("defect_type", "column", F.explode_outer("rows").alias("row_id")).distinct()


def compared(expected: DataFrame, observed: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Every key of either side with expected and observed; null rows are equal."""
    both = expected.select(*key).distinct().withColumn("e", F.lit(1)).withColumn("o", F.lit(0)).unionByName(observed.select(*key).distinct().withColumn("e", F.lit(0)).withColumn("o", F.lit(1)))
    return both.groupBy(*key).agg((F.max("e") == 1).alias("expected"), (F.max("o") == 1).alias("observed"))


def metrics(marks: DataFrame, by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, precision, recall and f1; nothing observed or expected counts as perfect, f1 of two zeros as 0."""
    counts = marks.groupBy(*(by or [])).agg(F.count_if(F.col("expected") & F.col("observed")).alias("tp"), F.count_if(~F.col("expected") & F.col("observed")).alias("fp"), F.count_if(F.col("expected") & ~F.col("observed")).alias("fn"))
    tp = F.col("tp").cast("double")
    out = counts.withColumn("precision", F.when(F.col("tp") + F.col("fp") > 0, tp / (F.col("tp") + F.col("fp"))).otherwise(1.0)).withColumn("recall", F.when(F.col("tp") + F.col("fn") > 0, tp / (F.col("tp") + F.col("fn"))).otherwise(1.0))
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0))


def meets_targets(scores: DataFrame, recall: float = 0.95, precision: float = 0.80) -> DataFrame:
    """scores with whether both targets are met."""
    return scores.withColumn("meets_targets", (F.col("recall") >= recall) & (F.col("precision") >= precision))


def listing(marks: DataFrame, missed: bool, n: int = 15) -> DataFrame:
    """The first missed keys or false alarms, in order."""
    return marks.where("expected and not observed" if missed else "observed and not expected").orderBy(*[c for c in marks.columns if c not in ("expected", "observed")]).limit(n)


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether both hold the same rows, repeats counted."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
