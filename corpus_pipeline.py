"""From raw documents to packed token sequences, one operator a stage.

Each stage takes what its predecessor kept and returns the columns of documents; the last returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewarden.llm import mixing, near_dup, packing, pii, quality
from lakewarden.llm.common import cut, numbered, removed, scratch, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted to labelled rows of docs, doesn't reject. Null ids, null texts and repeated rows are judged as any; no rows give none."""
    return quality.passing(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates by sets of five words: the one with the smallest doc_id, null last.

    Rows are told apart by a number, as ids may be null or repeated. Rows without words are in no group and stay."""
    rows = numbered(docs)
    found = near_dup.near_duplicates(rows.select(F.col("n").alias("doc_id"), F.col("row.text").alias("text")), k=5, percent=80)
    groups = cut(found.select(F.col("doc_id").alias("n"), F.col("component_id").alias("group")))
    crowded = groups.groupBy("group").agg(F.count("*").alias("members")).where("members > 1").select("group")
    members = groups.join(crowded, "group").join(rows.select("n", F.col("row.doc_id").cast("long").alias("id")), "n")
    first = members.groupBy("group").agg(F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "n"))["n"].alias("first"))
    gone = members.join(first, "group").where("n <> first").select("n")
    return rows.join(gone, "n", "left_anti").select("row.*")


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; n_chars follows the text. Null texts stay null; null and repeated ids make no difference, and no rows give none."""
    out = pii.redacted(docs, pii.fit(docs))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in the order of their virtual finish times. Rows are told apart by a number, so that null and repeated ids don't mix
    them up; documents without words are never taken; no rows give none."""
    return mixing.mixture(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences. A null or empty text is its end id; null and repeated ids are packed as any; no rows give none."""
    return packing.pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_dup", near_dup_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Two stages run trained models, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in turn, each written to the shared folder and read again; a table is removed when the next is written. The last is returned as it is."""
    base, last = scratch(spark, "pipeline"), None
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        if last:
            removed(spark, f"{base}/{last}")
        last = name
    return STAGES[-1][1](spark, docs, sf_dir)
