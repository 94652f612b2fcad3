"""Decisions on findings as a stream: the current ones and the audit log follow the decision log, each entry exactly once.

Every batch of new entries writes two things under its number: its audit entries, and the latest entry of every finding up to then, made from the newest complete state of a smaller number. A
batch that is run again after a failure overwrites just these, from the same state, so that nothing is told twice or lost, wherever it stopped. What has been
decided is read from the newest complete state; the two before it are kept for readers, older ones are removed.

Entries may come late or out of order: the one decided last counts, as in `review.current`. Reopening what isn't decided at that time is no news and isn't audited.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lakewarden.operators import review
from lakewarden.sources.tables import AUDIT

_KEPT = 3


def _files(spark: SparkSession, path: str) -> tuple:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _complete(spark: SparkSession, out: str) -> list[int]:
    """Numbers of the states that were written to their end, in order."""
    fs, at = _files(spark, f"{out}/state")
    found = [s.getPath().toString() for s in fs.listStatus(at)] if fs.exists(at) else []
    numbers = [int(m[1]) for p in found if (m := re.search(r"/batch=(\d+)$", p))]
    return sorted(n for n in numbers if fs.exists(_files(spark, f"{out}/state/batch={n}/_SUCCESS")[1]))


def _state(spark: SparkSession, out: str, number: int | None) -> DataFrame:
    return spark.createDataFrame([], review.DECISION) if number is None else spark.read.schema(review.DECISION).parquet(f"{out}/state/batch={number}")


def _audited(before: DataFrame, batch: DataFrame, dataset: str) -> DataFrame:
    """The audit entries of a batch: each decision, and each reopening of one, with what had been decided."""
    both = before.withColumn("new", F.lit(False)).unionByName(batch.withColumn("new", F.lit(True)))
    order = Window.partitionBy("finding_id").orderBy("decided_at", "new", F.desc("decision"), F.desc("actor"))
    told = both.withColumn("previous", F.lag("decision").over(order)).where("new")
    reopens, decided = F.col("decision") == review.Decision.REOPENED.value, F.col("previous").isin(review.Decision.APPROVED.value, review.Decision.REJECTED.value)
    detail = F.when(reopens, F.to_json(F.struct("finding_id", F.col("previous").alias("previous_decision")))).otherwise(F.to_json(F.struct("finding_id", "note")))
    kept = told.where(~reopens | decided)
    return kept.select(F.col("decided_at").alias("timestamp"), "actor", F.concat(F.lit("review_"), "decision").alias("action"), F.lit(dataset).alias("dataset"), detail.alias("detail"))


def _latest(entries: DataFrame) -> DataFrame:
    order = Window.partitionBy("finding_id").orderBy(F.desc("decided_at"), "decision", "actor")
    return entries.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")


def apply(batch: DataFrame, number: int, out: str, dataset: str = "") -> None:
    """Writes the audit entries and the state of batch `number`; may be run again."""
    spark = batch.sparkSession
    held = [n for n in _complete(spark, out) if n < number]
    before = _state(spark, out, held[-1] if held else None)
    batch = batch.where("finding_id is not null and decision is not null").dropDuplicates()
    _audited(before, batch, dataset).write.mode("overwrite").json(f"{out}/audit/batch={number}")
    _latest(before.unionByName(batch)).write.mode("overwrite").parquet(f"{out}/state/batch={number}")
    for old in held[: -(_KEPT - 1)]:
        fs, at = _files(spark, f"{out}/state/batch={old}")
        fs.delete(at, True)


def follow(spark: SparkSession, log: str, out: str, dataset: str = "", each: int | None = None) -> StreamingQuery:
    """Starts a query that takes what has come to the decision log since it last ran, `each` files a batch at most."""
    source = spark.readStream.schema(review.DECISION)
    if each:
        source = source.option("maxFilesPerTrigger", each)
    write = source.json(log).writeStream.foreachBatch(lambda batch, number: apply(batch, number, out, dataset))
    return write.option("checkpointLocation", f"{out}/progress").trigger(availableNow=True).start()


def current(spark: SparkSession, out: str) -> DataFrame:
    """The latest decision of each finding that isn't reopened."""
    held = _complete(spark, out)
    return _state(spark, out, held[-1] if held else None).where(F.col("decision") != review.Decision.REOPENED.value)


def audit(spark: SparkSession, out: str) -> DataFrame:
    """All audit entries, with the number of their batch."""
    fs, at = _files(spark, f"{out}/audit")
    if not fs.exists(at):
        return spark.createDataFrame([], AUDIT + ", batch int")
    return spark.read.schema(AUDIT + ", batch int").option("basePath", f"{out}/audit").json(f"{out}/audit")
