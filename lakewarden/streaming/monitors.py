"""Checks on streams, beyond what a batch report has: the same expressions on micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lakewarden import config
from lakewarden.functions.columns import contains
from lakewarden.sources.tables import column


def read(spark: SparkSession, path: str, like: DataFrame, files: int = 1) -> DataFrame:
    """A stream over the parquet files of a folder, with the schema of `like`."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files).parquet(path)


def hits(stream: DataFrame, name: str, key: str) -> DataFrame:
    """key and kind of each pattern that a text contains; stateless."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), contains(column(name), config.PATTERNS[k]).alias("hit")) for k in config.FREETEXT_KINDS])
    return stream.select(F.col(key), F.inline(kinds)).where("hit").drop("hit")


def counts(stream: DataFrame, time: str = "ts", by: str = "event_type", late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events, missing values and mean value by time window, for events at most `late` late."""
    w = F.window(time, width)
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(w, by).agg(F.count("*").alias("n"), F.count_if(F.col("value").isNull()).alias("missing"), F.avg("value").alias("mean_value")).select(F.col("window.start").alias("window_start"), by, "n", "missing", "mean_value")


def first_only(stream: DataFrame, keys: list[str], time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Rows without repeats of a key within the watermark."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def append_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes what is there now to a JSON log, once each."""
    return stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def gather(updates: DataFrame, keys: list[str], out: str) -> DataFrame:
    """The last values of each key of a stream of updates, after all that is there now.

    Each batch's updates are a table of their own, which a batch that is run again overwrites; nothing is held by the driver."""
    spark = updates.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/updates/batch={number}")

    query = updates.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{out}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    values = F.struct(*[column(c) for c in updates.columns if c not in keys])
    held = spark.read.schema(T.StructType([*updates.schema.fields, T.StructField("batch", T.LongType())])).option("basePath", f"{out}/updates").parquet(f"{out}/updates")
    return held.groupBy(*keys).agg(F.max_by(values, "batch").alias("__last")).select(*keys, "__last.*")
