"""The best of each query."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_k(scored: DataFrame, k: int, floor: float | None, by: str = "query_id", tie: str = "chunk_no") -> DataFrame:
    """The k best of each query above the floor (exclusive), ties to the smaller passage number."""
    if floor is not None:
        scored = scored.where(F.col("score") > floor)
    order = Window.partitionBy(by).orderBy(F.desc("score"), tie)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
