"""One record for each column of a table."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakewarden import config
from lakewarden.functions.columns import as_text, normalised_column
from lakewarden.functions.rows import repeats, whole_row
from lakewarden.sources.tables import ROW, column

SIMPLE = (T.StringType, T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def profiled_fields(df: DataFrame) -> list[T.StructField]:
    """Columns that can be profiled: all but the row number and nested ones."""
    return [f for f in df.schema.fields if f.name != ROW and isinstance(f.dataType, SIMPLE)]


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, (T.NumericType, T.BooleanType))


def _number(c: Column, kind: T.DataType) -> Column:
    return (c.cast("int") if isinstance(kind, T.BooleanType) else c).cast("double")


def in_chunks(fields: list[T.StructField], one: Callable[[list[T.StructField]], DataFrame], size: int = 60) -> DataFrame:
    """What `one` gives for so many columns at a time, so that a wide table's aggregates still compile."""
    return reduce(DataFrame.unionByName, [one(fields[i : i + size]) for i in range(0, max(len(fields), 1), size)])


def basics(df: DataFrame) -> DataFrame:
    """name, dtype, rows, null_count, null_pct, mean_length, numeric_min, numeric_max, numeric_mean: one pass without a distinct for each 60 columns."""
    return in_chunks(profiled_fields(df), lambda fields: _basics(df, fields))


def _basics(df: DataFrame, fields: list[T.StructField]) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, f in enumerate(fields):
        c = normalised_column(f.name, f.dataType)
        aggs.append(F.count(c).alias(f"n{i}"))
        if isinstance(f.dataType, T.StringType):
            aggs.append(F.avg(F.length(c)).alias(f"len{i}"))
        if is_numeric(f.dataType):
            x = _number(c, f.dataType)
            aggs += [F.min(x).alias(f"min{i}"), F.max(x).alias(f"max{i}"), F.avg(x).alias(f"avg{i}")]
    row = df.agg(*aggs)
    null = F.lit(None).cast("double")
    names, records = set(row.columns), []
    for i, f in enumerate(fields):
        has = lambda name: f"{name}{i}" in names  # noqa: B023, E731
        nulls = F.col("rows") - F.col(f"n{i}")
        records.append(
            F.struct(
                F.lit(f.name).alias("name"),
                F.lit(f.dataType.simpleString()).alias("dtype"),
                F.col("rows"),
                nulls.alias("null_count"),
                F.when(F.col("rows") > 0, F.bround(nulls * 100.0 / F.col("rows"), 2)).alias("null_pct"),
                (F.col(f"len{i}") if has("len") else null).alias("mean_length"),
                *[(F.col(f"{k}{i}") if has(k) else null).alias(f"numeric_{n}") for k, n in (("min", "min"), ("max", "max"), ("avg", "mean"))],
            )
        )
    if not records:
        return df.sparkSession.createDataFrame([], "name string, dtype string, rows long, null_count long, null_pct double, mean_length double, numeric_min double, numeric_max double, numeric_mean double")
    return row.select(F.inline(F.array(*records)))


def values(df: DataFrame) -> DataFrame:
    """(name, value, row): one row a non-null cell, values as text."""
    cells = [F.struct(F.lit(f.name).alias("name"), as_text(normalised_column(f.name, f.dataType), f.dataType).alias("value")) for f in profiled_fields(df)]
    row = F.col(ROW) if ROW in df.columns else F.monotonically_increasing_id()
    return df.select(row.alias("row"), F.inline(F.array(*cells))).where("value is not null")


def distincts(df: DataFrame, samples: int = 5) -> DataFrame:
    """name, distinct_count, top_count, non_null, samples (first values in row order): one shuffle on (name, value).

    Samples are the first of each slice of a column's values, then of these, so that no task sorts all values of a column."""
    counted = values(df).groupBy("name", "value").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    totals = counted.groupBy("name").agg(F.count("*").alias("distinct_count"), F.max("n").alias("top_count"), F.sum("n").alias("non_null"))
    # A slice of the values of each column by their hash is cut to its first ones before a column's slices come together.
    firsts = counted.withColumn("slice", F.pmod(F.xxhash64("value"), F.lit(64)))
    for part in (["slice"], []):
        place = Window.partitionBy("name", *part).orderBy("first", "value")
        firsts = firsts.withColumn("place", F.row_number().over(place)).where(F.col("place") <= samples)
    listed = firsts.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]).alias("samples"))
    return totals.join(listed, "name", "left")


def profile(df: DataFrame, exact: bool = True) -> DataFrame:
    """name, dtype, rows, null_count, null_pct, distinct_count, distinct_pct, samples, is_constant, near_constant, mean_length, numeric_min, numeric_max, numeric_mean.

    With exact=False it comes from mergeable sketches, for tables whose values are too many to shuffle: distinct counts are estimates, and near_constant may err close to its limit."""
    if not exact:
        from lakewarden.operators import states

        return states.profile_of(states.states(df))
    joined = basics(df).join(F.broadcast(distincts(df)), "name", "left")  # one row a column on both sides
    distinct, filled = F.coalesce("distinct_count", F.lit(0)), F.coalesce("non_null", F.lit(0))
    return joined.select(
        "name",
        "dtype",
        "rows",
        "null_count",
        "null_pct",
        distinct.alias("distinct_count"),
        F.bround(distinct * 100.0 / F.greatest(filled, F.lit(1)), 2).alias("distinct_pct"),
        F.coalesce("samples", F.array().cast("array<string>")).alias("samples"),
        (distinct <= 1).alias("is_constant"),
        F.coalesce(F.col("top_count") / F.col("non_null") > config.NEAR_CONSTANT, F.lit(False)).alias("near_constant"),
        "mean_length",
        "numeric_min",
        "numeric_max",
        "numeric_mean",
    )


def quick_stats(df: DataFrame, not_negative: list[str] = ()) -> DataFrame:
    """stat, value: null share of each column, repeated whole rows (nested columns are part of both), negative values of the named columns."""
    names = whole_row(df)
    shares = [F.avg(column(n).isNull().cast("double")).alias(f"null share {n}") for n in names]
    wrong = [F.count_if(column(c) < 0).cast("double").alias(f"negative {c}") for c in not_negative]
    repeated = repeats(df, names).select(F.lit("repeated rows").alias("stat"), F.col("n").cast("double").alias("value"))
    row = df.agg(*shares, *wrong)
    listed = row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("stat"), column(c).alias("value")) for c in row.columns])))
    return listed.unionByName(repeated)
