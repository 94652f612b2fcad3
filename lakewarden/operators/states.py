"""Profiles as mergeable states: one row for each column and part (a file, a day), made by passes that shuffle no values, and merged without the data.

What a state keeps: counts, sums, least and largest numbers; a HyperLogLog sketch of the values as text (2^12 registers, a relative standard error of about 1.3%); a frequent-items sketch of
TRACKED values, whose counts are off by less than ERROR of the part's values; and the first different values in row order, which are exact. Merged states are those of
all rows together, but for the sketches' errors and the order in which fractions are added.

First values are found in two passes. The first takes the least row number of each of SLICES slices of a column's values: rows of different values, so that the
k-th least of them bounds where the k-th new value comes at the latest. The second groups values up to that row only. A column with values in fewer than k slices has so few of them that all
are grouped.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakewarden import config
from lakewarden.functions.columns import as_text, normalised_column
from lakewarden.operators.profiling import is_numeric, profiled_fields
from lakewarden.sources.tables import ROW, with_row_id

TRACKED, SLICES, SAMPLES = 1000, 64, 5
#: 3.5 over the sketch's size, the power of two from TRACKED / 0.75 on.
ERROR = 3.5 / 2048
_WIDE = 40

FIRSTS = "array<struct<row:bigint,value:string>>"


def states(df: DataFrame, part: Column | None = None, samples: int = SAMPLES) -> DataFrame:
    """part, name and the state of each column of df in each part."""
    df = with_row_id(df).withColumn("__part", (F.lit("") if part is None else part).cast("string"))
    fields = [f for f in profiled_fields(df) if f.name != "__part"]
    out = None
    for i in range(0, max(len(fields), 1), _WIDE):
        one = _counted(df, fields[i : i + _WIDE])
        out = one if out is None else out.unionByName(one)
    return out.join(_firsts(df, fields, samples), ["part", "name"], "left").withColumn("firsts", F.coalesce("firsts", F.array().cast(FIRSTS)))


def _counted(df: DataFrame, fields: list[T.StructField]) -> DataFrame:
    cells, aggs = [], [F.count(F.lit(1)).alias("rows")]
    for i, f in enumerate(fields):
        c = normalised_column(f.name, f.dataType)
        number = (c.cast("int") if isinstance(f.dataType, T.BooleanType) else c).cast("double") if is_numeric(f.dataType) else F.lit(None).cast("double")
        length = F.length(c).cast("long") if isinstance(f.dataType, T.StringType) else F.lit(None).cast("long")
        cells += [as_text(c, f.dataType).alias(f"t{i}"), number.alias(f"x{i}"), length.alias(f"l{i}")]
        aggs += [F.count(f"t{i}").alias(f"n{i}"), F.sum(f"l{i}").alias(f"length{i}"), F.min(f"x{i}").alias(f"min{i}"), F.max(f"x{i}").alias(f"max{i}"), F.sum(f"x{i}").alias(f"sum{i}")]
        aggs += [F.hll_sketch_agg(f"t{i}", 12).alias(f"hll{i}"), F.expr(f"approx_top_k_accumulate(t{i}, {TRACKED}) FILTER (WHERE t{i} IS NOT NULL)").alias(f"top{i}")]
    rows = df.select("__part", *cells).groupBy("__part").agg(*aggs)
    records = [
        F.struct(
            F.lit(f.name).alias("name"), F.lit(f.dataType.simpleString()).alias("dtype"), F.col(f"n{i}").alias("filled"), F.col(f"length{i}").alias("length"),
            F.col(f"min{i}").alias("least"), F.col(f"max{i}").alias("most"), F.col(f"sum{i}").alias("total"), F.col(f"hll{i}").alias("distinct"), F.col(f"top{i}").alias("frequent"),
        )
        for i, f in enumerate(fields)
    ]
    if not records:
        nothing = F.struct(F.lit("").alias("name"), F.lit("").alias("dtype"), *[F.lit(0).cast("long").alias(c) for c in ("filled", "length")], *[F.lit(0.0).alias(c) for c in ("least", "most", "total")])
        return rows.select(F.col("__part").alias("part"), "rows", nothing.alias("c")).select("part", "rows", "c.*").where("false")
    return rows.select(F.col("__part").alias("part"), "rows", F.inline(F.array(*records)))


def _firsts(df: DataFrame, fields: list[T.StructField], samples: int) -> DataFrame:
    if not fields:
        return df.sparkSession.createDataFrame([], f"part string, name string, firsts {FIRSTS}")
    cells = [F.struct(F.lit(f.name).alias("name"), as_text(normalised_column(f.name, f.dataType), f.dataType).alias("value")) for f in fields]
    long = df.select(F.col("__part").alias("part"), F.col(ROW).cast("long").alias("row"), F.inline(F.array(*cells))).where("value is not null")
    slices = long.groupBy("part", "name", F.pmod(F.xxhash64("value"), F.lit(SLICES)).alias("slice")).agg(F.min("row").alias("row"))
    bounds = slices.groupBy("part", "name").agg(F.array_sort(F.collect_list("row")).alias("rows")).select("part", "name", F.get("rows", F.lit(samples - 1)).alias("bound"))
    early = long.join(bounds, ["part", "name"]).where("bound is null or row <= bound")
    return _first(early.groupBy("part", "name", "value").agg(F.min("row").alias("row")), ["part", "name"], ["row", "value"], samples)


def _first(values: DataFrame, keys: list[str], order: list[str], samples: int) -> DataFrame:
    """The first values of each key as a list in order; few values a key come here."""
    kept = values.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__r") <= samples)
    listed = kept.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__r", "row", "value"))).alias("firsts"))
    return listed.withColumn("firsts", F.transform("firsts", lambda x: F.struct(x["row"].alias("row"), x["value"].alias("value"))))


def merged(parts: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """The states of all parts together, one a column. Rows are in the order of their parts, then of their numbers."""
    sums = [F.sum(c).alias(c) for c in ("rows", "filled", "length", "total")]
    ends = [F.max("dtype").alias("dtype"), F.min("least").alias("least"), F.max("most").alias("most")]
    sketches = [F.hll_union_agg("distinct").alias("distinct"), F.expr(f"approx_top_k_combine(frequent, {TRACKED})").alias("frequent")]
    one = parts.groupBy("name").agg(*sums, *ends, *sketches)
    values = parts.select("name", "part", F.inline("firsts")).groupBy("name", "value").agg(F.min(F.struct("part", "row")).alias("at"))
    firsts = _first(values.select("name", "value", "at", F.col("at.row").alias("row")), ["name"], ["at", "value"], samples)
    return one.join(firsts, "name", "left").withColumn("firsts", F.coalesce("firsts", F.array().cast(FIRSTS)))


def profile_of(parts: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """A profile, as `profiling.profile` gives it, from states. Distinct counts are estimates; near_constant may err where the commonest value's share is within ERROR of the limit."""
    m = merged(parts, samples)
    filled, null = F.col("filled"), F.lit(None).cast("double")
    top = F.get(F.expr("approx_top_k_estimate(frequent, 1)"), F.lit(0))["count"]
    distinct = F.least(F.coalesce(F.hll_sketch_estimate("distinct"), F.lit(0)), filled)
    nulls = F.col("rows") - filled
    text = F.col("dtype") == "string"
    return m.select(
        "name", "dtype", "rows", nulls.alias("null_count"), F.when(F.col("rows") > 0, F.bround(nulls * 100.0 / F.col("rows"), 2)).alias("null_pct"), distinct.alias("distinct_count"),
        F.bround(distinct * 100.0 / F.greatest(filled, F.lit(1)), 2).alias("distinct_pct"), F.transform("firsts", lambda x: x["value"]).alias("samples"), (distinct <= 1).alias("is_constant"),
        F.coalesce(top / F.when(filled > 0, filled) > config.NEAR_CONSTANT, F.lit(False)).alias("near_constant"), F.when(text & (filled > 0), F.col("length") / filled).otherwise(null).alias("mean_length"),
        F.col("least").alias("numeric_min"), F.col("most").alias("numeric_max"), F.when(filled > 0, F.col("total") / filled).alias("numeric_mean"),
    )


def append_states(parts: DataFrame, path: str) -> None:
    """Adds states to the table at path. A part that it holds already isn't added again."""
    held = read_states(parts.sparkSession, path)
    new = parts if held is None else parts.join(held.select("part", "name"), ["part", "name"], "left_anti")
    new.write.mode("append").parquet(path)


def read_states(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:  # none written yet
        return None


def update_states(df: DataFrame, path: str) -> DataFrame:
    """The states of all files of df, a plain scan of Parquet: files that the table at path doesn't hold yet are read and added, others aren't opened for their columns."""
    spark, file = df.sparkSession, F.col("_metadata.file_path")
    held = read_states(spark, path)
    known = [] if held is None else [r["part"] for r in held.select("part").distinct().collect()]  # a row a file
    new = df.where(~file.isin(known)) if known else df
    rows = new.select("*", F.col("_metadata.row_index").alias(ROW), file.alias("__file"))
    if held is None or not rows.isEmpty():
        append_states(states(rows, F.col("__file")).where("name <> '__file'"), path)
    return read_states(spark, path)
