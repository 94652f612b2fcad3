"""What each column holds: inferred from its name, then from its values."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakewarden import config
from lakewarden.functions.columns import as_text, as_timestamp, normalised_column, whole_match
from lakewarden.operators.profiling import in_chunks, profiled_fields
from lakewarden.sources.tables import column, normal_name

_HINTS = sorted(((hint, kind) for kind, hints in config.NAME_HINTS.items() for hint in hints), key=lambda h: -len(h[0]))


def type_from_name(name: str) -> str | None:
    """The type of the longest hint in the name."""
    plain = normal_name(name)
    return next((kind for hint, kind in _HINTS if hint in plain), None)


def match_rates(df: DataFrame) -> DataFrame:
    """name, non_null, date_rate and one rate a pattern: the share of non-null values that match as a whole.

    Cells are unpivoted within their rows, so that one small set of expressions serves all columns; what is shuffled is a row a column and task."""
    return in_chunks(profiled_fields(df), lambda fields: _rates(df, fields), 200)


def _rates(df: DataFrame, fields: list[T.StructField]) -> DataFrame:
    kinds = "name string, non_null long, date_rate double, " + ", ".join(f"{k} double" for k in config.PATTERNS)
    if not fields:
        return df.sparkSession.createDataFrame([], kinds)
    cells = []
    for i, f in enumerate(fields):
        text = as_text(normalised_column(f.name, f.dataType), f.dataType)
        cells.append(F.struct(F.lit(i).alias("i"), text.alias("value"), F.lit(isinstance(f.dataType, T.StringType)).alias("dated")))
    long = df.select(F.inline(F.array(*cells))).where("value is not null")
    value = F.col("value")
    is_date = F.col("dated") & as_timestamp(value, T.StringType()).isNotNull()
    rates = long.groupBy("i").agg(F.count("*").alias("non_null"), F.avg(is_date.cast("double")).alias("date_rate"), *[F.avg(whole_match(value, p).cast("double")).alias(k) for k, p in config.PATTERNS.items()])
    names = df.sparkSession.createDataFrame([(i, f.name) for i, f in enumerate(fields)], "i int, name string")
    filled = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("date_rate", *config.PATTERNS)]
    return rates.join(F.broadcast(names), "i", "right").select("name", F.coalesce("non_null", F.lit(0)).alias("non_null"), *filled)


@dataclass(frozen=True)
class Typed:
    name: str
    semantic_type: str
    type_evidence: str
    data_class: str
    is_freetext: bool
    rate: float  # of whole-cell matches of the type's own pattern; 0 if it has none
    filled: int = 0  # cells that aren't missing


def infer(name: str, kind: T.DataType, rates: Row, mean_length: float | None) -> Typed:
    """By name; else by the best-matching pattern; else numeric, date, free text or categorical."""
    by_value = [(rates[k], k) for k in config.PATTERNS if k not in config.NAME_ONLY_KINDS]
    best = max(by_value, key=lambda x: x[0])  # the first of equals
    found, evidence = type_from_name(name), "name"
    if found is None and rates["non_null"] and best[0] >= config.TYPE_MATCH:
        found, evidence = best[1], "value"
    if found is None and isinstance(kind, (T.NumericType, T.BooleanType)):
        found, evidence = "numeric", "dtype"
    if found is None and (isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)) or rates["date_rate"] >= config.DATE_MATCH):
        found, evidence = "date", "value"
    if found is None:
        long = mean_length is not None and mean_length > config.FREETEXT_LENGTH
        found, evidence = ("free_text", "length") if long else ("categorical", "default")
    rate = rates[found] if found in config.PATTERNS else 0.0
    return Typed(name, found, evidence, config.DATA_CLASS.get(found, config.NON_PERSONAL), found == "free_text", rate, rates["non_null"])


def typed_columns(df: DataFrame, profiles: DataFrame | list[Row], rates: list[Row] | None = None) -> list[Typed]:
    """One entry a column; a few numbers a column reach the driver. Of the profiles, `basics` suffice. rates: rows of `match_rates`, if it has run already."""
    kinds = {f.name: f.dataType for f in profiled_fields(df)}
    rows = profiles.select("name", "mean_length").collect() if isinstance(profiles, DataFrame) else profiles
    lengths = {r["name"]: r["mean_length"] for r in rows}
    by_name = {r["name"]: r for r in (match_rates(df).collect() if rates is None else rates)}
    return [infer(n, k, by_name[n], lengths.get(n)) for n, k in kinds.items()]


def catalog(df: DataFrame, profiles: DataFrame, types: list[Typed] | None = None) -> DataFrame:
    """profiles with semantic_type, type_evidence, data_class and is_freetext."""
    types = typed_columns(df, profiles) if types is None else types
    rows = [(t.name, t.semantic_type, t.type_evidence, t.data_class, t.is_freetext) for t in types]
    small = df.sparkSession.createDataFrame(rows, "name string, semantic_type string, type_evidence string, data_class string, is_freetext boolean")
    return profiles.join(F.broadcast(small), "name", "left")
