"""Whole rows as values: canonical forms of cells of any type, and a 128-bit digest of a row.

Two cells are equal if their canonical forms are: maps whatever the order of their entries, NaN equal to NaN, -0.0 to 0.0, null to null, and a null element
different from a missing one. A digest doesn't depend on the order of a table's columns either. It only sorts rows into candidates: what decides is the values.
All of it are JVM expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakewarden.sources.tables import ROW, column


def whole_row(df: DataFrame) -> list[str]:
    """Names of all columns but the row number, nested ones included."""
    return [f.name for f in df.schema.fields if f.name != ROW]


def is_nested(kind: T.DataType) -> bool:
    return isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.VariantType))


def canonical(c: Column, kind: T.DataType) -> Column:
    """c as a value that can be grouped, sorted and compared: maps become sorted arrays of entries, at any depth, and every element and field carries whether it is null."""

    def marked(x: Column, of: T.DataType) -> Column:
        return F.struct(x.isNull().alias("none"), canonical(x, of).alias("is"))

    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: marked(x, kind.elementType))
    if isinstance(kind, T.MapType):
        entries = F.transform(F.map_entries(c), lambda e: F.struct(canonical(e["key"], kind.keyType).alias("key"), marked(e["value"], kind.valueType).alias("value")))
        return F.array_sort(entries)
    if isinstance(kind, T.StructType):
        fields = [marked(c.getField(f.name), f.dataType).alias(f"f{i}") for i, f in enumerate(kind.fields)]
        return F.when(c.isNotNull(), F.struct(*fields) if fields else F.lit(True))
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.when(F.isnan(c), F.lit(float("nan")).cast(kind)).when(c == 0, F.lit(0.0).cast(kind)).otherwise(c)
    if isinstance(kind, T.VariantType):
        return F.to_json(c)
    return c


def cells(df: DataFrame, names: list[str]) -> list[Column]:
    """The canonical forms of the named columns, as __c0, __c1, ..."""
    return [canonical(column(n), df.schema[n].dataType).alias(f"__c{i}") for i, n in enumerate(names)]


def digest(df: DataFrame, names: list[str]) -> Column:
    """A struct of two 64-bit hashes of the named columns' canonical forms, in the order of their names."""
    marked = []
    for n in sorted(names):
        c = canonical(column(n), df.schema[n].dataType)
        marked += [column(n).isNull(), c]
    return F.struct(*[F.xxhash64(F.lit(seed), *marked).alias(part) for seed, part in ((0x5DEECE66D, "d1"), (0x2545F4914F6CDD1D, "d2"))])


def candidates(df: DataFrame, names: list[str]) -> DataFrame:
    """df with its rows' digests as __digest: only rows whose digest another row has too. Digests are counted in each task before they are shuffled, and
    a digest that a third of all rows has meets its rows in a join whose other side has it once."""
    marked = df.withColumn("__digest", digest(df, names))
    shared = marked.groupBy("__digest").agg(F.count("*").alias("__n")).where("__n > 1").select("__digest")
    return marked.join(shared, "__digest", "left_semi")


def groups(df: DataFrame, names: list[str], *more: Column) -> DataFrame:
    """Rows that are equal in the named columns and occur more than once: __digest, __c0, ..., __n, and aggregates of other columns."""
    found = candidates(df, names).select("*", *cells(df, names))
    keys = [f"__c{i}" for i in range(len(names))]
    return found.groupBy("__digest", *keys).agg(F.count("*").alias("__n"), *more).where("__n > 1")


def repeats(df: DataFrame, names: list[str]) -> DataFrame:
    """One row, `n`: how many rows repeat an earlier one."""
    return groups(df, names).agg(F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("n"))


def later(df: DataFrame, names: list[str], order: str = ROW) -> DataFrame:
    """Rows that repeat an earlier one, by the column `order`."""
    firsts = groups(df, names, F.min(column(order)).alias("__first")).drop("__n")
    own = df.select(F.struct("*").alias("__row"), digest(df, names).alias("__own"), F.struct(*cells(df, names)).alias("__is"), column(order).alias("__at"))
    same = F.struct(*[F.col(f"__c{i}") for i in range(len(names))])
    return own.join(firsts, (F.col("__own") == F.col("__digest")) & F.col("__is").eqNullSafe(same) & (F.col("__at") > F.col("__first"))).select("__row.*")


def shared(df: DataFrame, names: list[str]) -> DataFrame:
    """All rows that occur more than once, the first included."""
    found = groups(df, names).drop("__n")
    own = df.select(F.struct("*").alias("__row"), digest(df, names).alias("__own"), F.struct(*cells(df, names)).alias("__is"))
    same = F.struct(*[F.col(f"__c{i}") for i in range(len(names))])
    return own.join(found, (F.col("__own") == F.col("__digest")) & F.col("__is").eqNullSafe(same), "left_semi").select("__row.*")
