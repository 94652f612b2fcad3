"""Reading and writing: tables with row numbers, CSV with missing-value tokens, regulation texts, reports, logs."""

from __future__ import annotations

import json
import tempfile
import time
from collections.abc import Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql.window import WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakewarden import config

ROW = "_row_id"


def shared_folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names. Where it names none, one of our own serves in local mode; a cluster must name one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lakewarden-"))
    return sc.getCheckpointDir()


def _nodes(plan: object) -> Iterator[object]:
    yield plan
    for i in range(plan.children().size()):
        yield from _nodes(plan.children().apply(i))


def _kinds(df: DataFrame) -> set[str]:
    """Names of the steps of df's plan; with a step that isn't deterministic also "random"."""
    nodes = list(_nodes(df._jdf.queryExecution().analyzed()))
    return {n.nodeName() for n in nodes} | ({"random"} if not all(n.deterministic() for n in nodes) else set())


def file_starts(df: DataFrame) -> list[tuple[str, int, int]] | None:
    """File, number of its first row and of its rows, in the order of paths, if df is a plain scan of Parquet; else None.

    One aggregate that reads no column: a row group gives its rows' places. A row a file reaches the driver, which lists all files in any case."""
    if "_metadata" in df.columns or not _kinds(df) <= {"LogicalRelation", "Project", "SubqueryAlias"}:
        return None
    try:
        at = df.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"))
    except AnalysisException:  # not Parquet
        return None
    out, total = [], 0
    for r in sorted(at.groupBy("file").agg(F.max("place").alias("last")).collect()):
        out.append((r["file"], total, r["last"] + 1))
        total += r["last"] + 1
    return out


def _numbered_by_files(df: DataFrame, files: list[tuple[str, int, int]]) -> DataFrame:
    starts = df.sparkSession.createDataFrame([f[:2] for f in files], "__file string, __start long")
    placed = df.select("*", F.col("_metadata.file_path").alias("__path"), F.col("_metadata.row_index").alias("__place"))
    joined = placed.join(F.broadcast(starts), F.col("__path") == F.col("__file"))  # one row a file
    return joined.withColumn(ROW, F.col("__start") + F.col("__place")).drop("__path", "__place", "__file", "__start")


def with_row_id(df: DataFrame) -> DataFrame:
    """df with a dense row number from 0 that stays the same whenever and in however many parts df is computed.

    Rows of a plain scan of Parquet are numbered by their place in their file, files by path. Other rows are numbered by partition and place: one extra pass
    counts each partition's rows, and one number a partition reaches the driver. Where partitions could differ between the two passes, or when a lost task is run again (behind
    a shuffle, say), df is first written to the shared folder. Where a table has a key of its own, use that instead."""
    if ROW in df.columns:
        return df
    files = file_starts(df)
    if files:
        return _numbered_by_files(df, files)
    if not _kinds(df) <= {"LogicalRelation", "LocalRelation", "Range", "Project", "Filter", "SubqueryAlias"}:
        shared_folder(df.sparkSession)
        df = df.checkpoint(eager=True)
    at = F.monotonically_increasing_id()  # partition in the upper bits, place in the lower 33
    counts = df.select(F.shiftright(at, 33).alias("p")).groupBy("p").count().collect()
    starts, total = [], 0
    for r in sorted(counts, key=lambda r: r["p"]):
        starts.append((r["p"], total))
        total += r["count"]
    offsets = df.sparkSession.createDataFrame(starts, "__p long, __start long")
    numbered = df.withColumn("__at", at).withColumn("__q", F.shiftright("__at", 33))
    joined = numbered.join(F.broadcast(offsets), F.col("__q") == F.col("__p"))  # one row a partition
    return joined.withColumn(ROW, F.col("__start") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__at", "__q", "__p", "__start")


def store_numbered(df: DataFrame, path: str) -> DataFrame:
    """df written with its row number as a column, sorted within files, so that `block` reads only the row groups that hold the rows asked for."""
    with_row_id(df).sortWithinPartitions(ROW).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def unique_names(names: list[str]) -> tuple[list[str], dict[str, str]]:
    """Headers made unique as x, x.1 and so on (never one that is taken), and what was renamed."""
    taken, out, renamed = set(names), [], {}
    seen: set[str] = set()
    for n in names:
        new, i = n, 0
        while new in seen or i and new in taken:
            i += 1
            new = f"{n}.{i}"
        if new != n:
            renamed[new] = n
        seen.add(new)
        out.append(new)
    return out, renamed


def normal_name(name: str) -> str:
    """Lower-case letters and digits of a name."""
    return "".join(c for c in str(name).lower() if c.isalnum())


def column(name: str) -> Column:
    """A column by its exact name, also with dots or spaces."""
    return F.col("`" + name.replace("`", "``") + "`")


def _has_broken_cells(spark: SparkSession, path: str) -> bool:
    """Whether a quoted cell may hold a line break: then some line has an odd number of quotes. Files without one are read by many tasks."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return not spark.read.text(path).where(quotes % 2 == 1).isEmpty()


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header. Missing-value tokens become null before types are inferred: a column is
    long or double if every other value is one, else text."""
    broken = _has_broken_cells(spark, path)
    raw = spark.read.csv(path, header=False, multiLine=broken, escape='"')
    head = raw.first()
    if head is None:
        return spark.createDataFrame([], T.StructType([]))
    names, _ = unique_names([h if h is not None else f"Unnamed: {i}" for i, h in enumerate(head)])
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    first = spark.read.csv(path, header=True, multiLine=broken, escape='"', inferSchema=False, enforceSchema=True, schema=schema)
    cells = first.select([F.when(~F.col(f"c{i}").isin(config.CSV_NULLS), F.col(f"c{i}")).alias(f"c{i}") for i in range(len(names))])
    tests = []
    for i in range(len(names)):
        c = F.col(f"c{i}")
        tests += [F.count(c).alias(f"n{i}"), F.count(F.when(c.rlike(r"\A\s*[+-]?[0-9]{1,18}\s*\z"), 1)).alias(f"l{i}"), F.count(F.when(c.try_cast("double").isNotNull(), 1)).alias(f"d{i}")]
    got = cells.agg(*tests).first()
    kinds = ["bigint" if got[f"n{i}"] and got[f"l{i}"] == got[f"n{i}"] else "double" if got[f"n{i}"] and got[f"d{i}"] == got[f"n{i}"] else "string" for i in range(len(names))]
    return cells.select([F.trim(f"c{i}").cast(k) if k != "string" else F.col(f"c{i}") for i, k in enumerate(kinds)]).toDF(*names)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def block(df: DataFrame, start: int, rows: int) -> DataFrame:
    """Neighbouring rows by number, not a sample.

    A table that was stored with its numbers is asked for a range of them, which skips files and row groups by their statistics. Of a plain scan of Parquet only the files that hold
    the rows are read, by their places. Anything else is numbered first."""
    if ROW not in df.columns:
        files = file_starts(df)
        if files is None:
            df = with_row_id(df)
        else:
            held = [f for f in files if f[1] < start + rows and f[1] + f[2] > start]
            df = _numbered_by_files(df.where(F.col("_metadata.file_path").isin([f[0] for f in held])), held)
    return df.where(F.col(ROW).between(start, start + rows - 1))


def read_regulations(spark: SparkSession, path: str) -> DataFrame:
    """chunk_no, reference, title, text, source, is_placeholder of each `## reference | title` part of the markdown files under path."""
    files = spark.read.option("pathGlobFilter", "*.md").text(path, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("source"), F.col("value"))
    parts = files.select("source", F.contains(F.left("value", F.lit(2000)), F.lit("PLACEHOLDER")).alias("is_placeholder"), F.posexplode(F.split("value", r"(?m)^##[ \t]+(?=[^|\n]+\|)")).alias("part", "body")).where("part > 0")
    named = parts.select("source", "part", "is_placeholder", F.regexp_extract("body", r"\A([^|\n]+?)[ \t]*\|[ \t]*([^\n]+?)[ \t]*(?:\r?\n|\z)", 1).alias("reference"), F.regexp_extract("body", r"\A([^|\n]+?)[ \t]*\|[ \t]*([^\n]+?)[ \t]*(?:\r?\n|\z)", 2).alias("title"), F.trim(F.regexp_replace(F.regexp_replace("body", r"\A[^\n]*", ""), r"\s+", " ")).alias("text"))
    kept = named.where("reference <> '' and text <> ''")
    return kept.select(F.dense_rank().over(_by_place()).cast("int").alias("chunk_no"), "reference", "title", "text", "source", "is_placeholder")


def _by_place() -> WindowSpec:
    return Window.orderBy("source", "part")  # a corpus of regulations is small


def save_index(chunks: DataFrame, path: str) -> None:
    chunks.write.mode("overwrite").parquet(path)


def load_index(spark: SparkSession, path: str) -> DataFrame | None:
    """The saved passages, or None where there are none."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def corpus_summary(chunks: DataFrame) -> DataFrame:
    """Passages and first references of each source."""
    return chunks.groupBy("source").agg(F.count("*").alias("chunks"), F.transform(F.slice(F.array_sort(F.collect_list(F.struct("chunk_no", "reference"))), 1, 4), lambda x: x["reference"]).alias("first_references"), F.bool_or("is_placeholder").alias("has_placeholder"))


def plain(value: object) -> object:
    """A value as strict JSON has it: NaN and infinities are null."""
    if isinstance(value, float) and (value != value or value in (float("inf"), float("-inf"))):
        return None
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if hasattr(value, "asDict"):
        return plain(value.asDict(recursive=True))
    if isinstance(value, (list, tuple, set)):
        return [plain(v) for v in value]
    return value if isinstance(value, (str, int, float, bool, type(None))) else str(value)


def write_report(spark: SparkSession, report: dict, path: str) -> None:
    """One JSON document, through Spark's writer, so that any file system serves."""
    spark.createDataFrame([(json.dumps(plain(report), allow_nan=False),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_report(spark: SparkSession, path: str) -> dict | None:
    try:
        row = spark.read.text(path, wholetext=True).first()
    except AnalysisException:
        return None
    return json.loads(row[0]) if row else None


AUDIT = "timestamp string, actor string, action string, dataset string, detail string"
#: What the log holds besides: when the entry was appended, in microseconds, and its place among those appended with it.
_PLACE = ", appended long, place long"


def append_audit(entries: DataFrame, path: str) -> None:
    """Appends entries in the order of their rows."""
    at = time.time_ns() // 1000
    entries.withColumns({"appended": F.lit(at), "place": F.monotonically_increasing_id()}).write.mode("append").json(path)


def audit_tail(spark: SparkSession, path: str, rows: int = 40, width: int = 120) -> DataFrame:
    """The latest entries in the order they were appended, last first, details cut to `width` characters."""
    log = spark.read.schema(AUDIT + _PLACE).json(path)
    last = log.orderBy(F.desc_nulls_last("appended"), F.desc_nulls_last("place"), F.desc("timestamp"), "action").limit(rows)
    return last.drop("appended", "place").withColumn("detail", F.left("detail", F.lit(width)))
