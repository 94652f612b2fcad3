"""Helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Arrow batches are cut again so that a task holds about this many characters at a time.
SLAB_CHARS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names. Where it names none, one of our own serves in local mode; a cluster must name one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lakewarden-"))
    return sc.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder for a table that results are read from; it is removed when Python exits."""
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def remove() -> None:
        try:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
        except Exception:  # the JVM may be gone before Python is
            pass

    atexit.register(remove)
    return path


class Stored:
    """Steps of a job as tables in the shared folder. All but the last one kept are removed at the end of the `with` block.

    At that point the shuffles behind them are of no more use; the driver is asked to collect its garbage, so that Spark's cleaner
    removes their files, which it otherwise does long after."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.name, self.paths = spark, name, []

    def __enter__(self) -> Stored:
        return self

    def __call__(self, df: DataFrame, last: bool = False) -> DataFrame:
        path = scratch(self.spark, self.name)
        if not last:
            self.paths.append(path)
        df.write.parquet(path)
        self.spark.sparkContext._jvm.System.gc()
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        """Removes all tables but the newest."""
        for path in self.paths[:-1]:
            removed(self.spark, path)
        self.paths = self.paths[-1:]

    def __exit__(self, *error: object) -> None:
        for path in self.paths:
            removed(self.spark, path)


def removed(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder, so that later steps neither run it again nor need the executors that made it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def numbered(docs: DataFrame) -> DataFrame:
    """docs as a written table of two columns: n, a number of the row's own, and row, which holds all its columns, whatever their names."""
    spark = docs.sparkSession
    path = scratch(spark, "rows")
    docs.select(F.monotonically_increasing_id().alias("n"), F.struct("*").alias("row")).write.parquet(path)
    return spark.read.parquet(path)


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn labels from: crc32 of the id as text, modulo 5, is 0. A null id is never held out nor learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def slabs(batches: Iterator[pa.RecordBatch], text: str = "text", chars: int = SLAB_CHARS) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `chars` bytes of text; a row is never cut."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > chars:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        yield batch.slice(start)


def release() -> None:
    """Hands memory that a task is done with back to the system: workers outlive tasks, and stages that follow run in them."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not every C library has it
        pass


def map_text(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """fn over slabs of df's rows, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slab in slabs(batches):
            out = fn(slab)
            if out is not None and out.num_rows:
                yield out
        release()

    return df.mapInArrow(run, schema)


def utf8(column: pa.Array) -> list[bytes]:
    """Texts as bytes; null becomes empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def partition_sums(df: DataFrame, pid: str, value: str) -> dict[int, int]:
    """The sum of the values of all partitions before each one: one number a partition reaches the driver."""
    rows = df.groupBy(pid).agg(F.sum(value).alias("s")).collect()
    out, total = {}, 0
    for r in sorted(rows, key=lambda r: r[pid]):
        out[r[pid]] = total
        total += r["s"] or 0
    return out


def running_total(df: DataFrame, order: list[Column], value: str, out: str = "before", partitions: int | None = None) -> DataFrame:
    """Adds to each row the sum of `value` over all rows before it in `order`.

    Rows are dealt by range and sorted, so that no key is held together; each partition
    adds up its own, and only one sum a partition passes the driver. `order` must be total
    for repeatable results. `value` is a long without nulls.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = {f"__o{i}": c for i, c in enumerate(order)}
    dealt = cut(df.withColumns(named).repartitionByRange(n, *[F.col(x) for x in named]).sortWithinPartitions(*named).drop(*named))
    with_pid = dealt.withColumn("__pid", F.spark_partition_id())
    starts = partition_sums(with_pid, "__pid", value)
    schema = T.StructType([*with_pid.schema.fields, T.StructField(out, T.LongType())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if total is None and b.num_rows:
                total = starts[b.column(b.schema.get_field_index("__pid"))[0].as_py()]
            v = b.column(b.schema.get_field_index(value)).to_numpy(zero_copy_only=False).astype("int64")
            c = v.cumsum()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array((total or 0) + c - v, pa.int64())], names=[*b.schema.names, out])
            total = total + int(c[-1]) if len(c) else total

    return with_pid.mapInArrow(add, schema).drop("__pid")


def hash_sample(df: DataFrame, keys: list[str], rows: int, total: int) -> DataFrame:
    """At most `rows` rows of df, which has `total`: those with the least hash of their keys.

    A share of the hash range that holds them is cut out first, so that tasks send little more than
    these rows in all, however many tasks there are."""
    if total > rows:
        share = min(1.0, (1.1 * rows + 50) / total)
        df = df.where(F.pmod(F.xxhash64(*keys, F.lit(11)), F.lit(1 << 30)) < int(share * (1 << 30)))
    return df.orderBy(F.pmod(F.xxhash64(*keys, F.lit(11)), F.lit(1 << 30)), *keys).limit(rows)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: dict[int, int]) -> tuple[list[bytes], list[int]]:
    """Texts and labels of at most rows[y] documents of each label y that aren't held out: those with the least hash of their id.

    A document with several labels has their least; null labels count as none. The bound
    is on rows, so what the driver receives doesn't grow with the table.
    """
    kept = labels.where(~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.min(F.col(label).cast("int")).alias("__y"))
    counts = {r["__y"]: r["count"] for r in kept.groupBy("__y").count().collect()}
    chosen = reduce(DataFrame.unionByName, [hash_sample(kept.where(F.col("__y") == y), ["__id"], n, counts.get(y, 0)) for y, n in rows.items()])
    texts = docs.select(F.col("doc_id").cast("long").alias("__id"), F.col("text").cast("string").alias("__text"))
    found = texts.join(F.broadcast(chosen), "__id").orderBy(F.xxhash64("__id"), "__id", F.xxhash64("__text")).limit(sum(rows.values())).collect()
    return [(r["__text"] or "").encode() for r in found], [r["__y"] for r in found]
