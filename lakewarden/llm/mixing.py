"""Mixing sources to target weights by weighted fair queueing.

Sizes count words (runs of non-white-space; a null text has none). Sources in code-point
order, null last, weigh 1, 2, 3 and so on again; their targets share all words by weight, but stop
at `copies` times the source's size, and what is above is shared out again by weight.

Each source's documents are shuffled by a hash of their ids and stand in a queue, `copies` times
over. A document longer than QUANTUM words is served in packets of so many. A packet's virtual finish time is the number of
its source's words up to its end, divided by the source's target. All packets are sorted by it, over ranges, and
a running total cuts them where the budget (all words) ends; the packet at the cut is taken in part. So every
source gets its target but for a packet at most, and the budget is met to the word.
`mixture` returns whole documents, sorted by the virtual finish time of their last packet.

One row a source goes through one task, as many sources as there are, and one sum a partition through the driver; documents of a hot
source are dealt by range of their hash, and packets by range of their finish time. Null and repeated ids and equal rows are
documents of their own; texts without words are never taken; very long texts are counted whole; an empty table gives no rows.
Other columns are left out by the query, and kept by `mixture`, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakewarden.llm import text as tx
from lakewarden.llm.common import cut, map_text, numbered, running_total, table, utf8

SEED = ":mix"
#: Words that a source is served at a time, at most.
QUANTUM = 256
#: Up to so many sources their targets are sent to all tasks; beyond, rows are joined by source.
SOURCES = 100_000


def _sized(docs: DataFrame) -> DataFrame:
    """n (the row's number), doc_id, source, mark (a hash of the text) and size. docs may lack n: it is null then."""

    def run(slab: pa.RecordBatch) -> pa.RecordBatch:
        data, begins = tx.lay(utf8(slab.column(4)))
        starts, _ = tx.word_runs(data)
        return pa.RecordBatch.from_arrays([*slab.columns[:4], pa.array(np.diff(np.searchsorted(starts, begins)), pa.int64())], names=["n", "doc_id", "source", "mark", "size"])

    n = F.col("n").cast("long") if "n" in docs.columns else F.lit(None).cast("long")
    rows = docs.select(n.alias("n"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64("text").alias("mark"), F.col("text").cast("string").alias("text"))
    return map_text(rows, run, "n long, doc_id long, source string, mark long, size long")


def _source_order() -> list[Column]:
    return [F.col("source").isNull(), F.coalesce("source", F.lit(""))]


def targets(sized: DataFrame, copies: int = 3) -> DataFrame:
    """source, source_size, base (words of earlier sources), target. One row a source, so its windows are small."""
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(*_source_order())
    by = by.withColumns(
        {
            "weight": (F.row_number().over(order) - 1) % 3 + 1,
            "base": F.coalesce(F.sum("source_size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "total": F.sum("source_size").over(Window.partitionBy()),
        }
    ).withColumn("limit", F.col("source_size") * copies)
    # Water level: the fullest sources (least limit for their weight) stop first.
    rank = Window.orderBy((F.col("limit") / F.col("weight")).asc(), *_source_order())
    level = (F.col("total") - F.coalesce(F.sum("limit").over(rank.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).cast("double") / F.sum("weight").over(rank.rowsBetween(0, Window.unboundedFollowing))
    by = by.withColumn("level", level)
    free = F.max("level").over(Window.partitionBy())  # it rises while sources stop, and falls from then on
    target = F.least(F.col("limit").cast("double"), free * F.col("weight"))
    return by.select("source", "source_size", "base", target.alias("target"))


def queued(docs: DataFrame, copies: int = 3) -> DataFrame:
    """n, doc_id, source, size, source_size, target, at (words of all rows before it, in source order) and start (those of its source). docs: doc_id, source, text, and n if rows have a number."""
    sized = cut(_sized(docs))
    by = cut(targets(sized, copies).withColumnRenamed("source", "of"))
    by = F.broadcast(by) if by.count() <= SOURCES else by
    order = [*_source_order(), F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(SEED)).cast("binary")), F.col("doc_id"), F.col("mark"), F.col("n")]
    rows = running_total(sized, order, "size", "at")
    return rows.join(by, F.col("source").eqNullSafe(F.col("of"))).withColumn("start", F.col("at") - F.col("base")).drop("of", "base", "mark", "source")


def served(rows: DataFrame, copies: int = 3, quantum: int = QUANTUM) -> DataFrame:
    """at, copy (from 0), taken (words) and finish (of the last packet taken) of each document and copy of `queued` rows that is served at all."""
    some = rows.where("size > 0").select("at", "size", "source_size", "target", "start", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"))
    step = F.lit(quantum).cast("long")
    packets = some.withColumn("begin", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, step))).withColumn("words", F.least(step, F.col("size") - F.col("begin")))
    finish = (F.col("start") + F.col("source_size") * F.col("copy") + F.col("begin") + F.col("words")) / F.col("target")
    budget = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    # Of packets that finish at once, those of earlier sources come first: `at` counts through the sources.
    line = running_total(packets.select("at", "copy", "words", finish.alias("finish")), [F.col("finish"), F.col("at"), F.col("copy")], "words", "served")
    given = line.where(F.col("served") < budget).withColumn("taken", F.least(F.col("words"), F.lit(budget) - F.col("served")))
    return given.groupBy("at", "copy").agg(F.sum("taken").alias("taken"), F.max("finish").alias("finish"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cut(queued(table(spark, sf_dir, "documents")))
    # Rows without words share `at` with a row that has some; they take nothing.
    taken = served(rows).groupBy(F.col("at").alias("of")).agg(F.sum("taken").alias("taken"))
    joined = rows.join(taken, (F.col("at") == F.col("of")) & (F.col("size") > 0), "left")
    return joined.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixture(docs: DataFrame, copies: int = 3) -> DataFrame:
    """docs' rows as the mix takes them (whole documents, if at least half of their words are taken), up to `copies` times each,
    dealt and sorted by virtual finish time. Columns are docs' own, whatever their names."""
    kept = numbered(docs)
    rows = cut(queued(kept.select("n", "row.doc_id", "row.source", "row.text"), copies))
    times = served(rows, copies).join(rows.where("size > 0").select(F.col("at").alias("of"), "n", "size"), F.col("at") == F.col("of")).where(F.col("taken") * 2 >= F.col("size"))
    mixed = kept.join(times.select(F.col("n").alias("of"), "finish"), F.col("n") == F.col("of"))
    return mixed.repartitionByRange("finish").sortWithinPartitions("finish", "n").select("row.*")


OP6_SQL = r"""
WITH s AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), a AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source
), b AS (
  SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, sum(source_size) OVER () AS total, source_size * 3 AS most FROM a
), c AS (
  SELECT *, (total - coalesce(sum(most) OVER (ORDER BY most::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / sum(weight) OVER (ORDER BY most::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM b
), t AS (
  SELECT source, source_size, least(most::DOUBLE, (max(level) OVER ()) * weight) AS target FROM c
), q AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST, h, doc_id) AS place,
    (coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start
  FROM (SELECT *, md5(coalesce(doc_id::VARCHAR, '') || ':mix') AS h FROM s)
), p AS (
  SELECT place, copy, begin, least(256, size - begin) AS words, (start + source_size * copy + begin + least(256, size - begin))::DOUBLE / target AS finish
  FROM (SELECT q.*, t.source_size, t.target, k.copy, unnest(range(0, q.size, 256)) AS begin FROM q JOIN t ON q.source IS NOT DISTINCT FROM t.source, (VALUES (0), (1), (2)) k(copy))
), f AS (
  SELECT *, sum(words) OVER (ORDER BY finish, place, copy, begin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - words AS served FROM p
), g AS (
  SELECT place, sum(greatest(0, least(words, (SELECT sum(size) FROM s) - served)))::BIGINT AS taken FROM f GROUP BY place
)
SELECT q.doc_id, q.size, t.source_size, t.target, coalesce(g.taken, 0)::BIGINT AS taken
FROM q JOIN t ON q.source IS NOT DISTINCT FROM t.source LEFT JOIN g USING (place)
"""
