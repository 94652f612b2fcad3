"""Passages for queries: by vector or by shared words. Results are exact; what can't be among them is ruled out by bounds, or a small side is sent to all tasks after a check of its size."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewarden import config
from lakewarden.functions.columns import search_tokens, unit
from lakewarden.operators import balls
from lakewarden.operators.keywords import Index, build_index, indexed_search
from lakewarden.operators.ranking import top_k
from lakewarden.sources.tables import shared_folder

#: Queries' words are sent to all tasks up to so many bytes: each counts its characters and this much for its row.
MOST_BYTES, WORD_BYTES = 32 << 20, 40


def with_vectors(passages: DataFrame, embed: Column | None) -> DataFrame:
    """passages with unit vectors by the given expression (a pandas UDF, say), or without any: keyword search then."""
    if embed is None:
        return passages
    # The expression first, in a step of its own: no UDF may stand within a function of elements.
    return passages.withColumn("embedding", embed).withColumn("embedding", unit(F.col("embedding")))


def embedded(passages: DataFrame, embed: Column | None) -> tuple[DataFrame, str | None]:
    """passages with vectors, written to the shared folder; or without, and the reason why they can't be had: keyword search then."""
    if embed is None:
        return passages, "no expression for vectors is given"
    try:
        shared_folder(passages.sparkSession)
        made = with_vectors(passages, embed).checkpoint()
        missing = made.where("embedding is null").count()
    except Exception as e:  # whatever the model raises
        return passages, f"{type(e).__name__}: {(str(e).strip() or 'no message').splitlines()[0]}"
    return (passages, f"{missing} passages have no vector") if missing else (made, None)


def backend(passages: DataFrame) -> str:
    return "vector" if "embedding" in passages.columns else "keyword"


def vector_search(queries: DataFrame, passages: DataFrame, k: int, floor: float | None = None) -> DataFrame:
    """query_id, chunk_no, score, rank by the dot product of unit vectors, in double precision, to 4 digits.

    Each length of the queries' vectors has balls of its own, of which a query meets those that may hold one of its best."""
    lengths = [r["n"] for r in queries.select(F.size("embedding").alias("n")).where("n > 0").distinct().orderBy("n").collect()]  # a row a length
    found = [balls.nearest(b, queries, k) for b in (balls.build_balls(passages, n) for n in lengths) if b]
    if not found:
        empty = f"query_id {queries.schema['query_id'].dataType.simpleString()}, chunk_no {passages.schema['chunk_no'].dataType.simpleString()}, score double"
        found = [passages.sparkSession.createDataFrame([], empty)]
    scored = reduce(DataFrame.unionByName, found)
    return top_k(scored.withColumn("score", F.bround("score", balls.DIGITS)), k, floor)


def keyword_search(queries: DataFrame, passages: DataFrame, k: int, floor: float | None = 0.0, index: Index | None = None) -> DataFrame:
    """query_id, chunk_no, score, rank by shared words, passages above the floor (exclusive).

    Queries whose words are few enough to send to all tasks meet each passage where it lies: pairs aren't shuffled, only the
    best k of each query and task, and frequent words are no join keys. More queries, or those that bring a persisted index, are answered
    by an inverted index, of which they read blocks that can hold one of their best only."""
    if index is not None:
        return indexed_search(index, queries, k, floor)
    q = queries.select("query_id", search_tokens(F.col("text")).alias("words"))
    qs = q.select("query_id", F.size("words").alias("nq"), F.explode("words").alias("word"))
    size = qs.agg(F.sum(F.length("word") + F.lit(WORD_BYTES))).first()[0] or 0
    if size > MOST_BYTES:
        spark = passages.sparkSession
        return indexed_search(build_index(passages, f"{shared_folder(spark)}/keywords-{uuid.uuid4().hex}"), queries, k, floor)
    p = passages.select("chunk_no", search_tokens(F.col("text")).alias("words")).repartition("chunk_no")
    ps = p.select("chunk_no", F.size("words").alias("np"), F.explode("words").alias("word"))
    both = ps.join(F.broadcast(qs), "word").groupBy("query_id", "chunk_no").agg(F.count("*").alias("both"), F.first("nq").alias("nq"), F.first("np").alias("np"))
    score = F.bround(F.col("both") / F.sqrt(F.greatest("nq", F.lit(1)).cast("double") * F.greatest("np", F.lit(1)).cast("double")), 4)
    return top_k(both.select("query_id", "chunk_no", score.alias("score")), k, floor)


def query_text(issue: Column, data_class: Column) -> Column:
    """What to search for, or null for issues that no regulation covers."""
    issues = F.create_map(*[F.lit(x) for kv in config.ISSUE_QUERY.items() for x in kv])
    classes = F.create_map(*[F.lit(x) for kv in config.CLASS_QUERY.items() for x in kv])
    first = F.element_at(issues, issue)
    return F.when(first.isNotNull(), F.concat_ws("; ", first, F.element_at(classes, data_class)))


def cited(findings: DataFrame, passages: DataFrame, k: int = 2, floor: float = config.CITATION_FLOOR, width: int = 400) -> DataFrame:
    """findings with citations: the best passages of each finding's query. Each distinct query is searched once."""
    asked = findings.withColumn("query_id", query_text(F.col("issue_type"), F.col("data_class")))
    queries = asked.where("query_id is not null").select("query_id", F.col("query_id").alias("text")).distinct()
    texts = passages.select("chunk_no", F.concat_ws(". ", "reference", "title", "text").alias("text"))
    found = keyword_search(queries, texts, k, floor).join(passages.select("chunk_no", "reference", "title", F.left("text", F.lit(width)).alias("text"), "is_placeholder"), "chunk_no")
    item = F.struct("rank", "reference", "title", "text", "score", "is_placeholder")
    listed = found.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x.dropFields("rank")).alias("citations"))
    return asked.join(listed, "query_id", "left").drop("query_id")


def uses_placeholders(passages: DataFrame) -> DataFrame:
    return passages.agg(F.coalesce(F.bool_or("is_placeholder"), F.lit(False)).alias("uses_placeholder_text"))
