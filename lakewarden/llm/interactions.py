"""What filters of documents do in every order: how many each removes, which would have gone anyway, what is lost.

1. Each document's failures are five flags. Equality of texts is settled by their SHA-256, so that only flags and digests are shuffled.
2. Documents are counted by (part, five flags): at most 32 rows a part.
3. SQL CUBE over the five flags and part. A grouping-set row in which all flags that it has selected are false counts the
   documents that survive this subset of filters. Subsets without survivors get zeros.
4. A step of an order joins two subsets: the filters before it, and those with its own. What the filter removes is the difference.

Null and empty texts are equal, and fail A only (and E, if a smaller doc_id has one). A null lang and an empty one are one part. A document with a null doc_id has no smaller
one and is none, so that it never fails E and makes no other fail. Rows of one doc_id and text are repeats of one document, of which none is smaller: each counts. A document
with several labels is good (toxic) if one of them says so. Columns of any other names are ignored, and texts are taken whole. An empty table gives no rows.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewarden.llm.common import cut, table

LETTERS = "ABCDE"
_COUNTS = ("docs", "good", "toxic")


def _own_failures(text: Column) -> dict[str, Column]:
    """Failures that a text shows by itself. Its words are in the column `words`."""
    return {
        "A": F.size("words") < 100,
        "B": F.lit(100) * F.size(F.array_distinct("words")) < F.lit(80) * F.size("words"),
        "C": F.lit(100).cast("long") * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > F.lit(10).cast("long") * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents counted by part, failures A to E, and labels: part, A, ..., E, docs, good, toxic. At most 32 rows a part."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.withColumn("words", F.regexp_extract_all("text", F.lit(r"[^ \t-\r]+"), F.lit(0)))
    own = [flag.alias(letter) for letter, flag in _own_failures(F.col("text")).items()]
    rows = rows.select("doc_id", "part", F.substring(F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)), 1, 16).alias("digest"), *own)
    marked = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marked = marked.agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = rows.join(marked, "doc_id", "left").na.fill(0, ["good", "toxic"])
    # Copies of one text are combined before they are shuffled: first rows of one doc_id, then documents of one text, part and label.
    same = ["digest", "A", "B", "C", "D", "part", "good", "toxic"]
    rows = rows.groupBy("doc_id", *same).agg(F.count("*").alias("n"))
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("digest", "least")
    late = rows.join(firsts, "digest", "left").withColumn("E", F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)))
    n = F.col("n")
    return late.groupBy("part", *LETTERS).agg(F.sum(n).alias("docs"), F.sum(n * F.col("good")).alias("good"), F.sum(n * F.col("toxic")).alias("toxic"))


def survivors(counted: DataFrame) -> DataFrame:
    """part, subset (bit i: filter i is applied), docs, good, toxic: what each of the 32 subsets leaves of each part, zeros included."""
    cube = counted.cube(*LETTERS, "part").agg(F.grouping("part").alias("all_parts"), *[F.grouping(x).alias(f"no_{x}") for x in LETTERS], *[F.sum(x).alias(x) for x in _COUNTS])
    clean = cube.where("all_parts = 0")
    for x in LETTERS:
        clean = clean.where((F.col(f"no_{x}") == 1) | ~F.col(x))
    subset = sum(((1 - F.col(f"no_{x}")) * (1 << i) for i, x in enumerate(LETTERS)), F.lit(0))
    left = clean.select("part", subset.cast("int").alias("subset"), *_COUNTS)
    every = counted.select("part").distinct().withColumn("subset", F.explode(F.sequence(F.lit(0), F.lit((1 << len(LETTERS)) - 1))))
    return every.join(left, ["part", "subset"], "left").na.fill(0, list(_COUNTS))


def steps(spark: SparkSession) -> DataFrame:
    """filter_order, step, its filter's bit, and the subsets before and after it, for all orders of the letters."""
    rows = []
    for order in permutations(LETTERS):
        held = 0
        for step, x in enumerate(order, 1):
            bit = 1 << LETTERS.index(x)
            rows.append(("".join(order), step, bit, held, held | bit))
            held |= bit
    return spark.createDataFrame(rows, "filter_order string, step int, bit int, before int, after int")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order and step; see the module's text."""
    every = (1 << len(LETTERS)) - 1
    at = cut(survivors(cut(failures(docs, labels))))  # 32 rows a part

    def of(name: str) -> DataFrame:
        return at.select("part", F.col("subset").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in _COUNTS])

    rows = F.broadcast(steps(docs.sparkSession)).join(of("before"), "before").join(of("after"), ["part", "after"])  # 600 steps
    alone = at.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("subset", "docs"))).alias("left"))
    rows = rows.join(alone, "part")
    removed = F.col("before_docs") - F.col("after_docs")
    fails = F.col("left")[F.lit(0)] - F.col("left")[F.col("bit")]
    unique = F.col("left")[F.lit(every) - F.col("bit")] - F.col("left")[F.lit(every)]
    rows = rows.select(
        "part", "filter_order", "step", "bit", F.col("after_docs").alias("kept"), removed.alias("removed"), (fails - removed).alias("redundant"), unique.alias("unique_fails"),
        (F.col("before_good") - F.col("after_good")).alias("good_lost"), (F.col("before_toxic") - F.col("after_toxic")).alias("toxic_lost"),
    )
    shares = rows.groupBy("part", "bit").agg(F.sum("removed").alias("shapley"))
    return rows.join(shares, ["part", "bit"]).drop("bit")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP13_SQL = r"""
WITH docs AS MATERIALIZED (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^ \t\n\r\x0b\x0c]+') AS words FROM documents),
firsts AS (SELECT text, min(doc_id) AS least FROM docs GROUP BY text),
marked AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
flagged AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (len(words) < 100)::INT + 2 * (100 * len(list_distinct(words)) < 80 * len(words))::INT
    + 4 * (100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 10 * length(text))::INT
    + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(docs.doc_id > least, false)::INT AS mask
  FROM docs LEFT JOIN firsts USING (text) LEFT JOIN marked ON marked.doc_id = docs.doc_id),
counted AS MATERIALIZED (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM flagged GROUP BY part, mask),
letters(x, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
    AND len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM orders, range(1, 6) t(step)),
rows AS (
  SELECT part, filter_order, step, bit,
    sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & before <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM counted, steps GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM rows
"""
