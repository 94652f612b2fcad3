"""Named queries over the provided tables and the SQL that each must equal."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewarden import config
from lakewarden.functions import columns as fx
from lakewarden.operators import assistant, evaluate, keywords, privacy, profiling, quality, retrieval, review, risk, states, typing
from lakewarden.plans import fixtures, pipeline
from lakewarden.plans.fixtures import dirty_cte, findings_cte
from lakewarden.sources import tables
from lakewarden.streaming import monitors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(oracle: str | None = None) -> Callable:
    def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLES[fn.__name__] = oracle
        return fn

    return register


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _dirty(spark: SparkSession, sf: str) -> DataFrame:
    return fixtures.dirty(spark, _t(spark, sf, "customer"))


def _numbered(spark: SparkSession, sf: str) -> DataFrame:
    return _dirty(spark, sf).withColumnRenamed("row_id", "_row_id")


def _found(spark: SparkSession, sf: str) -> DataFrame:
    return fixtures.findings(spark, _t(spark, sf, "orders"))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Free-text scan of documents, as scored and gated findings."""
    docs = _t(spark, sf, "documents").withColumnRenamed("doc_id", "_row_id")
    total = docs.count()
    hits = privacy.freetext_scan(docs, ["text"]).groupBy("column", "kind").agg(F.count("*").alias("affected_rows"))
    classes = F.create_map(*[F.lit(x) for k in config.FREETEXT_KINDS for x in (k, config.DATA_CLASS[k])])
    rows = hits.select(F.lit("compliance").alias("source"), F.lit("pii_in_freetext").alias("issue_type"), "column", F.concat(F.lit("embedded "), "kind").alias("description"), F.element_at(classes, F.col("kind")).alias("data_class"), F.lit(total).cast("long").alias("total_rows"), F.lit("row").alias("scope"), F.lit("rule").alias("detection"), "affected_rows", F.col("kind").alias("finding_key"))
    return risk.ranked(risk.scored(rows))


_SENTINELS = ", ".join("'" + s + "'" for s in config.SENTINELS)


def _norm(c: str) -> str:
    return f"(CASE WHEN {c} NOT IN ({_SENTINELS}) THEN {c} END)"


def _union(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


# Profiles

_DIRTY_TEXT = ["customer_id", "first_name", "last_name", "customer_email", "phone_no", "street_address", "city", "state", "postcode", "signup_date", "last_order_date", "cust_ref", "notes"]


def _profile_sql(c: str, kind: str) -> str:
    x, text = (_norm(c), True) if kind == "string" else (c, False)
    stats = f"avg(length({x}))" if text else "NULL::DOUBLE"
    numeric = ", ".join(f"{f}({c})::DOUBLE" for f in ("min", "max", "avg")) if not text else "NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE"
    return f"""SELECT '{c}' AS name, '{kind}' AS dtype, count(*) AS rows, count(*) - count({x}) AS null_count, round_even((count(*) - count({x})) * 100.0::DOUBLE / count(*), 2) AS null_pct,
 count(DISTINCT {x}) AS distinct_count, round_even(count(DISTINCT {x}) * 100.0::DOUBLE / greatest(count({x}), 1), 2) AS distinct_pct, count(DISTINCT {x}) <= 1 AS is_constant,
 round_even({stats}, 6) AS mean_length, {numeric.replace("avg(" + c + ")::DOUBLE", "round_even(avg(" + c + "), 6)")} FROM dirty"""


@_query("WITH " + dirty_cte() + " SELECT name, dtype, rows, null_count, null_pct, distinct_count, distinct_pct, is_constant, mean_length, n1 AS numeric_min, n2 AS numeric_max, n3 AS numeric_mean FROM (" + _union([_profile_sql(c, "string") for c in _DIRTY_TEXT] + [_profile_sql("lifetime_value", "double")]) + ") t(name, dtype, rows, null_count, null_pct, distinct_count, distinct_pct, is_constant, mean_length, n1, n2, n3)")
def profile_columns(spark: SparkSession, sf: str) -> DataFrame:
    """C1-C5, C7, C9-C11 on every column but the row number."""
    p = profiling.profile(_numbered(spark, sf))
    return p.select("name", "dtype", "rows", "null_count", "null_pct", "distinct_count", "distinct_pct", "is_constant", F.bround("mean_length", 6).alias("mean_length"), "numeric_min", "numeric_max", F.bround("numeric_mean", 6).alias("numeric_mean"))


_SAMPLE_SQL = "SELECT '{c}' AS name, array_to_string(list(v ORDER BY f, v)[1:5], '|') AS samples FROM (SELECT {x} AS v, min(row_id) AS f FROM dirty WHERE {x} IS NOT NULL GROUP BY 1)"


@_query("WITH " + dirty_cte() + _union([_SAMPLE_SQL.format(c=c, x=_norm(c)) for c in _DIRTY_TEXT] + [_SAMPLE_SQL.format(c="lifetime_value", x="lifetime_value::DECIMAL(38,6)::VARCHAR")]))
def profile_samples(spark: SparkSession, sf: str) -> DataFrame:
    """First distinct values in row order."""
    return profiling.distincts(_numbered(spark, sf)).select("name", F.array_join("samples", "|").alias("samples"))


def _state_sql(c: str) -> str:
    x, text = (_norm(c), True) if c != "lifetime_value" else ("lifetime_value", False)
    value = x if text else "lifetime_value::DECIMAL(38,6)::VARCHAR"
    numbers = ", ".join("NULL::DOUBLE" if text else f"{f}({c})::DOUBLE" for f in ("min", "max"))
    return f"""SELECT '{c}' AS name, count(*) AS rows, count(*) - count({x}) AS null_count, {f"round_even(avg(length({x})), 6)" if text else "NULL::DOUBLE"} AS mean_length, {numbers}, {"NULL::DOUBLE" if text else f"round_even(avg({c}), 6)"},
 (SELECT coalesce(max(n) / sum(n)::DOUBLE > 0.95, false) FROM (SELECT count(*) AS n FROM dirty WHERE {x} IS NOT NULL GROUP BY {x})),
 (SELECT coalesce(array_to_string(list(v ORDER BY f, v)[1:5], '|'), '') FROM (SELECT {value} AS v, min(row_id) AS f FROM dirty WHERE {x} IS NOT NULL GROUP BY 1)) FROM dirty"""


@_query("WITH " + dirty_cte() + " SELECT * FROM (" + _union([_state_sql(c) for c in [*_DIRTY_TEXT, "lifetime_value"]]) + ") t(name, rows, null_count, mean_length, numeric_min, numeric_max, numeric_mean, near_constant, samples)")
def profile_states(spark: SparkSession, sf: str) -> DataFrame:
    """C1-C3, C5-C8 from mergeable states of parts of a thousand rows."""
    parts = states.states(_numbered(spark, sf), F.lpad(F.floor(F.col("_row_id") / 1000).cast("string"), 12, "0"))
    p = states.profile_of(parts)
    return p.select("name", "rows", "null_count", F.bround("mean_length", 6).alias("mean_length"), "numeric_min", "numeric_max", F.bround("numeric_mean", 6).alias("numeric_mean"), "near_constant", F.array_join("samples", "|").alias("samples"))


_TOP_SQL = "SELECT '{n}' AS name, max(n) AS top_count, sum(n)::BIGINT AS non_null, max(n) / sum(n)::DOUBLE > 0.95 AS near_constant FROM (SELECT {e} AS v, count(*) AS n FROM events GROUP BY 1)"


@_query(_union([_TOP_SQL.format(n=n, e=e) for n, e in (("event_type", "event_type"), ("nearly_one", "event_id % 50 = 0"), ("not_quite", "event_id % 10 = 0"))]))
def profile_top_share(spark: SparkSession, sf: str) -> DataFrame:
    """Columns that are, and aren't, nearly constant."""
    d = profiling.distincts(_t(spark, sf, "events").selectExpr("event_type", "event_id % 50 = 0 AS nearly_one", "event_id % 10 = 0 AS not_quite"))
    return d.select("name", "top_count", "non_null", (F.col("top_count") / F.col("non_null") > config.NEAR_CONSTANT).alias("near_constant"))


_LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


@_query(_union([f"SELECT 'null share {c}' AS stat, avg(({c} IS NULL)::INT)::DOUBLE AS value FROM lineitem" for c in _LINE] + ["SELECT 'negative l_linenumber', count(*) FILTER (l_linenumber < 0)::DOUBLE FROM lineitem", f"SELECT 'repeated rows', (count(*) - count(DISTINCT ({', '.join(_LINE)})))::DOUBLE FROM lineitem"]))
def quick_stats(spark: SparkSession, sf: str) -> DataFrame:
    """C12."""
    return profiling.quick_stats(_t(spark, sf, "lineitem"), ["l_linenumber"])


@_query("WITH " + dirty_cte() + f" SELECT row_id, {_norm('phone_no')} AS phone_no FROM dirty")
def sentinel_normalise(spark: SparkSession, sf: str) -> DataFrame:
    """B1, B2."""
    d = _dirty(spark, sf)
    return d.select("row_id", fx.normalised(F.col("phone_no"), d.schema["phone_no"].dataType).alias("phone_no"))


# Types


def _rate_sql(c: str, table: str, cast: str) -> str:
    rates = ", ".join(f"round_even(coalesce(avg(regexp_full_match({cast}, '{p}')::INT), 0), 6) AS {k}" for k, p in config.PATTERNS.items())
    return f"SELECT '{c}' AS name, count({c}) AS non_null, {rates} FROM {table}"


@_query(_union([_rate_sql("url", "pages", "url"), _rate_sql("html", "pages", "html"), _rate_sql("page_id", "pages", "page_id::VARCHAR")]))
def match_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Whole-cell rates of every pattern."""
    rates = typing.match_rates(_t(spark, sf, "pages"))
    return rates.select("name", "non_null", *[F.bround(k, 6).alias(k) for k in config.PATTERNS])


_TYPES = [("customer_id", "customer_id", "name"), ("first_name", "person_name", "name"), ("last_name", "person_name", "name"), ("customer_email", "email", "name"), ("phone_no", "phone", "name"), ("street_address", "address", "name"), ("city", "categorical", "default"), ("state", "categorical", "default"), ("postcode", "postcode_us", "name"), ("signup_date", "date", "value"), ("last_order_date", "date", "value"), ("lifetime_value", "numeric", "dtype"), ("cust_ref", "categorical", "default"), ("notes", "free_text", "length")]


def _types_cte() -> str:
    """types(name, semantic_type, type_evidence, data_class, rate, filled) of the dirty table's columns, worked out from their names and values."""
    hints = ", ".join(f"('{h}', '{k}', {i})" for i, (h, k) in enumerate((h, k) for k, hs in config.NAME_HINTS.items() for h in hs))
    rates = []
    for c, *_ in _TYPES:
        x, number = (_norm(c), False) if c != "lifetime_value" else ("lifetime_value::DECIMAL(38,6)::VARCHAR", True)
        each = ", ".join(f"coalesce(avg(regexp_full_match({x}, '{p}')::INT), 0)::DOUBLE AS {k}" for k, p in config.PATTERNS.items())
        dated = "0::DOUBLE" if number else f"coalesce(avg(CASE WHEN {x} IS NOT NULL THEN (try_cast({x} AS DATE) IS NOT NULL)::INT END), 0)::DOUBLE"
        rates.append(f"SELECT '{c}' AS name, {number} AS number, count({x}) AS filled, avg(length({x})) AS long, {dated} AS date_rate, {each} FROM dirty")
    by_value = "[" + ", ".join(f"({k}, {-i}, '{k}')" for i, k in enumerate(config.PATTERNS) if k not in config.NAME_ONLY_KINDS) + "]"
    by_value = by_value.replace("(", "row(")
    own = " ".join(f"WHEN '{k}' THEN {k}" for k in config.PATTERNS)
    classes = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in config.DATA_CLASS.items())
    return f"""rates AS ({_union(rates)}), hints(hint, kind, i) AS (VALUES {hints}),
 named AS (SELECT name, first(kind ORDER BY length(hint) DESC, i) AS kind FROM rates JOIN hints ON contains(regexp_replace(lower(name), '[^a-z0-9]', '', 'g'), hint) GROUP BY name),
 chosen AS (SELECT rates.*, kind, list_max({by_value}) AS best FROM rates LEFT JOIN named USING (name)),
 typed AS (SELECT *, CASE WHEN kind IS NOT NULL THEN 'name' WHEN filled > 0 AND best[1] >= 0.8 THEN 'value' WHEN number THEN 'dtype' WHEN date_rate >= 0.8 THEN 'value' WHEN long > 25 THEN 'length' ELSE 'default' END AS type_evidence,
  coalesce(kind, CASE WHEN filled > 0 AND best[1] >= 0.8 THEN best[3] WHEN number THEN 'numeric' WHEN date_rate >= 0.8 THEN 'date' WHEN long > 25 THEN 'free_text' ELSE 'categorical' END) AS semantic_type FROM chosen),
 types AS (SELECT name, semantic_type, type_evidence, CASE semantic_type {classes} ELSE '{config.NON_PERSONAL}' END AS data_class, CASE semantic_type {own} ELSE 0 END AS rate, filled FROM typed)"""


@_query("WITH " + dirty_cte() + ", " + _types_cte() + " SELECT name, semantic_type, type_evidence, data_class, semantic_type = 'free_text' AS is_freetext FROM types")
def type_inference(spark: SparkSession, sf: str) -> DataFrame:
    """D1, D3-D5."""
    d = _numbered(spark, sf)
    return typing.catalog(d, profiling.basics(d)).select("name", "semantic_type", "type_evidence", "data_class", "is_freetext")


# Quality


def _null_sql(c: str) -> str:
    x = _norm(c) if c != "lifetime_value" else c
    return f"SELECT '{c}' AS col, count(*) AS rows, count(*) - count({x}) AS nulls, round_even((count(*) - count({x})) * 100.0::DOUBLE / count(*), 2) AS null_pct FROM dirty"


_ALL = [t[0] for t in _TYPES]


@_query("WITH " + dirty_cte() + ", n AS (" + _union([_null_sql(c) for c in _ALL]) + ") SELECT col, rows, nulls, null_pct, null_pct > 30 AS null_heavy FROM n")
def completeness(spark: SparkSession, sf: str) -> DataFrame:
    """E1, E2, B8."""
    return quality.null_shares(_dirty(spark, sf), _ALL).withColumnRenamed("column", "col").withColumn("null_heavy", F.col("null_pct") > config.NULL_HEAVY_PCT)


@_query("SELECT 100.0::DOUBLE AS score_text, round_even((1 - count(*) FILTER (quality IS NULL) / count(*)::DOUBLE) * 100, 2) AS score_quality FROM documents LEFT JOIN labels USING (doc_id)")
def completeness_joined(spark: SparkSession, sf: str) -> DataFrame:
    """E1 on natural nulls of a left join."""
    joined = _t(spark, sf, "documents").join(_t(spark, sf, "labels"), "doc_id", "left")
    text = quality.completeness_score(quality.null_shares(joined, ["text"])).withColumnRenamed("score", "score_text")
    return text.crossJoin(quality.completeness_score(quality.null_shares(joined, ["quality"])).withColumnRenamed("score", "score_quality"))


@_query("WITH " + dirty_cte() + " SELECT row_id, customer_email FROM (SELECT row_id, customer_email, row_number() OVER (PARTITION BY customer_email ORDER BY row_id) AS r FROM dirty) WHERE r > 1")
def duplicate_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Later rows of a business key."""
    return quality.repeated_rows(_dirty(spark, sf), ["customer_email"], "row_id").select("row_id", "customer_email")


@_query("SELECT l_orderkey, l_linenumber, count(*) AS copies FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS c FROM lineitem) WHERE c > 1 GROUP BY 1, 2")
def duplicate_any(spark: SparkSession, sf: str) -> DataFrame:
    """All rows of repeated keys."""
    return quality.all_copies(_t(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"]).groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("copies"))


@_query("SELECT min(doc_id) AS first_doc, text, count(*) - 1 AS repeats FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_texts(spark: SparkSession, sf: str) -> DataFrame:
    """E3 with long keys."""
    d = _t(spark, sf, "documents").select("doc_id", "text")
    rest = quality.repeated_rows(d, ["text"], "doc_id").groupBy("text").agg(F.count("*").alias("repeats"))
    firsts = quality.all_copies(d, ["text"]).groupBy("text").agg(F.min("doc_id").alias("first_doc"))
    return firsts.join(rest, "text").select("first_doc", "text", "repeats")


@_query("SELECT vec_id FROM (SELECT vec_id, row_number() OVER (PARTITION BY embedding, label ORDER BY vec_id) AS r FROM embeddings) WHERE r > 1")
def repeated_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """E3 on nested keys: rows whose vector and label an earlier row has."""
    return quality.repeated_rows(_t(spark, sf, "embeddings"), ["embedding", "label"], "vec_id").select("vec_id")


@_query("SELECT 'repeated rows' AS stat, (count(*) - count(DISTINCT (embedding, label)))::DOUBLE AS value FROM embeddings" + "".join(f" UNION ALL SELECT 'null share {c}', avg(({c} IS NULL)::INT)::DOUBLE FROM embeddings" for c in ("embedding", "label")))
def quick_stats_nested(spark: SparkSession, sf: str) -> DataFrame:
    """C12 where a column is nested; vec_id numbers the rows."""
    return profiling.quick_stats(_t(spark, sf, "embeddings").withColumnRenamed("vec_id", "_row_id"))


@_query("SELECT count(*) AS total, (count(*) - count(DISTINCT (embedding, label))) AS repeats, round_even(100 * (1 - (count(*) - count(DISTINCT (embedding, label))) / count(*)::DOUBLE), 2) AS score FROM embeddings")
def whole_row_uniqueness(spark: SparkSession, sf: str) -> DataFrame:
    """E3 without a key: the dimension's score over whole rows, vectors included."""
    d = _t(spark, sf, "embeddings").withColumnRenamed("vec_id", "_row_id")
    total = d.count()
    found, _ = quality.uniqueness(d, [], None, total)
    return spark.createDataFrame([(total, found.evidence["duplicate_count"], found.score)], "total long, repeats long, score double")


@_query("WITH m AS (SELECT conv_id, list((turn, role) ORDER BY turn, role) AS shape FROM (SELECT conv_id, turn, min(role) AS role FROM conversations GROUP BY 1, 2) GROUP BY 1) SELECT conv_id, len(shape) AS turns FROM (SELECT *, count(*) OVER (PARTITION BY shape) AS n FROM m) WHERE n > 1")
def repeated_maps(spark: SparkSession, sf: str) -> DataFrame:
    """E4 on a map column: conversations whose map from turn to role another one has, whatever the order of its entries."""
    turns = _t(spark, sf, "conversations").groupBy("conv_id", "turn").agg(F.min("role").alias("role"))
    maps = turns.groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct("turn", "role"))).alias("shape"))
    return quality.all_copies(maps, ["shape"]).select("conv_id", F.size("shape").cast("long").alias("turns"))


_PLACED = "SELECT *, row_number() OVER () - 1 AS r FROM lineitem"


@_query(f"SELECT l_returnflag, l_linestatus, count(*) AS rows, min(r) AS first, max(r) AS last, sum(r)::BIGINT AS total FROM ({_PLACED}) GROUP BY 1, 2")
def row_identity(spark: SparkSession, sf: str) -> DataFrame:
    """A1: numbers of rows by their places in files."""
    numbered = tables.with_row_id(_t(spark, sf, "lineitem"))
    return numbered.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("rows"), F.min("_row_id").alias("first"), F.max("_row_id").alias("last"), F.sum("_row_id").alias("total"))


@_query(f"SELECT r, l_orderkey, l_linenumber FROM ({_PLACED}) WHERE r BETWEEN 500 AND 1499")
def row_block(spark: SparkSession, sf: str) -> DataFrame:
    """A5: a thousand neighbouring rows, by number."""
    return tables.block(_t(spark, sf, "lineitem"), 500, 1000).select(F.col("_row_id").alias("r"), "l_orderkey", "l_linenumber")


_KINDS = {"customer_email": "email", "phone_no": "phone", "postcode": "postcode_us"}


@_query("WITH " + dirty_cte() + ", v AS (" + _union([f"SELECT '{c}' AS col, '{k}' AS kind, count({_norm(c)}) AS checked, count(*) FILTER (regexp_full_match({_norm(c)}, '{config.PATTERNS[k]}')) AS valid FROM dirty" for c, k in _KINDS.items()]) + ") SELECT col, kind, checked, valid, round_even(valid * 100.0::DOUBLE / checked, 2) AS rate, round_even(sum(valid) OVER () * 100.0::DOUBLE / sum(checked) OVER (), 2) AS pooled FROM v")
def validity(spark: SparkSession, sf: str) -> DataFrame:
    """E5."""
    from pyspark.sql import Window

    v = quality.validity_rates(_dirty(spark, sf), _KINDS).withColumnRenamed("column", "col")
    everything = Window.partitionBy()  # a row a column
    return v.withColumn("rate", F.bround(F.col("valid") * 100.0 / F.col("checked"), 2)).withColumn("pooled", F.bround(F.sum("valid").over(everything) * 100.0 / F.sum("checked").over(everything), 2))


@_query("WITH " + dirty_cte() + _union([f" SELECT '{'invalid_email' if k == 'email' else 'invalid_format'}' AS issue_type, '{c}' AS col, '{k}' AS kind, row_id FROM dirty WHERE NOT regexp_full_match({_norm(c)}, '{config.PATTERNS[k]}')" for c, k in _KINDS.items()]))
def invalid_cells(spark: SparkSession, sf: str) -> DataFrame:
    """E6."""
    return quality.invalid_cells(_dirty(spark, sf), _KINDS, "row_id").withColumnRenamed("column", "col")


_STATES = ", ".join(f"('{s}', '{c}')" for s, c in config.CANONICAL["state"].items())


@_query("WITH " + dirty_cte() + f", m(s, canon) AS (VALUES {_STATES}), k AS (SELECT row_id, state, canon FROM dirty JOIN m ON state = s), g AS (SELECT canon, state, count(*) AS n, min(row_id) AS f FROM k GROUP BY 1, 2), b AS (SELECT canon, state AS common FROM (SELECT *, row_number() OVER (PARTITION BY canon ORDER BY n DESC, f) AS r FROM g) WHERE r = 1) SELECT row_id, state AS value, canon, state <> common AS odd FROM k JOIN b USING (canon)")
def canonical_forms(spark: SparkSession, sf: str) -> DataFrame:
    """E7."""
    return quality.odd_spellings(_dirty(spark, sf), "state", config.CANONICAL["state"], "row_id")


@_query("WITH " + dirty_cte() + " SELECT 'signup_before_last_order' AS rule, count(*) AS evaluated, count(*) FILTER (signup_date::DATE <= last_order_date::DATE) AS ok FROM dirty WHERE last_order_date IS NOT NULL UNION ALL SELECT 'non_negative_value', count(*), count(*) FILTER (lifetime_value >= 0) FROM dirty")
def cross_field(spark: SparkSession, sf: str) -> DataFrame:
    """E8, B6, B7, B13."""
    d = _dirty(spark, sf)
    out = None
    for rule, names, expression in config.CROSS_FIELD:
        r = quality.rule_results(d, names, expression, {"signup_date", "last_order_date"}, "row_id").agg(F.lit(rule).alias("rule"), F.count("*").alias("evaluated"), F.count_if("ok").alias("ok"))
        out = r if out is None else out.unionByName(r)
    return out


@_query("SELECT l_orderkey, count(*) AS broken FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE NOT o_orderdate <= l_shipdate GROUP BY 1")
def cross_field_joined(spark: SparkSession, sf: str) -> DataFrame:
    """E8 over a join."""
    joined = _t(spark, sf, "lineitem").join(_t(spark, sf, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    bad = quality.rule_results(joined, ["o_orderdate", "l_shipdate"], "o_orderdate <= l_shipdate", row="l_orderkey").where("not ok")
    return bad.groupBy(F.col("row_id").alias("l_orderkey")).agg(F.count("*").alias("broken"))


_DIMENSIONS_SQL = (
    "WITH " + dirty_cte() + ", n AS (" + _union([_null_sql(c) for c in _ALL]) + f"""),
 k AS (SELECT count(*) AS t, count(DISTINCT customer_email) AS d FROM dirty),
 v AS (SELECT sum(c) AS c, sum(x) AS x FROM (""" + _union([f"SELECT count({_norm(c)}) AS c, count(*) FILTER (regexp_full_match({_norm(c)}, '{config.PATTERNS[k]}')) AS x FROM dirty" for c, k in _KINDS.items()]) + """)),
 a AS (SELECT avg((state IN ('TX', 'FL'))::INT) AS s FROM dirty UNION ALL SELECT avg((signup_date <= last_order_date)::INT) FROM dirty WHERE last_order_date IS NOT NULL UNION ALL SELECT avg((lifetime_value >= 0)::INT) FROM dirty),
 s AS (SELECT 'completeness' AS dimension, round_even((1 - (SELECT sum(nulls) FROM n) / (SELECT sum(rows) FROM n)::DOUBLE) * 100, 2) AS score, 95.0::DOUBLE AS threshold, 1.0::DOUBLE AS w
  UNION ALL SELECT 'uniqueness', round_even((1 - (t - d) / t::DOUBLE) * 100, 2), 99.0, 1.0 FROM k UNION ALL SELECT 'validity', round_even(100.0::DOUBLE * x / c, 2), 98.0, 1.0 FROM v UNION ALL SELECT 'consistency', round_even(100.0::DOUBLE * avg(s), 2), 95.0, 0.5 FROM a)
 SELECT dimension, score, threshold, CASE WHEN score >= threshold THEN 'yes' ELSE 'no' END AS passed FROM s UNION ALL SELECT 'overall', round_even(sum(w * score) / sum(w), 2), NULL, 'not assessed' FROM s UNION ALL SELECT 'accuracy', NULL, NULL, 'not assessed' UNION ALL SELECT 'timeliness', NULL, NULL, 'not assessed'"""
)


@_query(_DIMENSIONS_SQL)
def quality_dimensions(spark: SparkSession, sf: str) -> DataFrame:
    """Every dimension of the whole assessment, and the overall score."""
    a = pipeline.assess(_dirty(spark, sf), "synthetic", row="row_id")
    said = {None: "not assessed", True: "yes", False: "no"}
    rows = [(d.dimension, d.score, d.threshold, said[d.passed]) for d in a.dimensions] + [("overall", a.overall_score, None, said[None])]
    return spark.createDataFrame(rows, "dimension string, score double, threshold double, passed string")


# Personal data


def _rate(c: str) -> str:
    k = dict((n, t) for n, t, _ in _TYPES)[c]
    return f"avg(regexp_full_match({_norm(c)}, '{config.PATTERNS[k]}')::INT)" if k in config.PATTERNS else "max(0)"


@_query("WITH " + dirty_cte() + ", c AS (" + _union([f"SELECT '{n}' AS col, '{t}' AS semantic_type, '{config.DATA_CLASS[t]}' AS data_class, {_rate(n)}::DOUBLE AS rate FROM dirty" for n, t, _ in _TYPES if t in config.DATA_CLASS]) + ") SELECT col, semantic_type, data_class, CASE WHEN rate >= 0.05 THEN 'name+value' ELSE 'name' END AS classified_by FROM c")
def personal_columns(spark: SparkSession, sf: str) -> DataFrame:
    """F1, F4, E14."""
    d = _numbered(spark, sf)
    found = privacy.classify(typing.typed_columns(d, profiling.basics(d)), d.count())
    return spark.createDataFrame([(f.column, f.evidence["semantic_type"], f.data_class, f.evidence["classified_by"]) for f in found], "col string, semantic_type string, data_class string, classified_by string")


def _scan_sql(table: str, key: str, c: str, kinds: list[str]) -> str:
    return _union([f"SELECT '{c}' AS col, '{k}' AS kind, {key} AS row_id FROM {table} WHERE regexp_matches({c}, '{config.PATTERNS[k]}')" for k in kinds])


@_query(_scan_sql("documents", "doc_id", "text", config.FREETEXT_KINDS))
def freetext_scan(spark: SparkSession, sf: str) -> DataFrame:
    """F2, B10 over documents."""
    return privacy.freetext_scan(_t(spark, sf, "documents"), ["text"], "doc_id").select(F.col("column").alias("col"), "kind", "row_id")


@_query(_scan_sql("pages", "page_id", "html", config.FREETEXT_KINDS))
def freetext_scan_pages(spark: SparkSession, sf: str) -> DataFrame:
    return privacy.freetext_scan(_t(spark, sf, "pages"), ["html"], "page_id").select(F.col("column").alias("col"), "kind", "row_id")


@_query("WITH " + dirty_cte() + " " + _union([_scan_sql("dirty", "row_id", c, config.HIGH_CONFIDENCE_KINDS) for c in _DIRTY_TEXT if c != "notes"]))
def high_confidence_scan(spark: SparkSession, sf: str) -> DataFrame:
    """F3."""
    d = _numbered(spark, sf)
    hits = privacy.high_confidence_scan(d, typing.typed_columns(d, profiling.basics(d)))
    return hits.select(F.col("column").alias("col"), "kind", "row_id")


_EMAIL_SQL = "CASE WHEN instr({c}, '@') > 0 THEN (CASE WHEN instr({c}, '@') = 1 THEN '*' ELSE left({c}, 1) END) || '***@' || substr({c}, instr({c}, '@') + 1) ELSE " + f"'ema_' || left(sha256({{c}} || '{config.MASK_SALT}'), 10) END"


@_query("WITH " + dirty_cte() + f" SELECT row_id, coalesce({_EMAIL_SQL.format(c='customer_email')}, '') AS email, coalesce({_EMAIL_SQL.format(c='phone_no')}, '') AS phone_as_email, coalesce(CASE WHEN length(regexp_replace(phone_no, '[^0-9]', '', 'g')) >= 4 THEN repeat('*', length(regexp_replace(phone_no, '[^0-9]', '', 'g')) - 4) || right(regexp_replace(phone_no, '[^0-9]', '', 'g'), 4) ELSE 'pho_' || left(sha256(phone_no || '{config.MASK_SALT}'), 10) END, '') AS phone, left(first_name, 1) || '.' AS name, 'add_' || left(sha256(street_address || '{config.MASK_SALT}'), 10) AS address FROM dirty")
def masks(spark: SparkSession, sf: str) -> DataFrame:
    """G1-G6."""
    d = _dirty(spark, sf)
    address = fx.mask_default(F.col("street_address"), "address")
    return d.select("row_id", fx.mask(F.col("customer_email"), "email").alias("email"), fx.mask(F.col("phone_no"), "email").alias("phone_as_email"), fx.mask(F.col("phone_no"), "phone").alias("phone"), fx.mask(F.col("first_name"), "person_name").alias("name"), address.alias("address"))


@_query("SELECT c_custkey AS row_id, left(c_name, 1) || '.' AS masked FROM customer ORDER BY c_custkey LIMIT 3")
def mask_preview(spark: SparkSession, sf: str) -> DataFrame:
    """G7."""
    return privacy.masked_preview(_t(spark, sf, "customer"), "c_name", "person_name", row="c_custkey")


# Risk

_SEVERITY_SQL = "CASE issue_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in config.SEVERITY.items()) + " ELSE 1 END"
_EXPOSURE_SQL = "CASE data_class " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in config.EXPOSURE.items()) + " ELSE 1 END"
_SCORED_CTE = findings_cte() + f""", s0 AS (SELECT *, left(sha1(concat_ws('|', source, issue_type, col_name, scope)), 10) AS id,
 round_even({_SEVERITY_SQL} * {_EXPOSURE_SQL} * (CASE WHEN total_rows <= 0 THEN 0.5::DOUBLE ELSE 0.5::DOUBLE + 0.5::DOUBLE * least(affected_rows / total_rows::DOUBLE, 1.0::DOUBLE) END) / 15 * 100, 0)::INT AS risk FROM findings),
 scored AS (SELECT *, CASE WHEN risk <= 25 THEN 'Low' WHEN risk <= 50 THEN 'Medium' WHEN risk <= 75 THEN 'High' ELSE 'Critical' END AS band, CASE WHEN detection = 'llm_unconfirmed' OR risk >= 51 THEN 'pending_review' ELSE 'auto_logged' END AS status FROM s0)"""


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    return risk.scored(_found(spark, sf))


@_query(f"WITH {_SCORED_CTE} SELECT finding_key, id, risk, band, status FROM scored")
def risk_scores(spark: SparkSession, sf: str) -> DataFrame:
    """H1-H3, H5-H7."""
    return _scored(spark, sf).select("finding_key", "id", "risk", "band", "status")


@_query(f"WITH {_SCORED_CTE} SELECT finding_key, col_name, risk FROM scored ORDER BY risk DESC, col_name, finding_key LIMIT 10")
def top_findings(spark: SparkSession, sf: str) -> DataFrame:
    """H4, H11."""
    return risk.top(_scored(spark, sf), 10).select("finding_key", F.col("column").alias("col_name"), "risk")


@_query(f"WITH {_SCORED_CTE} SELECT band, count(*) AS findings, count(*) FILTER (status = 'pending_review') AS pending, sum(affected_rows)::BIGINT AS affected_rows FROM scored GROUP BY 1")
def band_summary(spark: SparkSession, sf: str) -> DataFrame:
    """H10."""
    return risk.band_counts(_scored(spark, sf))


@_query(f"WITH {_SCORED_CTE} SELECT issue_type, col_name, id, risk FROM scored WHERE status = 'pending_review'")
def review_queue(spark: SparkSession, sf: str) -> DataFrame:
    """B15, O7."""
    return risk.pending(_scored(spark, sf)).select("issue_type", F.col("column").alias("col_name"), "id", "risk")


def _playbook(i: int) -> str:
    return "CASE issue_type " + " ".join(f"WHEN '{k}' THEN '{v[i]}'" for k, v in config.PLAYBOOK.items()) + f" ELSE '{config.DEFAULT_ACTION[i]}' END"


@_query(f"WITH {_SCORED_CTE}, r AS (SELECT *, row_number() OVER (PARTITION BY issue_type, col_name ORDER BY risk DESC, affected_rows DESC, finding_key) AS rn FROM scored) SELECT id AS finding_id, col_name, issue_type, {_playbook(0)} AS action, {_playbook(1)} AS suggested_owner, {_playbook(2)} AS effort, band || ' risk (' || risk || '/100): ' || description || ' Affects ' || affected_rows || ' of ' || total_rows || ' rows.' AS rationale, risk, band, status FROM r WHERE rn = 1")
def recommendations(spark: SparkSession, sf: str) -> DataFrame:
    """H8, H9."""
    return risk.recommendations(_scored(spark, sf)).withColumnRenamed("column", "col_name")


# Retrieval

_STOP = ", ".join(f"'{w}'" for w in fx.SEARCH_STOPWORDS)
_WORDS = "list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: length(t) > 2 AND t NOT IN (" + _STOP + ")))"


_KEYWORD_SQL = f"""WITH q AS (SELECT item_id AS query_id, {_WORDS} AS w FROM benchmark), p AS (SELECT doc_id AS chunk_no, {_WORDS} AS w FROM documents),
 qe AS (SELECT query_id, len(w) AS nq, unnest(w) AS word FROM q), pe AS (SELECT chunk_no, len(w) AS np, unnest(w) AS word FROM p),
 s AS (SELECT query_id, chunk_no, round_even(count(*) / sqrt(any_value(nq)::DOUBLE * any_value(np)::DOUBLE), 4) AS score FROM qe JOIN pe USING (word) GROUP BY 1, 2)
 SELECT * FROM (SELECT query_id, chunk_no, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_no)::INT AS rank FROM s) WHERE rank <= 5"""


@_query(_KEYWORD_SQL)
def keyword_search(spark: SparkSession, sf: str) -> DataFrame:
    """I1, I4, I5."""
    queries = _t(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return retrieval.keyword_search(queries, _t(spark, sf, "documents").select(F.col("doc_id").alias("chunk_no"), "text"), 5, None)


@_query(_KEYWORD_SQL)
def keyword_index_search(spark: SparkSession, sf: str) -> DataFrame:
    """The same by a persisted inverted index, of which a query reads the blocks that its bounds allow."""
    passages = _t(spark, sf, "documents").select(F.col("doc_id").alias("chunk_no"), "text")
    index = keywords.build_index(passages, f"{tables.shared_folder(spark)}/keywords-{uuid.uuid4().hex}")
    return retrieval.keyword_search(_t(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text"), passages, 5, None, index)


@_query("""WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS a FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT query_id, vec_id AS chunk_no, round_even(list_dot_product(a, embedding::DOUBLE[]), 4) AS score FROM q, embeddings)
 SELECT * FROM (SELECT query_id, chunk_no, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_no)::INT AS rank FROM s) WHERE rank <= 3""")
def vector_search(spark: SparkSession, sf: str) -> DataFrame:
    """Queries are the vectors whose id is divisible by 50."""
    e = _t(spark, sf, "embeddings")
    return retrieval.vector_search(e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), e.select(F.col("vec_id").alias("chunk_no"), "embedding"), 3)


_ISSUE_SQL = "CASE issue_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in config.ISSUE_QUERY.items()) + " END"
_CLASS_SQL = "CASE data_class " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in config.CLASS_QUERY.items()) + " END"


@_query(f"WITH {findings_cte()} SELECT finding_key, CASE WHEN {_ISSUE_SQL} IS NOT NULL THEN concat_ws('; ', {_ISSUE_SQL}, {_CLASS_SQL}) END AS query FROM findings")
def citation_queries(spark: SparkSession, sf: str) -> DataFrame:
    """I6."""
    return _found(spark, sf).select("finding_key", retrieval.query_text(F.col("issue_type"), F.col("data_class")).alias("query"))


_PASSAGES = [(i, f"Art. {i}", k.replace("_", " "), v) for i, (k, v) in enumerate(config.ISSUE_QUERY.items())]
_PASSAGE_ROWS = ", ".join(f"({i}, '{r}', '{t}', '{x}')" for i, r, t, x in _PASSAGES)


@_query(f"""WITH {findings_cte()}, p AS (SELECT * FROM (VALUES {_PASSAGE_ROWS}) t(chunk_no, reference, title, body) UNION ALL SELECT 1000 + doc_id, 'Doc ' || doc_id, lang, text FROM documents), pw AS (SELECT chunk_no, reference, {_WORDS} AS w FROM (SELECT *, concat_ws('. ', reference, title, body) AS text FROM p)),
 q AS (SELECT finding_key, CASE WHEN {_ISSUE_SQL} IS NOT NULL THEN concat_ws('; ', {_ISSUE_SQL}, {_CLASS_SQL}) END AS text FROM findings), d AS (SELECT DISTINCT text FROM q WHERE text IS NOT NULL), qw AS (SELECT text, {_WORDS} AS w FROM d),
 s AS (SELECT qw.text, chunk_no, reference, round_even(len(list_intersect(qw.w, pw.w)) / sqrt(len(qw.w)::DOUBLE * len(pw.w)::DOUBLE), 4) AS score FROM qw, pw),
 r AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY score DESC, chunk_no)::INT AS place FROM s WHERE score > 0.45)
 SELECT finding_key, place, reference, score FROM q JOIN r USING (text) WHERE place <= 2""")
def cited_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Passages that cover the findings among all documents."""
    made = spark.createDataFrame([(*p, "made", False) for p in _PASSAGES], "chunk_no long, reference string, title string, text string, source string, is_placeholder boolean")
    other = _t(spark, sf, "documents").selectExpr("1000 + doc_id AS chunk_no", "concat('Doc ', doc_id) AS reference", "lang AS title", "text", "'documents' AS source", "false AS is_placeholder")
    passages = made.unionByName(other)
    cited = retrieval.cited(_scored(spark, sf), passages).select("finding_key", F.posexplode("citations").alias("place", "c"))
    return cited.select("finding_key", (F.col("place") + 1).cast("int").alias("place"), "c.reference", "c.score")


# Assistant, review, evaluation

_QSTOP = ", ".join(f"'{w}'" for w in fx.QUESTION_STOPWORDS)
_QWORDS = "list_distinct(list_transform(list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+'), lambda t: length(t) > 1 AND t NOT IN (" + _QSTOP + ")), lambda t: CASE WHEN t LIKE '%ing' AND length(t) >= 7 THEN left(t, length(t) - 3) WHEN t LIKE '%ed' AND length(t) >= 6 THEN left(t, length(t) - 2) WHEN t LIKE '%s' AND length(t) >= 5 THEN left(t, length(t) - 1) ELSE t END))"
_QUESTION = "Which duplicates or missing values of col7 are pending a review?"


@_query(f"WITH {_SCORED_CTE}, o AS (SELECT *, len(list_intersect({_QWORDS.format(x=repr(_QUESTION))}, {_QWORDS.format(x=chr(39).join(['concat_ws(', ' ', ', col_name, issue_type, description, data_class, band, status)']))})) AS overlap FROM scored) SELECT id, finding_key, overlap::INT AS overlap, risk FROM o WHERE overlap > 0 ORDER BY overlap DESC, risk DESC, finding_key LIMIT 4")
def assistant_matches(spark: SparkSession, sf: str) -> DataFrame:
    """J1-J4."""
    return assistant.matches(_scored(spark, sf), F.lit(_QUESTION)).select("id", "finding_key", "overlap", "risk")


_DECISIONS = "SELECT id AS finding_id, CASE CAST(CAST(finding_key AS BIGINT) % 3 AS INT) WHEN 0 THEN 'approved' WHEN 1 THEN 'rejected' ELSE 'reopened' END AS decision, 'person ' || CAST(CAST(finding_key AS BIGINT) % 7 AS STRING) AS actor, lpad(finding_key, 12, '0') AS decided_at FROM {scored} WHERE CAST(finding_key AS BIGINT) % 4 = 0"
_CURRENT_SQL = f"decisions AS ({_DECISIONS.format(scored='scored')}), cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY finding_id ORDER BY decided_at DESC, decision, actor) AS rn FROM decisions) WHERE rn = 1 AND decision <> 'reopened')"


def _current(spark: SparkSession, scored: DataFrame) -> DataFrame:
    return review.current(spark.sql(_DECISIONS, scored=scored))


@_query(f"WITH {_SCORED_CTE}, {_CURRENT_SQL} SELECT finding_id, decision, actor, decided_at FROM cur")
def current_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """K1, K2."""
    return _current(spark, _scored(spark, sf)).select("finding_id", "decision", "actor", "decided_at")


@_query(f"WITH {_SCORED_CTE}, {_CURRENT_SQL} SELECT finding_key, decision, actor, coalesce(decision, status) AS effective_status FROM scored LEFT JOIN cur ON id = finding_id")
def review_decorated(spark: SparkSession, sf: str) -> DataFrame:
    """K3."""
    s = _scored(spark, sf)
    return review.decorated(s, _current(spark, s)).select("finding_key", "decision", "actor", "effective_status")


@_query(f"WITH {_SCORED_CTE}, {_CURRENT_SQL}, e AS (SELECT coalesce(decision, status) AS s FROM scored LEFT JOIN cur ON id = finding_id), k(s) AS (VALUES ('pending_review'), ('approved'), ('rejected'), ('auto_logged')) SELECT k.s AS effective_status, count(e.s) AS n FROM k LEFT JOIN e USING (s) GROUP BY 1")
def review_summary(spark: SparkSession, sf: str) -> DataFrame:
    """K4."""
    s = _scored(spark, sf)
    return review.summary(review.decorated(s, _current(spark, s)))


_MARKS_SQL = f"e AS (SELECT doc_id FROM labels WHERE quality = 0), o AS (SELECT doc_id FROM documents WHERE regexp_matches(text, '{config.PATTERNS['email']}') OR text LIKE '%!!%'), m AS (SELECT doc_id, e.doc_id IS NOT NULL AS expected, o.doc_id IS NOT NULL AS observed FROM e FULL JOIN o USING (doc_id)), x AS (SELECT doc_id, lang, expected, observed FROM m JOIN documents USING (doc_id))"
_METRIC_SQL = "count(*) FILTER (expected AND observed) AS tp, count(*) FILTER (NOT expected AND observed) AS fp, count(*) FILTER (expected AND NOT observed) AS fn"
_METRICS_SQL = "tp, fp, fn, round_even(CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 1 END, 9) AS precision, round_even(CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 1 END, 9) AS recall"


def _marks(spark: SparkSession, sf: str) -> DataFrame:
    docs = _t(spark, sf, "documents")
    expected = _t(spark, sf, "labels").where("quality = 0").select("doc_id")
    observed = docs.where(fx.contains(F.col("text"), config.PATTERNS["email"]) | F.col("text").contains("!!")).select("doc_id")
    return evaluate.compared(expected, observed, ["doc_id"]).join(docs.select("doc_id", "lang"), "doc_id")


def _rounded(m: DataFrame) -> DataFrame:
    return m.withColumns({c: F.bround(c, 9) for c in ("precision", "recall")}).drop("f1")


@_query(f"WITH {_MARKS_SQL}, c AS (SELECT {_METRIC_SQL} FROM x) SELECT {_METRICS_SQL} FROM c")
def evaluation(spark: SparkSession, sf: str) -> DataFrame:
    """L1, L2, L4, L7."""
    return _rounded(evaluate.metrics(_marks(spark, sf)))


@_query(f"WITH {_MARKS_SQL}, c AS (SELECT lang, {_METRIC_SQL} FROM x GROUP BY 1) SELECT lang, {_METRICS_SQL} FROM c")
def evaluation_by_group(spark: SparkSession, sf: str) -> DataFrame:
    """L3, L5."""
    return _rounded(evaluate.metrics(_marks(spark, sf), ["lang"]))


@_query(f"WITH {_MARKS_SQL} SELECT doc_id, lang FROM x WHERE expected AND NOT observed ORDER BY doc_id LIMIT 15")
def missed_keys(spark: SparkSession, sf: str) -> DataFrame:
    """The capped listing of misses."""
    return evaluate.listing(_marks(spark, sf), True).select("doc_id", "lang")


_PLANTED_SQL = "WITH " + dirty_cte() + ", k AS (" + _union([f"SELECT '{t}' AS defect_type, count(*) AS n FROM dirty WHERE {rule.replace('c %', 'row_id %')}" for (t, _), rule in fixtures.PLANTED.items()] + [f"SELECT '{t}', 1" for t, _ in fixtures.PLANTED_COLUMNS]) + ")"


@_query(_PLANTED_SQL + " SELECT defect_type, sum(n)::BIGINT AS tp, 0::BIGINT AS fp, 0::BIGINT AS fn FROM k GROUP BY 1")
def evaluation_of_assessment(spark: SparkSession, sf: str) -> DataFrame:
    """Everything planted is found, by defect, and nothing else; negative values, which the data have of themselves, are left out."""
    d = _dirty(spark, sf)
    a = pipeline.assess(d, "synthetic", row="row_id")
    observed = evaluate.keys(a.findings, a.cells).where("not (defect_type = 'inconsistent_value' and column = 'lifetime_value')")
    marks = evaluate.compared(fixtures.ground_truth(d), observed)
    return evaluate.metrics(marks, ["defect_type"]).select("defect_type", "tp", "fp", "fn")


# Text


@_query(r"""WITH RECURSIVE t AS (SELECT doc_id, string_split(regexp_replace(trim(regexp_replace(text, '[ \t\n\r\f\x0B]+', ' ', 'g')), '([.;:]) ', '\1' || chr(1), 'g'), chr(1)) AS s FROM documents),
 f AS (SELECT doc_id, s, 1 AS i, 0 AS passage, s[1] AS now FROM t UNION ALL
  SELECT doc_id, s, i + 1, CASE WHEN now <> '' AND length(now) + length(s[i + 1]) + 1 > 900 THEN passage + 1 ELSE passage END,
   CASE WHEN now = '' OR length(now) + length(s[i + 1]) + 1 > 900 THEN s[i + 1] ELSE now || ' ' || s[i + 1] END FROM f WHERE i < len(s))
 SELECT doc_id, passage, arg_max(now, i) AS text FROM f GROUP BY 1, 2 HAVING arg_max(now, i) <> ''""")
def text_passages(spark: SparkSession, sf: str) -> DataFrame:
    """M2."""
    return _t(spark, sf, "documents").select("doc_id", F.posexplode(fx.passages(F.col("text"))).alias("passage", "text"))


_REFS = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]


def _html_sql() -> str:
    c = "html"
    for p, by in (("(?is)<script[^>]*>.*?</script>", "' '"), ("(?is)<style[^>]*>.*?</style>", "' '"), ("(?i)<li[^>]*>", "' ' || chr(10) || '- '"), ("(?i)</(p|div|li|tr|h[0-9])>", "chr(10)"), ("<[^>]+>", "' '")):
        c = f"regexp_replace({c}, '{p}', {by}, 'g')"
    for a, b in _REFS:
        c = f"regexp_replace({c}, '{a[:-1]};?', '{b}', 'g')"  # all that the pages have, some without a semicolon
    for p, by in ((r"[ \t\f\r\x{00A0}]+", "' '"), (r" ?\n ?", "chr(10)"), (r"\n+", "chr(10)"), (r"\A[\n ]+|[\n ]+\z", "''")):
        c = f"regexp_replace({c}, '{p}', {by}, 'g')"
    return f"SELECT page_id, {c} AS text FROM pages"


@_query(_html_sql())
def html_lines(spark: SparkSession, sf: str) -> DataFrame:
    """M1."""
    return _t(spark, sf, "pages").select("page_id", fx.html_lines(F.col("html")).alias("text"))


@_query("""SELECT doc_id, array_to_string(list_transform(list_sort(list_filter(list_distinct(list_transform(regexp_extract_all(text, '[0-9]+(?:\\.[0-9]+)?'), lambda x: x::DOUBLE)), lambda f: abs(f - n_chars) > 0.5 AND abs(f - 555) > 0.5)), lambda x: floor(x)::DECIMAL(38,0)::VARCHAR), ',') AS invented FROM documents""")
def invented_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """M4, M5: numbers in a text other than its length and 555, as whole numbers."""
    d = _t(spark, sf, "documents")
    found = F.array_sort(fx.invented_numbers(F.col("text"), F.array(F.col("n_chars").cast("double"), F.lit(555.0))))
    return d.select("doc_id", F.array_join(F.transform(found, fx.whole), ",").alias("invented"))


_FORBIDDEN_SQL = "list_filter([" + ", ".join(f"regexp_extract(t, '(?i){p}', 0)" for p in config.FORBIDDEN) + "], lambda x: x <> '')"


@_query(f"WITH s AS (SELECT conv_id, turn, text || CASE WHEN turn % 3 = 0 THEN ' This Violates a rule and is unlawfully in breach of it.' ELSE '' END AS t FROM conversations) SELECT conv_id, turn, array_to_string({_FORBIDDEN_SQL}, ',') AS terms FROM s")
def forbidden_terms(spark: SparkSession, sf: str) -> DataFrame:
    """M6."""
    c = _t(spark, sf, "conversations").withColumn("t", F.concat("text", F.when(F.col("turn") % 3 == 0, " This Violates a rule and is unlawfully in breach of it.").otherwise("")))
    return c.select("conv_id", "turn", F.array_join(fx.forbidden_terms(F.col("t")), ",").alias("terms"))


@_query("SELECT p_partkey, trim(p_name) AS description, CASE WHEN p_partkey % 2 = 0 THEN trim(p_brand) END AS glossary_term FROM part")
def described_terms(spark: SparkSession, sf: str) -> DataFrame:
    """M7."""
    text = F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" TERM: "), "p_brand")).otherwise(""))
    return _t(spark, sf, "part").select("p_partkey", fx.described(text).alias("d")).select("p_partkey", "d.description", "d.glossary_term")


# Streams


@_query("SELECT date_trunc('hour', ts)::TIMESTAMP AS window_start, event_type, count(*) AS n, count(*) FILTER (value IS NULL) AS missing, round_even(avg(value), 6) AS mean_value FROM events GROUP BY 1, 2")
def stream_event_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Windowed counts of a replayed stream: the last update of each window and type."""
    stream = monitors.read(spark, f"{sf}/events.parquet*", _t(spark, sf, "events"))
    out = f"{tables.shared_folder(spark)}/events-{uuid.uuid4().hex}"
    last = monitors.gather(monitors.counts(stream), ["window_start", "event_type"], out)
    return last.withColumn("mean_value", F.bround("mean_value", 6)).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


# Whole assessments


def _findings_sql() -> str:
    """Each kind of finding, looked for in the dirty table itself; counts of those about rows."""
    hidden = _union(
        [f"SELECT 'pii_in_freetext' AS issue_type, '{c}' AS col_name, '{k}' AS kind, count(*) AS n, true AS wanted_freetext FROM dirty WHERE regexp_matches({_norm(c)}, '{config.PATTERNS[k]}')" for c in _DIRTY_TEXT for k in config.FREETEXT_KINDS]
        + [f"SELECT 'pii_in_mislabeled_column', '{c}', '{k}', count(*), false FROM dirty WHERE regexp_matches({_norm(c)}, '{config.PATTERNS[k]}')" for c in _DIRTY_TEXT for k in config.HIGH_CONFIDENCE_KINDS]
    )
    nulls = _union([_null_sql(c) for c in _ALL])
    return f"""WITH {dirty_cte()}, {_types_cte()}, nulls AS ({nulls}), hidden AS ({hidden}), m(s, canon) AS (VALUES {_STATES}),
 spelt AS (SELECT canon, state, count(*) AS c, row_number() OVER (PARTITION BY canon ORDER BY count(*) DESC, min(row_id)) AS place FROM dirty JOIN m ON state = s GROUP BY 1, 2),
 found AS (
  SELECT 'unmasked_pii_column' AS issue_type, name AS col_name, '' AS kind, NULL::BIGINT AS n FROM types WHERE data_class <> '{config.NON_PERSONAL}' AND (type_evidence = 'name' OR rate >= 0.05)
  UNION ALL SELECT 'null_heavy_column', col, '', NULL FROM nulls WHERE null_pct > 30
  UNION ALL SELECT issue_type, col_name, hidden.kind, n FROM hidden JOIN types ON name = col_name WHERE n > 0 AND (semantic_type = 'free_text') = wanted_freetext AND (wanted_freetext OR semantic_type <> hidden.kind)
  UNION ALL SELECT 'duplicate_record', 'customer_email', '', count(*) - count(DISTINCT customer_email) FROM dirty
  UNION ALL SELECT CASE semantic_type WHEN 'email' THEN 'invalid_email' ELSE 'invalid_format' END, name, semantic_type, round(filled * (1 - rate))::BIGINT FROM types WHERE semantic_type IN ({", ".join(f"'{k}'" for k in config.PATTERNS)})
  UNION ALL SELECT 'inconsistent_value', 'state', 'spelling', coalesce(sum(c), 0)::BIGINT FROM spelt WHERE place > 1
  UNION ALL SELECT 'inconsistent_value', 'signup_date', 'signup_before_last_order', count(*) FROM dirty WHERE signup_date::DATE > last_order_date::DATE
  UNION ALL SELECT 'inconsistent_value', 'lifetime_value', 'non_negative_value', count(*) FROM dirty WHERE lifetime_value < 0)
 SELECT issue_type, col_name, kind, n AS affected FROM found WHERE n IS NULL OR n > 0"""


@_query(_findings_sql())
def assessment_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Every defect and nothing else; of findings about rows, how many."""
    a = pipeline.assess(_dirty(spark, sf), "synthetic", row="row_id")
    affected = F.when(F.col("scope") == "row", F.col("affected_rows"))
    return a.findings.select("issue_type", F.col("column").alias("col_name"), F.element_at(F.split("finding_key", r"\|"), -1).alias("kind"), affected.alias("affected"))


@_query()
def assessment_report(spark: SparkSession, sf: str) -> DataFrame:
    """The report of one table as strict JSON."""
    import json

    from lakewarden.sources.tables import plain

    d = _numbered(spark, sf)
    doc = pipeline.report(pipeline.assess(d, "synthetic"), d)
    return spark.createDataFrame([(json.dumps(plain(doc), allow_nan=False),)], "report string")
