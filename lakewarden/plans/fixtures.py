"""Deterministic inputs with planted defects, as SQL that several engines read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Customers with repeated and malformed emails, missing cells, long-form states, inverted dates, hidden ids and emails in prose.
DIRTY = """
SELECT c_custkey AS row_id,
  'CUST' || CAST(100000 + c_custkey AS STRING) AS customer_id,
  CASE CAST(c_custkey % 4 AS INT) WHEN 0 THEN 'Ana' WHEN 1 THEN 'Bo' WHEN 2 THEN 'Chloe' ELSE 'Dev' END AS first_name,
  CASE CAST(c_custkey % 3 AS INT) WHEN 0 THEN 'Moreau' WHEN 1 THEN 'Khan' ELSE 'Weber' END AS last_name,
  CASE WHEN c_custkey % 25 = 24 THEN 'user' || CAST(c_custkey - 1 AS STRING) || '@example.com'
       WHEN c_custkey % 40 = 7  THEN 'user' || CAST(c_custkey AS STRING) || '@'
       ELSE 'user' || CAST(c_custkey AS STRING) || '@example.com' END AS customer_email,
  CASE WHEN c_custkey % 20 < 7 THEN NULL WHEN c_custkey % 20 = 7 THEN 'N/A'
       ELSE '(' || CAST(200 + c_custkey % 700 AS STRING) || ') ' || CAST(200 + c_custkey % 799 AS STRING)
            || '-' || CAST(1000 + c_custkey % 9000 AS STRING) END AS phone_no,
  CASE WHEN c_custkey % 25 < 8 THEN NULL ELSE CAST(1 + c_custkey % 400 AS STRING) || ' Oakwood Drive' END AS street_address,
  CASE WHEN c_custkey % 3 = 0 THEN 'Austin' ELSE 'Tampa' END AS city,
  CASE WHEN c_custkey % 2 = 0 THEN CASE WHEN c_custkey % 17 = 0 THEN 'Texas' ELSE 'TX' END
       ELSE CASE WHEN c_custkey % 17 = 0 THEN 'Florida' ELSE 'FL' END END AS state,
  CAST(10000 + c_custkey % 90000 AS STRING) AS postcode,
  CAST(DATE '2022-01-01' + CAST(c_custkey % 700 AS INT) AS STRING) AS signup_date,
  CASE WHEN c_custkey % 50 < 19 THEN NULL
       ELSE CAST(DATE '2022-01-01' + CAST(c_custkey % 700 + CASE WHEN c_custkey % 97 = 30 THEN -5 ELSE 1 + c_custkey % 400 END AS INT) AS STRING) END AS last_order_date,
  c_acctbal AS lifetime_value,
  CASE WHEN c_custkey % 61 = 5 THEN '123-45-' || lpad(CAST(c_custkey % 10000 AS STRING), 4, '0')
       ELSE 'CR-' || CAST(10000 + c_custkey AS STRING) END AS cust_ref,
  CASE WHEN c_custkey % 41 = 3 THEN 'Forwarded the invoice to user' || CAST(c_custkey AS STRING) || '@example.com on request.'
       ELSE 'Customer called about a delayed shipment, resolved on the same day.' END AS notes
FROM {customer}
"""

#: Findings of every issue and class, one an order.
FINDINGS = """
SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'quality' ELSE 'compliance' END AS source,
  CASE CAST(o_orderkey % 9 AS INT) WHEN 0 THEN 'unmasked_pii_column' WHEN 1 THEN 'pii_in_freetext' WHEN 2 THEN 'pii_in_mislabeled_column'
    WHEN 3 THEN 'null_heavy_column' WHEN 4 THEN 'duplicate_record' WHEN 5 THEN 'invalid_email' WHEN 6 THEN 'invalid_format'
    WHEN 7 THEN 'inconsistent_value' ELSE 'unheard_of' END AS issue_type,
  'col' || CAST(o_custkey % 40 AS STRING) AS col_name,
  'Order ' || CAST(o_orderkey AS STRING) || ' was found.' AS description,
  CASE CAST(o_orderkey % 5 AS INT) WHEN 0 THEN 'direct_identifier' WHEN 1 THEN 'quasi_identifier' WHEN 2 THEN 'pseudonymous_identifier' WHEN 3 THEN 'non_personal' ELSE 'unheard_of' END AS data_class,
  CAST(CASE WHEN o_orderkey % 101 = 0 THEN 0 ELSE 1000 END AS BIGINT) AS total_rows,
  CASE WHEN o_orderkey % 3 = 0 THEN 'column' ELSE 'row' END AS scope,
  CASE WHEN o_orderkey % 50 = 0 THEN 'llm_unconfirmed' ELSE 'rule' END AS detection,
  CAST(o_orderkey % 1300 AS BIGINT) AS affected_rows,
  CAST(o_orderkey AS STRING) AS finding_key
FROM {orders}
"""

def dirty(spark: SparkSession, customer: DataFrame) -> DataFrame:
    return spark.sql(DIRTY, customer=customer)


def findings(spark: SparkSession, orders: DataFrame) -> DataFrame:
    return spark.sql(FINDINGS, orders=orders).withColumnRenamed("col_name", "column")


def dirty_cte() -> str:
    return f"dirty AS ({DIRTY.format(customer='customer')})"


def findings_cte() -> str:
    return f"findings AS ({FINDINGS.format(orders='orders')})"


def synthetic(spark: SparkSession, rows: int = 500) -> DataFrame:
    """The dirty table over made customers, of any size."""
    customer = spark.range(rows).selectExpr("id as c_custkey", "cast(pmod(xxhash64(id), 480000) as double) / 100 as c_acctbal")
    return dirty(spark, customer)


#: Which rows the dirty table's defects were planted in, by the same remainders; null rows stand for whole columns.
PLANTED = {
    ("duplicate_record", "customer_email"): "c % 25 = 24",
    ("invalid_email", "customer_email"): "c % 25 <> 24 AND c % 40 = 7",
    ("inconsistent_value", "state"): "c % 17 = 0",
    ("inconsistent_value", "signup_date"): "c % 50 >= 19 AND c % 97 = 30",
    ("pii_in_mislabeled_column", "cust_ref"): "c % 61 = 5",
    ("pii_in_freetext", "notes"): "c % 41 = 3",
}
PLANTED_COLUMNS = [("null_heavy_column", c) for c in ("phone_no", "street_address", "last_order_date")] + [("unmasked_pii_column", c) for c in ("customer_id", "first_name", "last_name", "customer_email", "phone_no", "street_address", "postcode")]


def ground_truth(dirty_rows: DataFrame) -> DataFrame:
    """Distinct (defect_type, column, row_id) of everything planted in rows of the dirty table."""
    keys = F.array(*[F.when(F.expr(rule.replace("c %", "row_id %")), F.struct(F.lit(t).alias("defect_type"), F.lit(c).alias("column"))) for (t, c), rule in PLANTED.items()])
    cells = dirty_rows.select(F.explode(F.filter(keys, lambda k: k.isNotNull())).alias("k"), "row_id").select("k.defect_type", "k.column", F.col("row_id").cast("long").alias("row_id"))
    whole = dirty_rows.sparkSession.createDataFrame([(t, c, None) for t, c in PLANTED_COLUMNS], "defect_type string, column string, row_id long")
    return cells.unionByName(whole)
