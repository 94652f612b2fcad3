"""Plans stay what they were designed to be: pruned scans, no needless shuffles, no Python."""

import re

import pytest

from lakewarden.operators import retrieval
from lakewarden.plans import catalogue


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["freetext_scan", "freetext_scan_pages", "masks", "sentinel_normalise", "invalid_cells", "html_lines", "text_passages", "risk_scores", "citation_queries", "forbidden_terms", "described_terms"])
def test_row_wise_queries_do_not_shuffle(spark, sf, name):
    assert "Exchange" not in plan(catalogue.QUERIES[name](spark, sf))


@pytest.mark.parametrize("name, columns", [("freetext_scan", {"doc_id", "text"}), ("mask_preview", {"c_custkey", "c_name"}), ("duplicate_any", {"l_orderkey", "l_linenumber"}), ("html_lines", {"page_id", "html"})])
def test_scans_read_only_what_is_used(spark, sf, name, columns):
    for schema in re.findall(r"ReadSchema: struct<([^>]*)>", plan(catalogue.QUERIES[name](spark, sf))):
        assert {c.split(":")[0] for c in schema.split(",")} <= columns


# Vector search multiplies blocks of vectors as matrices.
@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - {"stream_event_counts", "vector_search"}))
def test_no_python_in_plans(spark, sf, name):
    assert not re.search(r"BatchEvalPython|ArrowEvalPython|MapIn|FlatMapGroups", plan(catalogue.QUERIES[name](spark, sf)))


def test_filters_reach_the_scan(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    queries, all_rows = e.where("label = 0").selectExpr("vec_id AS query_id", "embedding"), e.selectExpr("vec_id AS chunk_no", "embedding")
    assert "EqualTo(label,0)" in plan(retrieval.vector_search(queries, all_rows, 3))
