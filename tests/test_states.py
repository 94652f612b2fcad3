"""Profiles from mergeable states against profiles of the whole table."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lakewarden import config
from lakewarden.operators import profiling, states

EXACT = ["dtype", "rows", "null_count", "null_pct", "samples", "near_constant", "numeric_min", "numeric_max"]
CLOSE = ["mean_length", "numeric_mean"]


def by_name(df):
    return {r["name"]: r for r in df.collect()}


def same(got, want, error=0.06):
    assert got.keys() == want.keys()
    for name, r in want.items():
        g = got[name]
        assert all(g[c] == r[c] for c in EXACT), (name, g, r)
        assert all(g[c] == r[c] or math.isclose(g[c], r[c], rel_tol=1e-9) for c in CLOSE), (name, g, r)
        assert abs(g["distinct_count"] - r["distinct_count"]) <= max(1, error * r["distinct_count"])


def made(spark, n, seed, start=0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        rows.append((start + i, rng.choice(["a", "b", None, "N/A", "c d"]), "k" if rng.random() < 0.97 else f"v{i}", rng.gauss(0, 5) if rng.random() < 0.9 else None, i % 2 == 0, f"u{start + i}", None, "same"))
    return spark.createDataFrame(rows, "_row_id long, few string, near string, x double, flag boolean, key string, nothing string, one string")


def test_states_of_parts_make_the_profile_of_all(spark):
    a, b = made(spark, 700, 1), made(spark, 400, 2, 700)
    parts = states.states(a, F.lit("a")).unionByName(states.states(b, F.lit("b")))
    whole = a.unionByName(b)
    want = by_name(profiling.profile(whole))
    same(by_name(states.profile_of(parts)), want)
    same(by_name(states.profile_of(states.states(whole, (F.col("_row_id") >= 700).cast("string")))), want)
    same(by_name(states.profile_of(states.states(whole.repartition(7)))), want)
    assert want["near"]["near_constant"] and not want["few"]["near_constant"] and want["nothing"]["samples"] == []


def test_samples_are_the_first_values_wherever_they_are(spark):
    # Long runs of one value before the next new one; fewer values than samples; values in one slice.
    rows = [(i, f"r{i // 300}", "x" if i < 1990 else f"late{i}", "ab"[i % 2]) for i in range(2000)]
    df = spark.createDataFrame(rows, "_row_id long, runs string, late string, two string").repartition(6)
    got = by_name(states.profile_of(states.states(df)))
    assert got["runs"]["samples"] == [f"r{i}" for i in range(5)] and got["late"]["samples"] == ["x", *[f"late{i}" for i in range(1990, 1994)]] and got["two"]["samples"] == ["a", "b"]


@pytest.mark.parametrize("share", [0.95 - 2 * states.ERROR, 0.95 + 2 * states.ERROR])
def test_near_constant_within_its_error(spark, share):
    n = 60_000
    common = int(n * share)
    df = spark.range(n).select(F.col("id").alias("_row_id"), F.when(F.pmod(F.col("id") * 7919, F.lit(n)) < common, "c").otherwise(F.col("id").cast("string")).alias("v")).repartition(5)
    state = states.states(df)
    top = state.select(F.get(F.expr("approx_top_k_estimate(frequent, 1)"), F.lit(0))["count"].alias("n")).first()["n"]
    assert abs(top - common) <= states.ERROR * n
    assert by_name(states.profile_of(state))["v"]["near_constant"] == (share > config.NEAR_CONSTANT)


def test_no_values_are_shuffled_for_counts(spark, sf):
    df = spark.read.parquet(f"{sf}/orders.parquet").withColumnRenamed("o_orderkey", "_row_id").withColumn("__part", F.lit(""))
    plan = states._counted(df, profiling.profiled_fields(df))._jdf.queryExecution().executedPlan().toString()
    assert "partial_hll_sketch_agg" in plan and "partial_approx_top_k_accumulate" in plan


def test_new_files_only_are_read(spark, sf, tmp_path):
    table, kept = str(tmp_path / "t"), str(tmp_path / "states")
    orders = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    orders.where("o_orderkey % 3 = 0").repartition(2).write.parquet(table)
    first = states.update_states(spark.read.parquet(table), kept)
    assert first.select("part").distinct().count() == 2
    before = {(r["part"], r["name"]): r["rows"] for r in first.collect()}
    orders.where("o_orderkey % 3 <> 0").repartition(3).write.mode("append").parquet(table)
    again = states.update_states(spark.read.parquet(table), kept)
    now = {(r["part"], r["name"]): r["rows"] for r in again.collect()}
    assert again.count() == len(now) == 5 * 4 and before.items() <= now.items()
    assert states.update_states(spark.read.parquet(table), kept).count() == len(now)
    from lakewarden.sources.tables import with_row_id

    same(by_name(states.profile_of(again)), by_name(profiling.profile(with_row_id(spark.read.parquet(table)))))


def test_empty_and_nested(spark):
    empty = spark.createDataFrame([], "a string, b double")
    assert states.states(empty).count() == 0 and states.profile_of(states.states(empty)).count() == 0
    nested = spark.createDataFrame([([1],)], "v array<int>")
    assert states.states(nested).count() == 0
    null = spark.createDataFrame([(None, None)], "a string, b double")
    got = by_name(states.profile_of(states.states(null)))
    assert got["a"]["samples"] == [] and got["b"]["numeric_mean"] is None and got["a"]["null_pct"] == 100.0 and not got["a"]["near_constant"]
