"""Whole rows and their identity: nested columns, digests, numbers by place in files."""

import glob
import itertools
import random
import struct
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from lakewarden.functions import rows as whole
from lakewarden.operators import profiling, quality
from lakewarden.sources import tables


def test_nested_columns_count_in_whole_rows(spark):
    df = spark.createDataFrame([(0, 1, [1.0]), (1, 1, [2.0]), (2, 2, [3.0])], "_row_id long, a int, b array<double>")
    found, repeated = quality.uniqueness(df, [], None, 3)
    assert (found.score, found.failing, repeated.count()) == (100.0, [], 0)
    stats = {r["stat"]: r["value"] for r in profiling.quick_stats(df).collect()}
    assert stats == {"null share a": 0.0, "null share b": 0.0, "repeated rows": 0.0}


NAN = float("nan")
CELLS = [
    (None, None, None), ([], {}, (None, None)), ([None], {}, (None, None)), ([None, 1.0], {"x": [1]}, (1, "a")), ([1.0, None], {"x": [1]}, (1, "a")), ([NAN], {"x": None}, (None, "a")),
    ([0.0], {"x": [], "y": None}, (1, None)), ([-0.0], {"y": None, "x": []}, (1, None)), ([NAN], {"x": None}, (None, "a")), ([1.0], {"x": [1, 2], "y": [2]}, (1, "b")), ([1.0], {"y": [2], "x": [1, 2]}, (1, "b")), ([1.0], {"y": [1, 2], "x": [2]}, (1, "b")),
]


def _value(x):
    """A cell as it is compared: NaN equal to NaN, zeros equal, maps without order."""
    if isinstance(x, dict):
        return frozenset((k, _value(v)) for k, v in x.items())
    if isinstance(x, (list, tuple)):
        return tuple(_value(v) for v in x)
    return "nan" if isinstance(x, float) and x != x else 0.0 if x == 0 and isinstance(x, float) else x


def test_all_kinds_of_cells(spark):
    rng = random.Random(4)
    rows = [(i, *rng.choice(CELLS), rng.choice([0.0, -0.0, NAN, None])) for i in range(120)]
    df = spark.createDataFrame(rows, "_row_id long, a array<double>, m map<string,array<int>>, s struct<p:int,q:string>, d double").repartition(5)
    groups = {}
    for r in rows:
        groups.setdefault(_value(r[1:]), []).append(r[0])
    assert {r["_row_id"] for r in whole.later(df, whole.whole_row(df)).collect()} == {i for g in groups.values() for i in sorted(g)[1:]}
    assert {r["_row_id"] for r in quality.all_copies(df, ["a", "m", "s", "d"]).collect()} == {i for g in groups.values() if len(g) > 1 for i in g}
    assert whole.repeats(df, ["a", "m", "s", "d"]).first()["n"] == 120 - len(groups)
    assert set(quality.repeated_rows(df, ["m"]).columns) == set(df.columns)


def test_digests_of_equal_rows_in_any_order_of_columns(spark):
    a = spark.createDataFrame([({"x": 1, "y": 2}, [1.5], "t")], "m map<string,int>, v array<double>, t string")
    b = spark.createDataFrame([("t", [1.5], {"y": 2, "x": 1})], "t string, v array<double>, m map<string,int>")
    c = spark.createDataFrame([("t", [1.5], {"y": 1, "x": 2})], "t string, v array<double>, m map<string,int>")
    got = [d.select(whole.digest(d, d.columns).alias("d")).first()["d"] for d in (a, b, c)]
    assert got[0] == got[1] != got[2]


def test_equal_digests_are_confirmed_on_values(spark, monkeypatch):
    monkeypatch.setattr(whole, "digest", lambda df, names: F.struct(F.lit(7).alias("d1"), F.lit(7).alias("d2")))
    rows = [(0, 1, [1.0]), (1, 1, [2.0]), (2, 2, [3.0]), (3, 1, [2.0]), (4, 1, [1.0]), (5, 1, [1.0])]
    df = spark.createDataFrame(rows, "_row_id long, a int, b array<double>")
    found, repeated = quality.uniqueness(df, [], None, 6)
    assert found.evidence["duplicate_count"] == 3 and sorted(r["row_id"] for r in repeated.collect()) == [3, 4, 5]
    assert sorted(r["_row_id"] for r in whole.shared(df, ["a", "b"]).collect()) == [0, 1, 3, 4, 5]


def test_only_repeated_digests_bring_their_values(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    plan = whole.candidates(df, ["embedding"])._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and "embedding" not in [x for x in plan.split("\n") if "Exchange" in x][-1]


@pytest.fixture(scope="module")
def files(spark, sf, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("rows") / "t")
    spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_shipdate").repartition(6).write.option("parquet.block.size", 4096).parquet(path)
    return path


def _ids(df):
    rows = df.select("l_orderkey", "l_linenumber", "_row_id").collect()
    out = {r["_row_id"]: (r["l_orderkey"], r["l_linenumber"]) for r in rows}
    assert len(out) == len(rows)
    return out


def test_numbers_do_not_depend_on_how_files_are_split(spark, files):
    seen = []
    for size in ("1k", "20k", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        df = tables.with_row_id(spark.read.parquet(files))
        seen.append((df.rdd.getNumPartitions(), _ids(df)))
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len({n for n, _ in seen}) > 1
    assert seen[0][1] == seen[1][1] == seen[2][1]
    n = len(seen[0][1])
    assert sorted(seen[0][1]) == list(range(n))
    assert _ids(tables.with_row_id(spark.read.parquet(files).select("l_linenumber", "l_orderkey"))) == seen[0][1]


@pytest.mark.parametrize("parts", [1, 8, 200])
def test_numbers_behind_a_shuffle_stay(spark, files, parts):
    df = tables.with_row_id(spark.read.parquet(files).repartition(parts))
    first = _ids(df)
    assert first == _ids(df.coalesce(3)) == _ids(df.where("l_linenumber > 0").orderBy("l_shipdate"))
    assert sorted(first) == list(range(len(first)))


RETRY = """
import sys
from pyspark import TaskContext
from pyspark.sql import SparkSession
from lakewarden.sources import tables
spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", sys.argv[2]).getOrCreate()
spark.sparkContext.setLogLevel("OFF")
def first_try_fails(batches):
    batches = list(batches)
    if TaskContext.get().attemptNumber() == 0:
        raise RuntimeError("lost")
    yield from batches
for df in (spark.read.parquet(sys.argv[1]), spark.read.parquet(sys.argv[1]).repartition(3)):
    df = tables.with_row_id(df).select("l_orderkey", "l_linenumber", "_row_id")
    want, again = sorted(map(tuple, df.collect())), sorted(map(tuple, df.mapInArrow(first_try_fails, df.schema).collect()))
    assert want == again and [r[2] for r in sorted(want, key=lambda r: r[2])] == list(range(len(want)))
print("same")
"""


def test_numbers_survive_tasks_that_are_run_again(files, tmp_path):
    run = subprocess.run([sys.executable, "-c", RETRY, files, str(tmp_path)], capture_output=True, text=True, timeout=300)
    assert "same" in run.stdout, run.stderr[-2000:]


def test_filtered_and_other_scans(spark, files, tmp_path):
    kept = tables.with_row_id(spark.read.parquet(files).where("l_linenumber = 1"))
    assert sorted(r["_row_id"] for r in kept.select("_row_id").collect()) == list(range(kept.count()))
    spark.range(50).write.json(str(tmp_path / "j"))
    assert sorted(r["_row_id"] for r in tables.with_row_id(spark.read.json(str(tmp_path / "j"))).collect()) == list(range(50))
    joined = spark.range(20).join(spark.range(10, 30), "id")
    assert sorted(r["_row_id"] for r in tables.with_row_id(joined).collect()) == list(range(10))
    named = spark.createDataFrame([("x",)], "_metadata string")
    assert tables.with_row_id(named).first()["_row_id"] == 0
    empty = str(tmp_path / "e")
    spark.range(0).write.parquet(empty)
    assert tables.with_row_id(spark.read.parquet(empty)).count() == 0 and tables.block(spark.read.parquet(empty), 0, 5).count() == 0


def test_a_block_reads_only_the_files_that_hold_it(spark, files, tmp_path):
    import shutil

    want = _ids(tables.with_row_id(spark.read.parquet(files)))
    starts = tables.file_starts(spark.read.parquet(files))
    second = starts[1]
    got = tables.block(spark.read.parquet(files), second[1] + 3, 40).collect()
    assert {r["_row_id"]: (r["l_orderkey"], r["l_linenumber"]) for r in got} == {i: want[i] for i in range(second[1] + 3, second[1] + 43)}
    # With all other files spoilt after the places are known, the block can still be read.
    copy = str(tmp_path / "copy")
    shutil.copytree(files, copy)
    df = spark.read.parquet(copy)
    places = tables.file_starts(df)
    chosen = tables._numbered_by_files(df.where(F.col("_metadata.file_path").isin([places[1][0]])), places[1:2])
    for p in sorted(glob.glob(f"{copy}/*.parquet")):
        if not places[1][0].endswith(p.rsplit("/", 1)[1]):
            with open(p, "wb") as f:
                f.write(struct.pack("16x"))
    assert chosen.count() == places[1][2]


def test_a_block_of_a_stored_table_is_pushed_down(spark, files, tmp_path):
    stored = tables.store_numbered(spark.read.parquet(files), str(tmp_path / "stored"))
    part = tables.block(stored, 100, 50)
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(_row_id,100)" in plan and "LessThanOrEqual(_row_id,149)" in plan
    assert sorted(r["_row_id"] for r in part.collect()) == list(range(100, 150))


def test_csv_is_split_unless_cells_are_broken(spark, tmp_path):
    plain, broken = str(tmp_path / "plain.csv"), str(tmp_path / "broken.csv")
    with open(plain, "w") as f:
        f.write("a,b\n" + "".join(f'{i},"say ""{i}"", so"\n' for i in range(3000)))
    with open(broken, "w") as f:
        f.write('a,b\n1,"two\nlines"\n2,x\n')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    df = tables.read_csv(spark, plain)
    parts = df.rdd.getNumPartitions()
    got = {r["a"]: r["b"] for r in df.collect()}
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")
    assert parts > 5 and got == {i: f'say "{i}", so' for i in range(3000)}
    assert [tuple(r) for r in tables.read_csv(spark, broken).collect()] == [(1, "two\nlines"), (2, "x")]


def test_pairs_of_values_that_concatenate_alike(spark):
    rows = [("ab", "c"), ("a", "bc"), (None, "x"), ("x", None), ("", None), (None, "")]
    df = spark.createDataFrame([(i, [a], [b]) for i, (a, b) in enumerate(rows)], "_row_id long, a array<string>, b array<string>")
    digests = [r["d"] for r in df.select(whole.digest(df, ["a", "b"]).alias("d")).collect()]
    assert all(x != y for x, y in itertools.combinations(digests, 2))
