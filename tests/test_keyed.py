"""Keyed tables in place, late rows and rings of samples."""

import glob

import pytest
from pyspark.sql.types import StructType

from lodestrata.sources.keyed import KeyedTable, last_rows, new_rows, without
from lodestrata.streaming.arrivals import LateRows


@pytest.fixture
def table(spark, tmp_path):
    return KeyedTable(spark, f"file://{tmp_path}/t", StructType.fromDDL("k string, at long, x string"), ["k"], 8)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_batches_that_come_again(spark, table):
    first, second = (spark.createDataFrame(rows, table.schema) for rows in ([("a", 1, "p"), ("b", 5, "q"), (None, 1, "n")], [("a", 2, "r"), ("b", 4, "s"), ("c", 1, "t")]))
    merge = last_rows(["k"], "at")
    for _ in range(2):
        table.write(first, 0, merge)
        table.write(second, 1, merge)
        table.write(second, 1, merge)
    assert rows_of(table.read()) == [("a", 2, "r"), ("b", 5, "q"), ("c", 1, "t"), (None, 1, "n")]


def test_a_write_touches_its_buckets_alone(spark, table, tmp_path):
    many = spark.createDataFrame([(f"k{i}", 0, "x") for i in range(200)], table.schema)
    assert table.write(many, 0, new_rows(["k"])) == list(range(8))
    before = table.versions()
    touched = table.write(spark.createDataFrame([("k7", 1, "y")], table.schema), 1, new_rows(["k"]))
    after = table.versions()
    assert len(touched) == 1 and [b for b in after if after[b] != before[b]] == touched
    assert len({f.split("/")[-2] for f in glob.glob(f"{tmp_path}/t/rows/{after[touched[0]]}/*/*.parquet")}) == 1
    own = table.read_keys(spark.createDataFrame([("k7",), ("none",)], "k string"))
    assert rows_of(own) == [("k7", 1, "y")]
    assert {f.split("/")[-2] for f in own.inputFiles()} <= {f"bucket={b}" for b in range(8)} and len({f.split("/")[-2] for f in own.inputFiles()}) <= 2


def test_deletes_empty_buckets_and_vacuum(spark, table):
    many = spark.createDataFrame([(f"k{i}", 0, "x") for i in range(50)], table.schema)
    table.write(many, 0, new_rows(["k"]))
    table.write(many, 1, without(["k"]))
    assert table.read().count() == 0
    table.write(spark.createDataFrame([("k1", 2, "z")], table.schema), 2, new_rows(["k"]))
    assert table.vacuum(2) > 0 and rows_of(table.read()) == [("k1", 2, "z")]
    table.write(spark.createDataFrame([("k1", 2, "z")], table.schema), 2, new_rows(["k"]))  # the last batch comes again
    assert rows_of(table.read()) == [("k1", 2, "z")]


def test_a_batch_that_was_cut_off_counts_for_nothing(spark, table, tmp_path):
    table.write(spark.createDataFrame([("a", 1, "p")], table.schema), 0, new_rows(["k"]))

    def fails(old, new):
        return old.unionByName(new).selectExpr("k", "at", "raise_error('lost') as x")

    with pytest.raises(Exception, match="lost"):
        table.write(spark.createDataFrame([("a", 2, "q")], table.schema), 1, fails)
    assert rows_of(table.read()) == [("a", 1, "p")]
    assert table.write(spark.createDataFrame([], table.schema), 1, new_rows(["k"])) == []


def test_late_rows_are_kept_apart(spark, tmp_path):
    writer = LateRows(spark, f"{tmp_path}/late", 10)
    batches = [[(1, 100), (2, 50)], [(3, 90), (4, 89), (5, None)], [], [(6, 130)], [(7, 119), (8, 120)]]
    for _ in range(2):
        for k, rows in enumerate(batches):
            writer.write(spark.createDataFrame(rows, "id long, at_us long"), k)
    read = lambda name: sorted(r.id for r in spark.read.schema("id long").parquet(f"{tmp_path}/late/{name}").collect())
    assert read("late") == [4, 7] and read("on_time") == [1, 2, 3, 5, 6, 8]
