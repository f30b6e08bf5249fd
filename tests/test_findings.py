"""What a review of the queries found, a small case each."""

import hashlib
import re
import time

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lodestrata.functions.text import cut_at_line
from lodestrata.operators import snapshots
from lodestrata.operators.integrity import resolve_access
from lodestrata.operators.snapshots import vector_digest
from lodestrata.operators.trigrams import grams
from lodestrata.plans import graph as plans
from lodestrata.sources import parsers, store

SF_DIR = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_cut_that_ends_with_a_line_keeps_that_line(spark):
    df = spark.createDataFrame([("ab\ncdefgh\nijk",), ("ab\ncdefghi\nk",), ("abc\ncdef\n\nk",)], "t string")
    assert [r.c for r in df.select(cut_at_line(F.col("t"), 2).alias("c")).collect()] == ["ab", "ab", "abc"]
    df = spark.createDataFrame([("ab\ncdef\nijk",), ("ab\ncde\n\nijk",)], "t string")
    assert [r.c for r in df.select(cut_at_line(F.col("t"), 2).alias("c")).collect()] == ["ab\ncdef", "ab\ncde\n"]


def test_streams_read_tables_that_are_folders_or_empty(spark, tmp_path):
    for name in ("pages", "events"):
        table = spark.read.parquet(f"{SF_DIR}/{name}.parquet")
        table.repartition(3).write.parquet(f"{tmp_path}/folders/{name}.parquet")
        table.limit(0).write.parquet(f"{tmp_path}/empty/{name}.parquet")
    for name in ("stream_pushes", "stream_counters"):
        found = rows(entry.queries()[name](spark, f"{tmp_path}/folders"))
        assert found and found == rows(entry.queries()[name](spark, SF_DIR))
        assert rows(entry.queries()[name](spark, f"{tmp_path}/empty")) == []


def test_trigrams_of_long_texts_take_linear_time(spark):
    long = "".join(chr(97 + i * i % 23) + ("Ä𝄞" if i % 1000 == 0 else "") for i in range(300_000))
    texts = [long, "ab", "", None, "ABCabc", "a\u0130\n ß"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    began = time.monotonic()
    found = {r.k: r for r in df.select("k", grams(F.col("t")).alias("g"), F.lower("t").alias("low")).collect()}
    assert time.monotonic() - began < 60
    for k in range(len(texts)):
        low = found[k].low or ""
        got = found[k].g
        assert len(got) == len(set(got)) and set(got) == {low[i : i + 3] for i in range(len(low) - 2)}


def test_digests_round_halves_to_even(spark):
    df = spark.createDataFrame([(1, [0.0078125, 0.0234375, -0.0]), (2, [1.5, None]), (3, None)], "k int, v array<float>")
    found = {r.k: r.d for r in df.select("k", vector_digest(F.col("v")).alias("d")).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert found == {1: sha("0.007812,0.023438,-0.000000"), 2: sha("1.500000"), 3: None}


@pytest.mark.parametrize("name", ["watched_units", "watched_edges"])
def test_watched_file_whose_functions_all_go(spark, tmp_path, name):
    spark.range(73).select(F.col("id").alias("doc_id")).write.parquet(f"{tmp_path}/documents.parquet")  # the last file has one function, which goes
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert rows(entry.queries()[name](spark, str(tmp_path))) == sorted(con.execute(entry.oracle_sql()[name]).fetchall())


def test_grants_are_not_dealt_out_by_repository(spark):
    users = spark.createDataFrame([(1, 7, "A", 0), (2, 7, "B", 1)], "user_id long, team int, role string, org long")
    repos = spark.createDataFrame([(5, 0), (6, 1)], "repo long, org long")
    direct = spark.createDataFrame([(1, 5, 2), (1, 6, 3)], "user_id long, repo long, level int")
    team = spark.createDataFrame([(7, 5, 3)], "team int, repo long, level int")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # sizes are not known beforehand
    try:
        found = resolve_access(users, repos, direct, team, ["B"], [])
        plan = found._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert rows(found) == [(1, 5, "admin"), (2, 6, "admin")]
    assert plan.split("== Physical Plan ==")[1].count("BroadcastHashJoin") == 3
    assert "REPARTITION_BY_NUM" in plan  # users, before each has the grants of a team


def test_ranges_that_differ_need_no_order(spark):
    state = lambda before, after: [("a", "x", before, after), ("b", "y", before, after), ("b", "y", before, after)]
    same = [*state(True, False), *reversed(state(False, True))]
    df = lambda held: spark.createDataFrame(held, "key string, record string, before boolean, after boolean")
    assert rows(snapshots.differing(df(same))) == []
    part = {k: hashlib.md5(k.encode()).hexdigest()[:2] for k in "abc"}
    assert rows(snapshots.differing(df([*same[:-1], ("c", "z", False, True)]))) == sorted([(part["a"], 1, 0), (part["c"], 0, 1)])
    assert rows(snapshots.differing(df(same[1:]))) == [(part["a"], 0, 1)]
    assert rows(snapshots.differing(df([("b", "y", True, True), ("b", "y", True, False)]))) == [(part["b"], 2, 1)]  # the same record twice is not the same as once
    plan = entry.queries()["snapshot_differences"](spark, SF_DIR)._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "Sort" not in plan.replace("SortMergeJoin", "") and "MapInArrow" not in plan


@pytest.mark.parametrize("name", ["graph_slices", "slice_neighbours", "graph_validate", "upsert_edges", "corruption_rollup", "refresh_plan"])
def test_edges_are_dealt_out_by_their_number(spark, monkeypatch, name):
    monkeypatch.setattr("lodestrata.shared.ROWS", 500)  # 6,005 lines or so
    plan = entry.queries()[name](spark, SF_DIR)._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    n = -(-spark.read.parquet(f"{SF_DIR}/lineitem.parquet").count() // 500)
    assert n > 10 and re.search(rf"hashpartitioning\(src_id#\d+, {n}\), REPARTITION_BY_NUM", plan)
    assert not re.search(r"hashpartitioning\(o_custkey#\d+L?, l_partkey", plan)


def test_edges_are_judged_once_and_not_sorted(spark):
    edges = spark.createDataFrame([("f", "CONTAINS", "m"), ("f", "CONTAINS", "m"), ("m", "DEFINES", "x"), ("m", "CONTAINS", "f"), (None, "CALLS", "m")], "src_id string, kind string, dst_id string")
    nodes = spark.createDataFrame([("f", "File"), ("m", "Module")], "node_id string, kind string")
    judged = store.judged_edges(edges, nodes, 3)
    assert sorted(map(tuple, judged.collect()), key=repr) == sorted([("f", "CONTAINS", "m", None), ("m", "DEFINES", "x", "missing"), ("m", "CONTAINS", "f", "rule"), (None, "CALLS", "m", "missing")], key=repr)
    plan = entry.queries()["upsert_edges"](spark, SF_DIR)._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert plan.count("lineitem.parquet") == 2  # pairs of suppliers and of customers, each once


def test_files_of_an_ingest_are_parsed_once(spark, monkeypatch):
    asked = []
    parse = parsers.units
    monkeypatch.setattr(parsers, "units", lambda *args: asked.append(1) or parse(*args))
    assert entry.queries()["ingest_run"](spark, SF_DIR).count() == 1
    assert len(asked) == 1


def test_both_signatures_in_one_pass(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "node_id string")
    edges = spark.createDataFrame([("a", "CALLS", "b"), ("a", "DEFINES", "c"), ("b", "CALLS", "c")], "src_id string, kind string, dst_id string")
    now, before = (dict(rows(plans.signatures(nodes, e))) for e in (edges, edges.filter("kind <> 'CALLS'")))
    assert rows(plans.signed_twice(nodes, edges)) == [(n, now[n], before[n]) for n in "abc"]
