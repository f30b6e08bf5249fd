"""Files put together, references, search by index and stored units, on small rows and by what is read."""

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import reading, search, snapshots, trigrams
from lodestrata.sources.unit_store import UnitStore

UNITS = "repo_id string, file_path string, language string, kind string, qualified_name string, parent_qualified_name string, line_start int, line_end int, content string, unit_id string"


def units_of(spark, rows):
    return spark.createDataFrame([("r", p, "python", k, q, None, a, b, c, f"{i:064x}") for i, (p, k, q, a, b, c) in enumerate(rows)], UNITS)


def test_files_put_together(spark):
    rows = [("m.py", "module", "m", 1, 9, "whole\nfile"), ("m.py", "function", "m.f", 3, 4, "f")]
    rows += [("c.py", "class", "C", 1, 10, "class\n\n"), ("c.py", "method", "C.m", 2, 5, "m"), ("c.py", "function", "f", 8, 12, "f\n"), ("c.py", "function", "g", 12, 12, "g")]
    rows += [("n.py", "module", "n", 5, 6, None), ("n.py", "function", "n.f", 7, 8, "tail")]
    found = {r.file_path: r for r in reading.files(units_of(spark, rows)).collect()}
    assert found["m.py"].content == "whole\nfile" and found["c.py"].content == "class\n\nf" and found["n.py"].content == "\n\ntail"
    assert [u.qualified_name for u in found["c.py"].outline] == ["C", "C.m", "f", "g"]
    cut = {r.file_path: (r.content, r.truncated) for r in reading.files(units_of(spark, rows), most_tokens=2).collect()}
    assert cut["m.py"] == ("whole", True) and cut["c.py"] == ("class\n\nf", False)


def test_references(spark):
    rows = [("a/m.py", "function", "f", 2, 3, "x"), ("a/m.py", "module", "m", 1, 9, "y"), ("a/n.py", "class", "C", 1, 4, "z"), ("a/n.py", "class", "D", 1, 8, "w")]
    u = units_of(spark, rows)
    u = u.union(u.withColumn("repo_id", F.lit("q")).withColumn("unit_id", F.concat(F.lit("f"), F.substring("unit_id", 2, 63))))
    asked = spark.createDataFrame([("r", "f"), (None, "f"), ("r", "a/m.py"), ("r", "a/n.py"), ("q", f"{1:064x}"), ("r", "none"), ("x", "f")], "repo_id string, reference string")
    got = {(r.repo_id, r.reference): r.unit_id for r in reading.resolved(u, asked).collect()}
    own = lambda i, mark="0": mark + f"{i:063x}"
    assert got == {("r", "f"): own(0), (None, "f"): own(0, "f"), ("r", "a/m.py"): own(1), ("r", "a/n.py"): own(3), ("q", own(1)): own(1)}


@pytest.mark.parametrize(("asked", "wildcards"), [("fox", False), ("FOX j", False), ("q%brown", True), ("zzz", False), ("ox", False), ("ünï", False), ("%", True), ("x jumps_ove", True), ("a\\%", True)])
def test_index_finds_what_a_scan_finds(spark, asked, wildcards):
    texts = ["the quick brown fox", "fox jumps over", "ÜNÏcode fox", None, "", "ox", "quiet brownie", "100%", "foxfoxfox", "fox jumpsXover"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    match = search.keyword_match(asked, "t") if wildcards else search.plain_match(asked, "t")
    within = trigrams.index(rows, "id", "t").within(rows, "id", [asked], wildcards)
    assert {r.id for r in within.filter(match).collect()} == {r.id for r in rows.filter(match).collect()}


def test_index_reads_few_rows(spark):
    rows = spark.range(20_000).select("id", F.concat(F.lit("unit number "), F.md5(F.col("id").cast("string"))).alias("t"))
    found = trigrams.index(rows, "id", "t")
    name = rows.filter("id = 77").first().t[12:22]
    chosen = found.rarest(name, False)
    read = found.lists.filter(F.col("gram").isin(chosen)).count()
    assert found.candidates(name).count() < 20 and read < 3000
    scan = found.lists.filter(F.col("gram").isin(chosen))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(gram" in scan


def test_stored_units_prune(spark, tmp_path):
    rows = spark.range(4000).select(
        F.concat(F.lit("r"), (F.col("id") % 5).cast("string")).alias("repo_id"),
        F.concat(F.lit("f"), (F.col("id") % 40).cast("string")).alias("file_path"),
        F.col("id").cast("int").alias("line_start"),
        F.col("id").cast("string").alias("qualified_name"),
    )
    store = UnitStore(spark, f"{tmp_path}/units")
    store.write(rows)
    own = store.of_repo("r3")
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(repo_id" in plan and own.count() == 800
    assert all("repo_id=r3" in r.f for r in store.read().filter("repo_id = 'r3'").select(F.input_file_name().alias("f")).distinct().collect())
    one = store.of_file("r3", "f13")
    assert [r.line_start for r in one.collect()] == list(range(13, 4000, 40)) and "EqualTo(file_path,f13)" in one._jdf.queryExecution().executedPlan().toString()


def test_snapshot_ranges_name_what_differs(spark):
    rows = [(str(i), f"row {i}") for i in range(500)]
    was, now = (spark.createDataFrame(x, "key string, record string") for x in (rows, [(k, "row 7b" if k == "7" else r) for k, r in rows if k != "11"]))
    found = {r.part: (r.before, r.after) for r in snapshots.differing(snapshots.ranges(was), snapshots.ranges(now)).collect()}
    import hashlib

    parts = [hashlib.md5(k).hexdigest()[:2] for k in (b"7", b"11")]
    assert set(found) == set(parts) and found[parts[1]][0] == found[parts[1]][1] + 1
    assert snapshots.differing(snapshots.ranges(was), snapshots.ranges(was.repartition(7))).count() == 0
