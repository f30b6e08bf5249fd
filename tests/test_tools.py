"""The request surface on the smallest tables."""

import pytest
from lodestrata.plans.retrieval import asked_vector, vectors
from lodestrata.tables import edges, nodes, units
from lodestrata.tables import code_units
from lodestrata.tools import Tools, call, registry
from pyspark.sql import Window
from pyspark.sql import functions as F

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tools(spark):
    near = vectors(spark, SF_DIR).withColumn("unit_id", F.col("unit_id").cast("string"))
    return Tools(units(spark, SF_DIR), nodes(spark, SF_DIR), edges(spark, SF_DIR), near)


def test_requests(spark, tools):
    found = tools.search_code("the", top_k=10, vector=asked_vector(spark, SF_DIR))
    assert found.count() == 10 and found.agg(F.max("final_score")).first()[0] == 0.35
    first = tools.units.orderBy("doc_id").first()
    assert {tools.read_unit(r).first()["doc_id"] for r in (first["unit_id"], first["qualified_name"], first["file_path"])} == {first["doc_id"]}
    assert tools.read_file(first["repo_id"], first["file_path"]).count() == 1
    assert [r.qualified_name for r in tools.suggest(first["name"]).collect()] == [first["qualified_name"]]
    assert tools.find_symbol("d1", 5).count() == 5
    module = tools.nodes.filter("kind = 'Module'").orderBy("node_id").first()["qualified_name"]
    found = tools.explore(module, "all", 2).collect()
    assert len(found) == 50 and all(r.truncated for r in found) and {r.relation for r in found if r.distance == 1} == {"CONTAINS <-", "DEFINES ->"}
    assert tools.explore(module, "callers").count() == 0 and tools.explore_edges(module).count() > 0
    assert tools.parents(first["unit_id"]).first()["name"] == first["parent_qualified_name"]
    assert all(r.kind == "External" for r in tools.risks("r0.n0.c1").collect())
    assert tools.repo_graph("r1").count() > 0
    assert tools.module_summary(first["parent_qualified_name"]).count() > 0 and tools.repo_overview(first["repo_id"]).count() > 0


def test_ranges(tools):
    for call in (lambda: tools.find_symbol("x", 101), lambda: tools.search_code("x", top_k=0), lambda: tools.explore("x", "callers", 6), lambda: tools.explore("x", "sideways")):
        with pytest.raises(ValueError, match="must be"):
            call()


@pytest.fixture(scope="module")
def code(spark):
    own = code_units(spark, SF_DIR).withColumns({"language": F.lit("python"), "line_end": F.col("line_start") + 5})
    links = own.select(F.col("unit_id").alias("src_id"), F.lit("CALLS").alias("kind"), F.first("unit_id").over(Window.partitionBy("repo_id").orderBy("doc_id")).alias("dst_id"))
    return Tools(own, nodes(spark, SF_DIR), links)


def test_units_and_files_as_callers_get_them(code):
    unit = code.units.filter("kind = 'method'").orderBy("doc_id").first()
    for reference in (unit["unit_id"], unit["qualified_name"]):
        found = code.read_unit(reference, unit["repo_id"]).collect()
        assert [r.unit_id for r in found] == [unit["unit_id"]]
        assert found[0].parent_chain[0].qualified_name == unit["parent_qualified_name"]
    assert code.read_unit(unit["qualified_name"], "no such repository").count() == 0
    file = code.read_file(unit["repo_id"], unit["file_path"]).collect()
    assert len(file) == 1 and unit["qualified_name"] in [u.qualified_name for u in file[0].outline]
    lost = code.similar_paths(unit["repo_id"], unit["file_path"].upper()).first()
    assert unit["file_path"] in lost.similar and code.read_file(unit["repo_id"], unit["file_path"].upper()).count() == 0


def test_overview_of_one_repository_is_its_part_of_all(code):
    from lodestrata.operators import overview

    repo = code.units.orderBy("doc_id").first()["repo_id"]
    every = overview.overview(code.units, code.edges).filter(F.col("repo_id") == repo)
    assert sorted(map(tuple, code.repo_overview(repo).collect())) == sorted(map(tuple, every.collect()))
    module = code.units.filter("kind = 'module'").orderBy("doc_id").first()
    card = code.get_module_summary(module["qualified_name"], module["repo_id"]).first()
    assert card.file == module["file_path"] and card.unit_count >= 1


def test_tools_by_name(code):
    assert registry()["read_file"] == ["repo_id", "path"] and "search_code" in registry()
    assert call(code, "suggest", name="d1").count() > 0
    for wrong in (lambda: call(code, "drop_all"), lambda: call(code, "suggest", names=["d1"])):
        with pytest.raises(ValueError, match="there are|does not take"):
            wrong()
