"""Literal rows for modules at any depth and for overloads."""

import pytest

from lodestrata.operators import build, overloads


def units_of(spark, rows):
    full = [("r", "f.py", f"id{i}", kind, name, parent, i) for i, (kind, name, parent) in enumerate(rows)]
    return spark.createDataFrame(full, "repo_id string, file_path string, unit_id string, kind string, qualified_name string, parent_qualified_name string, line_start int")


def test_module_of_deep_and_circular_parents(spark):
    chain = [("module", "m", None), ("class", "m.c1", "m")] + [("class", f"m.c{i}", f"m.c{i - 1}") for i in range(2, 14)]
    circle = [("class", "a", "b"), ("class", "b", "c"), ("class", "c", "a"), ("method", "a.x", "a")]
    others = [("function", "top", None), ("method", "lost.f", "lost"), ("class", "n", None), ("method", "n.g", "n"), ("module", "m.sub", "m")]
    rows = chain + circle + others
    found = {r.unit_id: r.module for r in build.module_of(units_of(spark, rows)).collect()}
    want = ["m"] * len(chain) + ["a", "b", "c", "a.x"] + ["top", "lost", "n", "n.g", "m.sub"]
    assert [found[f"id{i}"] for i in range(len(rows))] == want


@pytest.mark.parametrize(
    ("names", "want"),
    [
        (["X", "X", "X#2"], ["X", "X#3", "X#2"]),
        (["X", "X", "X", "X#3"], ["X", "X#2", "X#4", "X#3"]),
        (["X", "X", "X", "X", "X#2", "X#4", "X#9"], ["X", "X#3", "X#5", "X#6", "X#2", "X#4", "X#9"]),
        (["X", "X", "X#02", "X#1", "X#2", "X#2"], ["X", "X#3", "X#02", "X#1", "X#2", "X#2#2"]),
    ],
)
def test_numbers_that_are_taken_are_passed_over(spark, names, want):
    rows = [("r", "f", n, None, "function", i, i, i) for i, n in enumerate(names)]
    units = spark.createDataFrame(rows, "repo_id string, file_path string, qualified_name string, parent_qualified_name string, kind string, line_start int, line_end int, place long")
    assert [r.qualified_name for r in overloads.renamed(units).orderBy("place").collect()] == want


def test_methods_follow_their_class(spark):
    rows = [("M.C", "M", "class", 1, 9), ("M.C.m", "M.C", "method", 2, 3), ("M.C", "M", "class", 11, 30), ("M.C.m", "M.C", "method", 12, 13), ("M.C.D", "M.C", "class", 14, 20), ("M.C.o", "M.C", "method", 40, 41)]
    full = [("r", "f", n, p, k, a, b, i) for i, (n, p, k, a, b) in enumerate(rows)]
    units = spark.createDataFrame(full, "repo_id string, file_path string, qualified_name string, parent_qualified_name string, kind string, line_start int, line_end int, place long")
    found = [(r.qualified_name, r.parent_qualified_name) for r in overloads.renamed(units).orderBy("place").collect()]
    assert found == [("M.C", "M"), ("M.C.m", "M.C"), ("M.C#2", "M"), ("M.C.m#2", "M.C#2"), ("M.C.D", "M.C#2"), ("M.C.o", "M.C")]
