"""Units of one name in a file: later ones get a number, and what they hold a new parent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identity import unit_id

FILE = ["repo_id", "file_path"]


def _order() -> Column:
    return F.struct("line_start", "line_end", "place")


def _taken(units: DataFrame) -> DataFrame:
    """(file, base, gap): names ``base#n`` that units have, with how many free numbers from 2 on stand before each."""
    number = F.regexp_extract("qualified_name", r"(?s)^(.*)#([2-9]|[1-9][0-9]{1,8})$", 2)
    base = F.regexp_extract("qualified_name", r"(?s)^(.*)#([2-9]|[1-9][0-9]{1,8})$", 1)
    named = units.select(*FILE, base.alias("base"), number.alias("number")).filter("number <> ''").distinct()
    nth = F.row_number().over(Window.partitionBy(*FILE, "base").orderBy(F.col("number").cast("long")))
    return named.select(*FILE, "base", (F.col("number").cast("long") - nth - 1).alias("gap"))


def renamed(units: DataFrame) -> DataFrame:
    """``units`` with unit_id, qualified_name and parent_qualified_name as they are stored.

    Of units of one name in a file, by line_start, line_end and ``place``, the second takes ``#2`` and so on; a
    number whose name a unit of the file has already is passed over. The k-th of them takes the k-1st free number,
    so one running count of the taken numbers over each name's units settles all at once. Units whose parent is the
    name of a renamed class, and whose lines lie within its lines, take its new name as their parent; of several
    such classes the first. ``units`` has repo_id, file_path, qualified_name, parent_qualified_name, kind,
    line_start, line_end and place, which tells units of the same lines apart.
    """
    nth = F.row_number().over(Window.partitionBy(*FILE, "qualified_name").orderBy(_order())) - 1
    own = units.withColumn("nth", nth)
    # Items and taken names of a base in one order: an item is past each taken number with at most nth - 1 free ones before.
    items = own.filter("nth > 0").select(*FILE, F.col("qualified_name").alias("base"), (F.col("nth") - 1).cast("long").alias("gap"), F.lit(1).alias("item"), "place")
    marks = _taken(units).select(*FILE, "base", "gap", F.lit(0).alias("item"), F.lit(None).cast("long").alias("place"))
    passed = F.sum(1 - F.col("item")).over(Window.partitionBy(*FILE, "base").orderBy("gap", "item").rowsBetween(Window.unboundedPreceding, 0))
    name = F.concat("base", F.lit("#"), (F.col("gap") + 2 + F.col("passed")).cast("string"))
    names = items.union(marks).withColumn("passed", passed).filter("item = 1").select(*FILE, "place", name.alias("new_name"))
    own = own.join(names, [*FILE, "place"], "left")
    classes = own.filter("new_name IS NOT NULL AND kind = 'class'").select(
        *FILE, F.col("qualified_name").alias("parent_qualified_name"), F.col("line_start").alias("from_line"), F.col("line_end").alias("to_line"), F.col("place").alias("class_place"), F.col("new_name").alias("new_parent")
    )
    inside = (F.col("from_line") <= F.col("line_start")) & (F.col("line_end") <= F.col("to_line")) & (F.col("class_place") != F.col("place"))
    held = own.select(*FILE, "parent_qualified_name", "line_start", "line_end", "place").join(classes, [*FILE, "parent_qualified_name"]).filter(inside)
    first = F.min_by("new_parent", F.struct("from_line", "to_line", "class_place")).alias("new_parent")
    own = own.join(held.groupBy(*FILE, "place").agg(first), [*FILE, "place"], "left")
    qname = F.coalesce("new_name", "qualified_name")
    stored = {"qualified_name": qname, "parent_qualified_name": F.coalesce("new_parent", "parent_qualified_name"), "unit_id": unit_id(F.col("repo_id"), F.col("file_path"), qname)}
    return own.withColumns(stored).select(*dict.fromkeys([*units.columns, "unit_id"]))
