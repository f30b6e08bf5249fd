"""Line de-duplication by overlapping three-line windows, in DataFrame functions alone.

Lines are split at \\n and compared without spaces, tabs and carriage returns at their ends. Each run
of ``lines`` consecutive lines, not all blank, is hashed (MD5). A window seen more than once in the
corpus is kept where it comes first, by doc_id and then place; every later occurrence goes, and the
lines it covers are merged with those of its neighbours before they are cut.

The shuffle holds a row a window; counting is combined before it, and the join that brings a hot
window back to its documents has one row on the other side, which adaptive execution splits.

Defined results: null texts stay null with 0 lines; texts with fewer lines than a window keep them
all; an empty text has one blank line; rows that share a doc_id are documents of their own, in order of their
texts' digests, and of equal rows one is the first; a null doc_id counts as the smallest; extra columns take no
part; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import has_odd_ids, settle

NO_ID = -(2**63)


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r"))


def _window(lines: int, place: Column) -> Column:
    """MD5 of the window of ``bare`` at a place, null where all its lines are blank."""
    joined = F.concat_ws("\n", *[F.get("bare", place + k) for k in range(lines)])
    return F.when(F.length(joined) > lines - 1, F.unhex(F.md5(joined)))


def _held(value: Column) -> Column:
    """The value as a generated column, which the optimizer does not write out again at each use in a lambda."""
    return F.explode(F.array(value))


def remove_lines(docs: DataFrame, lines: int = 3) -> DataFrame:
    """doc_id, n_lines, n_removed and the text that is left, a row a document."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    first = F.coalesce("doc_id", F.lit(NO_ID))
    if has_odd_ids(own):
        rows = settle(own.withColumn("row", F.monotonically_increasing_id()), "rows")
        own = rows.select("doc_id", "text", F.struct(first.alias("own"), F.md5("text").alias("digest"), "row").alias("id"))
    else:
        own = own.withColumn("id", first)
    count = F.size("bare") - (lines - 1)
    bare = own.select("id", _held(F.transform(F.split("text", "\n"), _bare)).alias("bare")).filter(count > 0)
    keys = F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda i: _window(lines, i))
    seen = bare.select("id", keys.alias("keys")).select("id", F.posexplode("keys").alias("place", "key")).filter("key is not null")
    again = seen.groupBy("key").agg(F.min(F.struct("id", "place")).alias("first"), F.count("*").alias("seen")).filter("seen > 1").drop("seen")
    later = seen.join(again, "key").filter((F.col("id") != F.col("first.id")) | (F.col("place") != F.col("first.place")))
    gone = later.groupBy("id").agg(F.collect_set("place").alias("starts"))
    cut = F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s, s + (lines - 1)))))
    places = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), cut)
    left = F.array_join(F.transform(places, lambda i: F.get("parts", i)), "\n")
    total = F.when(F.col("text").isNull(), 0).otherwise(F.size("parts")).cast("long")
    joined = own.join(gone, "id", "left").select("doc_id", "text", "starts", _held(F.split("text", "\n")).alias("parts"))
    return joined.select(
        "doc_id", total.alias("n_lines"), F.when(F.col("starts").isNull(), 0).otherwise(F.size(cut)).cast("long").alias("n_removed"), F.when(F.col("starts").isNull(), F.col("text")).otherwise(left).alias("text")
    )
