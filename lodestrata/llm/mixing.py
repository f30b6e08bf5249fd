"""Mixing sources to target weights by nested hash-threshold histograms.

Each document has a 48-bit hash of its id. Per source, words are summed by the hash's first 12 bits;
the running sums show which bucket the source's budget ends in. Only that bucket is summed again by
the next 12 bits, four times in all, after which a bucket is one hash value. A document takes one
more copy if its hash is below the final threshold: a filter, with no sort of documents.

Targets: source k (by code point, null last, from 0) weighs ``k % 3 + 1``; all words are shared by
weight, a target stops at ``most`` times its source's words, and the excess is shared again by weight
until none is above. With x = cap / weight ascending this is the level at which capped sources
stop, so it is found by running sums over sources.

Sources are few beside documents: their targets are worked out in one task, a row a source (some millions fit).

Defined results: null and empty texts have size 0 and take 0 words; a source without words has
target 0; equal ids get equal decisions; an empty table gives no rows. Extra columns take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import settle

BITS, LEVELS = 12, 4
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def id_hash(doc_id: Column) -> Column:
    """48 bits of the id's MD5; a null id counts as the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 12), 16, 10).cast("long")


def targets(sizes: DataFrame, most: int = 3) -> DataFrame:
    """(source, source_size, target) from (source, source_size); a row a source."""
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    ranked = sizes.withColumn("weight", ((F.row_number().over(order) - 1) % 3 + 1).cast("double"))
    everyone = Window.partitionBy(F.lit(1))
    full = Window.orderBy("reach", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    levels = (
        ranked.withColumn("cap", (F.col("source_size") * most).cast("double"))
        .withColumn("reach", F.col("cap") / F.col("weight"))
        .withColumn("level", (F.sum("source_size").over(everyone) - F.coalesce(F.sum("cap").over(full), F.lit(0.0))) / (F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(full), F.lit(0.0))))
    )
    stop = F.max(F.when(F.col("level") <= F.col("reach"), F.col("level"))).over(everyone)
    target = F.least(F.col("cap"), F.coalesce(stop, F.lit(0.0)) * F.col("weight"))
    return levels.select("source", "source_size", target.alias("target"))


def _threshold(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """(source, source_size, target, whole, below): whole copies of all, one more below the hash ``below``."""
    size = F.col("source_size")
    whole = F.when(size > 0, F.least(F.floor(F.col("target") / size), F.lit(2))).otherwise(F.lit(0)).cast("long")
    state = goals.withColumn("whole", whole).withColumn("rest", F.when(size > 0, F.col("target") - F.col("whole") * size).otherwise(F.lit(0.0))).withColumn("prefix", F.lit(0).cast("long"))
    for level in range(LEVELS):
        left = BITS * (LEVELS - 1 - level)
        edge = state.select(F.col("source").alias("s"), "prefix", "rest")
        inside = rows.join(edge, rows["source"].eqNullSafe(edge["s"]) & (F.shiftright("hash", left + BITS) == F.col("prefix")) if level else rows["source"].eqNullSafe(edge["s"]))
        # The last bucket that the budget does not pass over; its words remain to be shared out.
        sums = inside.groupBy("s", F.shiftright("hash", left).alias("bucket"), "rest").agg(F.sum("size").alias("words"))
        upto = F.sum("words").over(Window.partitionBy("s").orderBy("bucket")) - F.col("words")
        held = sums.withColumn("before", upto).filter(F.col("before") <= F.col("rest")).groupBy("s").agg(F.max(F.struct("bucket", "before", "words")).alias("edge"))
        last = held.select(F.col("s").alias("t"), F.col("edge.bucket").alias("bucket"), F.col("edge.before").alias("before"), F.col("edge.words").alias("edge_words"))
        state = state.join(last, F.col("source").eqNullSafe(F.col("t")), "left").drop("t")
        state = settle(state.withColumn("prefix", F.coalesce("bucket", "prefix")).withColumn("rest", F.col("rest") - F.coalesce("before", F.lit(0))).drop("bucket", "before").withColumnRenamed("edge_words", f"words_{level}"), "thresholds")
    takes_edge = 2 * F.col("rest") >= F.coalesce(f"words_{LEVELS - 1}", F.lit(0))
    return state.select("source", "source_size", "target", "whole", (F.col("prefix") + F.when(takes_edge, 1).otherwise(0)).alias("below"))


def _goals(docs: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, size, hash) of every document, and the thresholds of the sources with the source as ``s``."""
    rows = settle(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text").cast("string")).alias("size"), id_hash(F.col("doc_id").cast("long")).alias("hash")), "sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    return rows, _threshold(rows, targets(sizes, most)).withColumnRenamed("source", "s")


def _copies(doc_hash: Column, whole: Column, below: Column) -> Column:
    return whole + F.when(doc_hash < below, 1).otherwise(0)


def mix(docs: DataFrame, most: int = 3) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document."""
    rows, goal = _goals(docs, most)
    copies = _copies(F.col("hash"), F.col("whole"), F.col("below"))
    return rows.join(goal, F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "size", "source_size", "target", (copies * F.col("size")).cast("long").alias("taken"), copies.cast("long").alias("copies"))


def repeat(docs: DataFrame, most: int = 3) -> DataFrame:
    """Each row of ``docs`` with all its columns, as many times as ``mix`` takes it; ids may be null or repeated."""
    goal = _goals(docs, most)[1].select(F.struct("s", "whole", "below").alias("_goal"))
    met = docs.join(goal, docs["source"].cast("string").eqNullSafe(F.col("_goal.s")))
    copies = _copies(id_hash(docs["doc_id"].cast("long")), F.col("_goal.whole"), F.col("_goal.below"))
    return met.select(*[docs[c] for c in docs.columns], F.explode(F.array_repeat(F.lit(1), copies.cast("int"))).alias("_copy")).drop("_copy")
