"""Filters, top-k searches, fusion of channels, ranking and packing under a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring

TYPE_OF_KIND = {"function": "code", "method": "code", "class": "architecture", "module": "architecture", "constant": "constraint", "section": "logic"}


def keyword_match(text: str, *columns: str) -> Column:
    """Case-insensitive substring in any column; % and _ in the text act as wildcards."""
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.col(c).ilike(f"%{text}%"), F.lit(False))
    return found


def plain_match(text: str, *columns: str) -> Column:
    """Case-insensitive substring in any column, taken literally."""
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.contains(F.lower(F.col(c)), F.lit(text.lower())), F.lit(False))
    return found


def keyword_top_k(units: DataFrame, text: str, k: int, kinds: list[str] | None = None) -> DataFrame:
    hits = units.filter(keyword_match(text, "qualified_name", "name", "docstring", "signature"))
    if kinds:
        hits = hits.filter(F.col("kind").isin(kinds))
    return hits.orderBy(F.desc("updated_s"), "unit_id").limit(max(k, 1))


def autocomplete(units: DataFrame, text: str, k: int) -> DataFrame:
    return units.filter(plain_match(text, "qualified_name")).orderBy(F.length("qualified_name"), "qualified_name").limit(k)


def find_symbol(units: DataFrame, text: str, k: int) -> DataFrame:
    """The k best names over all repositories; a repository with more than k hits is truncated."""
    order = Window.partitionBy("repo_id").orderBy(F.length("qualified_name"), "qualified_name")
    held = units.filter(plain_match(text, "qualified_name", "name")).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k + 1)
    more = held.groupBy("repo_id").agg((F.max("place") > k).alias("truncated"))
    return held.filter(F.col("place") <= k).join(more, "repo_id").orderBy(F.length("qualified_name"), "qualified_name", "repo_id").limit(k)


def cosine_top_k(vectors: DataFrame, query: list[float], k: int, kinds: list[str] | None = None) -> DataFrame:
    """Exact: cut at k by raw cosine and id, clip, and only then filter kinds, so fewer than k may stay."""
    asked = F.array(*[F.lit(float(x)) for x in query])
    norm = sum(x * x for x in query) ** 0.5
    if norm == 0:
        return vectors.limit(0).withColumn("score", F.lit(0.0))
    own = F.sqrt(scoring.dot(F.col("vector"), F.col("vector")))
    usable = vectors.filter(F.col("vector").isNotNull() & (F.size("vector") == len(query)))
    scored = usable.withColumn("raw", F.round(scoring.dot(F.col("vector"), asked) / (F.when(own == 0, 1.0).otherwise(own) * F.lit(norm)), 9))
    best = scored.orderBy(F.desc("raw"), "unit_id").limit(k).withColumn("score", scoring.clip(F.col("raw"))).drop("raw")
    return best.filter(F.col("kind").isin(kinds)) if kinds else best


def fuse(vector: DataFrame, graph: DataFrame, keyword: DataFrame) -> DataFrame:
    """A row a unit from three channels of (unit_id, score or depth): cosine, depth, keyword score and channels."""
    rows = (
        graph.select("unit_id", F.lit("graph").alias("channel"), F.lit(None).cast("double").alias("cosine"), F.col("depth").cast("long").alias("depth"), F.lit(None).cast("double").alias("keyword"))
        .unionByName(keyword.select("unit_id", F.lit("metadata").alias("channel"), F.lit(None).cast("double").alias("cosine"), F.lit(None).cast("long").alias("depth"), F.lit(scoring.KEYWORD_SCORE).alias("keyword")))
        .unionByName(vector.select("unit_id", F.lit("vector").alias("channel"), F.col("score").alias("cosine"), F.lit(None).cast("long").alias("depth"), F.lit(None).cast("double").alias("keyword")))
    )
    return rows.groupBy("unit_id").agg(F.max("cosine").alias("cosine"), F.min("depth").alias("depth"), F.max("keyword").alias("keyword"), F.array_sort(F.collect_set("channel")).alias("channels"))


def provenance(channels: list[DataFrame]) -> DataFrame:
    """(unit_id, file_path, qualified_name, kind): of each the first that is known, in the order of the channels."""
    names, rows = ["file_path", "qualified_name", "kind"], None
    for place, channel in enumerate(channels):
        own = channel.select("unit_id", F.lit(place).alias("_place"), *names)
        rows = own if rows is None else rows.unionByName(own)
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("_place", F.col(c).alias("value"))))["value"].alias(c)
    return rows.groupBy("unit_id").agg(*[first(c) for c in names])


def rank(fused: DataFrame, k: int | None = None) -> DataFrame:
    """Final scores from the channels' features; features without a source are 0."""
    semantic = F.greatest(scoring.clip(F.coalesce("cosine", F.lit(0.0))), F.coalesce("keyword", F.lit(0.0)))
    near = F.when(F.col("depth").isNotNull(), scoring.proximity(F.col("depth"))).otherwise(0.0)
    zero = F.lit(0.0)
    scored = fused.withColumn("semantic", semantic).withColumn("graph", near)
    final = scoring.weighted({"semantic": F.col("semantic"), "graph": F.col("graph"), "recency": zero, "importance": zero, "feedback": zero}, scoring.RANKING)
    scored = scored.withColumn("final_score", F.round(final, 6))
    return scored.orderBy(F.desc("final_score"), "unit_id").limit(k) if k else scored


def context_type(kind: Column) -> Column:
    out = F.lit("code")
    for name, value in TYPE_OF_KIND.items():
        out = F.when(kind == name, value).otherwise(out)
    return out


def context_cost(unit_id: Column, values: list[Column], channels: Column) -> Column:
    """A quarter of the characters of an entry's id and values, rounded up."""
    total = F.length(unit_id) + scoring.list_repr_length(channels)
    for v in values:
        total = total + F.length(F.coalesce(v, F.lit("")))
    return F.ceil(total / 4).cast("long")


def pack_greedy(entries: DataFrame, key: str, order: list[Column], cost: str, budget: int) -> DataFrame:
    """Entries that fit in order: one too large is passed over, later smaller ones are still taken.

    The entries of a key (a ranked request, at most a few hundred) are folded as one ordered array.
    """
    fields = F.struct(*[o.alias(f"_{i}") for i, o in enumerate(order)], F.struct(*[F.col(c) for c in entries.columns]).alias("entry"))
    held = entries.groupBy(key).agg(F.array_sort(F.collect_list(fields)).alias("held"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.slice(F.col("held"), 1, 0).alias("taken"))

    def take(state: Column, x: Column) -> Column:
        fits = state["used"] + x["entry"][cost] <= budget
        return F.struct(F.when(fits, state["used"] + x["entry"][cost]).otherwise(state["used"]).alias("used"), F.when(fits, F.concat(state["taken"], F.array(x))).otherwise(state["taken"]).alias("taken"))

    taken = held.select(F.aggregate("held", start, take)["taken"].alias("taken"))
    return taken.select(F.posexplode("taken").alias("place", "x")).select((F.col("place") + 1).cast("long").alias("place"), "x.entry.*")


def pack_prefix(entries: DataFrame, key: list[str], order: list[Column], cost: str, budget: int) -> DataFrame:
    """Entries up to the first that breaks the budget; the first entry always stays."""
    window = Window.partitionBy(*key).orderBy(*order)
    upto = F.sum(cost).over(window.rowsBetween(Window.unboundedPreceding, 0))
    return entries.withColumn("used", upto).withColumn("place", F.row_number().over(window)).filter((F.col("used") <= budget) | (F.col("place") == 1))
