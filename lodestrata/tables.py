"""The model tables, derived from the given ones: units, nodes, edges, events as usage and latency samples.

Each has the same definition as a DuckDB common table expression in ``lodestrata.plans.views``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.identity import unit_id
from .functions.paths import first_paragraph
from .shared import spread

KINDS = ["module", "class", "function", "method", "constant", "section"]
NOW = "2024-01-31 00:00:00"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One unit a document: repo is its source, module its source and language."""
    d = load(spark, sf_dir, "documents")
    name = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    path = F.concat_ws("/", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".md")))
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("doc_id") % 6 + 1).cast("int"))
    return d.select(
        unit_id(F.col("source"), path, F.concat_ws(".", "source", "lang", name)).alias("unit_id"),
        F.col("doc_id"),
        F.col("source").alias("repo_id"),
        path.alias("file_path"),
        F.col("lang").alias("language"),
        kind.alias("kind"),
        name.alias("name"),
        F.concat_ws(".", "source", "lang", name).alias("qualified_name"),
        F.concat_ws(".", "source", "lang").alias("parent_qualified_name"),
        F.col("text").alias("content"),
        first_paragraph(F.col("text")).alias("docstring"),
        F.concat(name, F.lit("("), F.col("lang"), F.lit(")")).alias("signature"),
        F.sha2("text", 256).alias("source_sha"),
        (F.unix_seconds(F.lit("2024-01-01").cast("timestamp")) + F.col("doc_id") * 60).alias("updated_s"),
        (F.col("doc_id") % 97 + 1).alias("line_start"),
        (F.col("doc_id") % 97 + 1 + F.col("n_chars") % 40).alias("line_end"),
    )


def code_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the units of source files: twelve ids a file and language, with names, parents and references.

    Files whose first document has another language have no module; names with a leading underscore are private.
    """
    d = load(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    file, place = "cast(floor(doc_id / 12) as bigint)", "doc_id % 12"
    leaf = lambda at: f"(case when ({at}) % 5 = 0 then '_d' else 'd' end || cast({at} as string))"
    module = lambda at: f"('src.f' || cast({at} as string))"
    own = f"case when {place} = 0 then 'f' || cast({file} as string) else {leaf('doc_id')} end"
    parent = f"""case when {place} = 0 then null when {place} between 6 and 8 then {module(file)} || '.' || {leaf(f"{file} * 12 + 1")}
        when {place} = 10 then {module(file)} || '.' || {leaf(f"{file} * 12 + 2")} else {module(file)} end"""
    near = lambda k: leaf(f"{file} * 12 + {k}")
    refs = lambda holds, *items: F.expr(f"case when {place} {holds} then array({', '.join(items)}) else cast(array() as array<string>) end")
    kinds = "module class class function function function method method method constant constant section".split()
    named = d.select(
        "doc_id", F.col("lang").alias("repo_id"), F.expr(f"'src/f' || cast({file} as string) || '.py'").alias("file_path"), F.element_at(F.array(*map(F.lit, kinds)), F.expr(f"cast({place} + 1 as int)")).alias("kind"),
        F.expr(own).alias("name"), F.expr(parent).alias("parent_qualified_name"), F.col("text").alias("content"), F.sha2("text", 256).alias("source_sha"), (F.col("doc_id") % 12 * 10 + 1).alias("line_start"),
        refs("in (0, 11)", module(f"({file} + 1)"), "'sys'", module(file)).alias("imports"),
        refs("between 3 and 8", near(3), near(9), f"{module(f'({file} + 1)')} || '.' || {near(16)}", "'print'").alias("calls"),
        refs("in (1, 2)", near(2), f"{module(f'({file} + 1)')} || '.' || {near(13)}", "'object'").alias("bases"),
    )
    qname = F.when(F.col("kind") == "module", F.expr(module(file))).otherwise(F.concat_ws(".", "parent_qualified_name", "name"))
    named = named.withColumn("qualified_name", qname)
    return named.withColumn("unit_id", unit_id(F.col("repo_id"), F.col("file_path"), F.col("qualified_name")))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions are files, nations modules, suppliers classes, customers functions, parts methods or external."""
    text = lambda c: F.col(c).cast("string")
    nation = load(spark, sf_dir, "nation")
    module = F.concat(F.lit("r"), text("n_regionkey"), F.lit(".n"), text("n_nationkey"))
    row = lambda df, prefix, key, kind, qname, repo: df.select(F.concat(F.lit(prefix + ":"), text(key)).alias("node_id"), kind.alias("kind"), repo.alias("repo_id"), qname.alias("qualified_name"), F.concat(F.lit(prefix[0]), text(key)).alias("name"))
    region = row(load(spark, sf_dir, "region"), "region", "r_regionkey", F.lit("File"), F.concat(F.lit("r"), text("r_regionkey")), F.concat(F.lit("r"), text("r_regionkey")))
    modules = row(nation, "nation", "n_nationkey", F.lit("Module"), module, F.concat(F.lit("r"), text("n_regionkey")))
    places = nation.select("n_nationkey", "n_regionkey")
    supplier = load(spark, sf_dir, "supplier").join(places, F.col("s_nationkey") == F.col("n_nationkey"))
    customer = load(spark, sf_dir, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    repo = F.concat(F.lit("r"), text("n_regionkey"))
    classes = row(supplier, "supplier", "s_suppkey", F.lit("Class"), F.concat(module, F.lit(".s"), text("s_suppkey")), repo)
    functions = row(customer, "customer", "c_custkey", F.lit("Function"), F.concat(module, F.lit(".c"), text("c_custkey")), repo)
    kind = F.when(F.col("p_partkey") % 37 == 0, "External").otherwise("Method")
    parts = row(load(spark, sf_dir, "part"), "part", "p_partkey", kind, F.concat(F.lit("p"), text("p_partkey")), F.lit("parts"))
    return region.union(modules).union(classes).union(functions).union(parts)


def edge_parts(spark: SparkSession, sf_dir: str) -> int:
    """In how many tasks edges are dealt out."""
    return spread(load(spark, sf_dir, "lineitem"))


def edges(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """(src_id, kind, dst_id), distinct, dealt out by src_id.

    Rows seldom repeat, so they are dealt out before they are made distinct, not cut down in each task first, and what
    goes on by src_id needs no other shuffle. Orders are looked up by hash: lines are not sorted.
    """
    parts = parts or edge_parts(spark, sf_dir)
    name = lambda prefix, c: F.concat(F.lit(prefix + ":"), F.col(c).cast("string"))
    row = lambda df, a, kind, b: df.select(a.alias("src_id"), F.lit(kind).alias("kind"), b.alias("dst_id"))
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").repartition(parts, "o_orderkey")
    calls = lines.join(orders.hint("shuffle_hash"), F.col("o_orderkey") == F.col("l_orderkey"))
    defined = load(spark, sf_dir, "customer").filter("c_custkey % 5 <> 0")
    return (
        row(load(spark, sf_dir, "nation"), name("region", "n_regionkey"), "CONTAINS", name("nation", "n_nationkey"))
        .union(row(load(spark, sf_dir, "supplier"), name("nation", "s_nationkey"), "DEFINES", name("supplier", "s_suppkey")))
        .union(row(defined, name("nation", "c_nationkey"), "DEFINES", name("customer", "c_custkey")))
        .union(row(lines, name("supplier", "l_suppkey"), "DEFINES", name("part", "l_partkey")))
        .union(row(calls, name("customer", "o_custkey"), "CALLS", name("part", "l_partkey")))
        .repartition(parts, "src_id")
        .distinct()
    )


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity_id, event_id, ts, at_us, event_type, value, shard): accesses, attempts and latency samples at once."""
    e = load(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("customer:"), F.col("user_id").cast("string")).alias("entity_id"), "event_id", "user_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"), (F.col("user_id") % 4).alias("shard"))
