"""Checks of one state against another, and access rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import cosine, severity

LEVELS = ["read", "write", "admin"]


def vector_shifts(before: DataFrame, after: DataFrame) -> DataFrame:
    """(id, shift): cosine distance of ids that both have."""
    now = after.select("id", F.col("vector").alias("now"))
    return before.join(now, "id").select("id", F.round(1 - cosine(F.col("vector"), F.col("now")), 6).alias("shift"))


def ranking_drift(ranks: DataFrame, key: str, item: str, k: int) -> DataFrame:
    """(key, distance, severity, affected) of the sets that rank within k in columns a and b; an empty baseline has none.

    ``affected`` are the first ten items, in order, that only one of the two has.
    """
    in_a, in_b = F.col("a") <= k, F.col("b") <= k
    near = ranks.filter(in_a | in_b)  # at most 2 * k rows a key
    either = F.array_sort(F.collect_list(F.when(in_a != in_b, F.col(item))))
    sets = near.groupBy(key).agg(F.count_if(in_a).alias("base"), F.count_if(in_a & in_b).alias("both"), F.count("*").alias("either"), F.slice(either, 1, 10).alias("affected"))
    distance = F.when(F.col("base") == 0, 0.0).otherwise(1 - F.col("both") / F.col("either"))
    return sets.select(key, F.round(distance, 6).alias("distance"), "affected").withColumn("severity", severity(2 * F.col("distance")))


def shard_divergence(edges: DataFrame, key: list[str], shards: int) -> DataFrame:
    held = edges.groupBy(*key).agg(F.countDistinct("shard").alias("n"))
    missing = F.count_if(F.col("n") < shards)
    return held.agg(F.count("*").alias("n_edges"), missing.alias("n_divergent"), F.round(missing / F.count("*"), 6).alias("divergence"))


def store_consistency(stores: list[DataFrame]) -> DataFrame:
    """(stores, n, first_id, flag) by which stores hold an id; one shuffle over the tagged union."""
    tagged = reduce(DataFrame.union, [s.select("id", F.lit(i).alias("store")) for i, s in enumerate(stores)])
    marks = [F.max((F.col("store") == i).cast("int")) for i in range(len(stores))]
    held = tagged.groupBy("id").agg(F.concat(*[m.cast("string") for m in marks]).alias("stores"), reduce(Column.__add__, marks).alias("count"))
    flag = F.when(F.col("count") == 1, "only").when(F.col("count") == len(stores), "all").otherwise("unflagged")
    return held.withColumn("flag", flag).groupBy("stores", "flag").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


def audit_records(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(entity_id, before_hash, after_hash, action) of keys whose ``sha`` differs; what is not there counts as 64 zeros."""
    zero = F.lit("0" * 64)
    both = before.withColumnRenamed("sha", "b").join(after.withColumnRenamed("sha", "a"), key, "full_outer").filter(~F.col("a").eqNullSafe(F.col("b")))
    action = F.when(F.col("b").isNull(), "create").when(F.col("a").isNull(), "delete").otherwise("update")
    return both.select(F.col(key).alias("entity_id"), F.coalesce("b", zero).alias("before_hash"), F.coalesce("a", zero).alias("after_hash"), action.alias("action"))


def resolve_access(users: DataFrame, repos: DataFrame, direct: DataFrame, team: DataFrame, privileged: list[str], capped: list[str]) -> DataFrame:
    """(user_id, repo, access): the highest grant within the user's organisation.

    Privileged roles are admin on all of its repositories, granted or not; capped ones only read. Grants to other
    organisations' repositories count for nothing. ``users`` has user_id, team, role and org, ``repos`` repo and org.
    Team grants are cut to one row a team and repository before they meet the members. They and the list of
    repositories go to all tasks: by their few keys, each task would sort a large part of all grants.
    """
    repos = F.broadcast(repos)
    by_team = team.groupBy("team", "repo").agg(F.max("level").alias("level"))
    mine = direct.groupBy("user_id", "repo").agg(F.max("level").alias("level"))
    n = int(users.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # stated, as a small file of users is one task, and each has all grants of a team
    members = users.select("user_id", "team").repartition(n, "user_id")
    grants = mine.unionByName(members.join(F.broadcast(by_team), "team").select("user_id", "repo", "level"))
    own = users.filter(~F.col("role").isin(privileged)).select("user_id", "role", "org")
    held = grants.groupBy("user_id", "repo").agg(F.max("level").alias("level")).join(own, "user_id").join(repos, ["repo", "org"])
    level = F.when(F.col("role").isin(capped), 1).otherwise(F.col("level"))
    granted = held.select("user_id", "repo", F.element_at(F.array(*map(F.lit, LEVELS)), level).alias("access"))
    everything = users.filter(F.col("role").isin(privileged)).select("user_id", "org").join(repos, "org").select("user_id", "repo", F.lit("admin").alias("access"))
    return granted.union(everything)


def first_decision(policies: list[tuple[int, str, Column]], before: Column | None = None) -> Column:
    """(allowed, policy, trace): policies by (priority, name), each ALLOW, DENY or NEUTRAL, until the first that decides; none allows.

    ``before`` is a check that, if it denies, decides alone (its name is tenant_ownership).
    """
    ordered = sorted(policies, key=lambda p: p[:2])
    allowed, name, trace = F.lit(True), F.lit(None).cast("string"), F.lit("")
    for _, policy, effect in reversed(ordered):
        neutral = effect == "NEUTRAL"
        allowed = F.when(neutral, allowed).otherwise(effect == "ALLOW")
        name = F.when(neutral, name).otherwise(F.lit(policy))
        trace = F.concat(F.lit(f",{policy}="), F.lower(effect), F.when(neutral, trace).otherwise(F.lit("")))
    if before is None:
        return F.struct(allowed.alias("allowed"), name.alias("policy"), F.substring(trace, 2, 2**31 - 1).alias("trace"))
    own = "tenant_ownership"
    return F.struct(
        (before & allowed).alias("allowed"), F.when(before, name).otherwise(F.lit(own)).alias("policy"), F.when(before, F.concat(F.lit(f"{own}=allow"), trace)).otherwise(F.lit(f"{own}=deny")).alias("trace")
    )


def deny_external_retrieval(action: Column, kind: Column) -> Column:
    return F.when((action == "retrieve") & (F.lower(kind) == "external"), "DENY").otherwise("NEUTRAL")


def restrict_tool_by_role(action: Column, role: Column, tool: Column, allowed: dict[str, list[str]]) -> Column:
    """Tools under the role ``*`` are for all; other roles and tools that are not named are denied."""
    fits = tool.isin(allowed.get("*", []))
    for name, tools in allowed.items():
        fits = fits | ((role == name) & tool.isin(tools))
    return F.when(action != "mcp_tool", "NEUTRAL").when(F.coalesce(fits, F.lit(False)), "ALLOW").otherwise("DENY")


def limit_ingest(action: Column, size: Column, most: int) -> Column:
    return F.when((action == "ingest") & (size > most), "DENY").otherwise("NEUTRAL")


def enforce_retention(age_days: Column, most: int) -> Column:
    return F.when(age_days > most, "DENY").otherwise("NEUTRAL")


def first_match(rules: list[tuple[str, Column]], default: str) -> Column:
    out = F.lit(default)
    for name, holds in reversed(rules):
        out = F.when(holds, name).otherwise(out)
    return out
