"""Drift, consistency, checksums, schema versions and access rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..contract import query
from ..functions import scoring
from ..operators import integrity
from ..tables import load, units
from .views import sql


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Vectors before and after a change that depends on the id: every third one's first half turns its sign."""
    v = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    turned = F.transform("vector", lambda x, i: F.when((F.col("id") % 3 == 0) & (i < 4), -x).otherwise(x))
    return v, v.filter("id % 11 <> 0").withColumn("vector", turned)


SHIFTS = """v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS a, list_transform(embedding::DOUBLE[], lambda x, i: CASE WHEN vec_id % 3 = 0 AND i <= 4 THEN -x ELSE x END) AS b FROM embeddings WHERE vec_id % 11 <> 0),
  s AS (SELECT id, round(1 - list_inner_product(a, b) / (sqrt(list_inner_product(a, a)) * sqrt(list_inner_product(b, b))), 6) AS shift FROM v)"""
BAND = "CASE WHEN max(shift) >= 0.5 THEN 'CRITICAL' WHEN max(shift) >= 0.2 THEN 'HIGH' WHEN max(shift) >= 0.05 THEN 'MEDIUM' ELSE 'LOW' END"


@query("WITH " + SHIFTS + f" SELECT count(*)::BIGINT AS n, max(shift) AS max_shift, round(avg(shift), 5) AS mean_shift, {BAND} AS severity FROM s")
def embedding_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifts = integrity.vector_shifts(*_versions(spark, sf_dir))
    return shifts.agg(F.count("*").alias("n"), F.max("shift").alias("max_shift"), F.round(F.avg("shift"), 5).alias("mean_shift"), scoring.severity(F.max("shift")).alias("severity"))


@query("WITH " + SHIFTS + " SELECT id, shift FROM s ORDER BY shift DESC, id LIMIT 10")
def most_drifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.vector_shifts(*_versions(spark, sf_dir)).orderBy(F.desc("shift"), "id").limit(10)


@query(
    sql("""r AS (SELECT repo_id, doc_id, row_number() OVER (PARTITION BY repo_id ORDER BY length(content) DESC, doc_id) AS a, row_number() OVER (PARTITION BY repo_id ORDER BY updated_s DESC, doc_id) AS b FROM units),
      x AS (SELECT repo_id, count(*) FILTER (a <= 20) AS na, count(*) FILTER (a <= 20 AND b <= 20) AS shared, count(*) FILTER (a <= 20 OR b <= 20) AS either, list_sort(coalesce(list(doc_id) FILTER ((a <= 20) <> (b <= 20)), []))[1:10] AS affected FROM r GROUP BY repo_id),
      d AS (SELECT repo_id, round(CASE WHEN na = 0 THEN 0 ELSE 1 - shared / either END, 6) AS distance, affected FROM x)
      SELECT repo_id, distance, array_to_string(affected, ',') AS affected, CASE WHEN 2 * distance >= 0.5 THEN 'CRITICAL' WHEN 2 * distance >= 0.2 THEN 'HIGH' WHEN 2 * distance >= 0.05 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM d""", "units")
)
def ranking_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jaccard distance of two rankings' first 20, by repository."""
    by = Window.partitionBy("repo_id")
    u = units(spark, sf_dir).select("repo_id", "doc_id", F.row_number().over(by.orderBy(F.desc(F.length("content")), "doc_id")).alias("a"), F.row_number().over(by.orderBy(F.desc("updated_s"), "doc_id")).alias("b"))
    return integrity.ranking_drift(u, "repo_id", "doc_id", 20).withColumn("affected", F.array_join(F.col("affected").cast("array<string>"), ","))


@query(
    """WITH e AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p, l_linenumber % 4 AS shard FROM lineitem), c AS (SELECT s, p, count(DISTINCT shard) AS n FROM e GROUP BY 1, 2)
      SELECT count(*)::BIGINT AS n_edges, count(*) FILTER (n < 4)::BIGINT AS n_divergent, round(count(*) FILTER (n < 4) / count(*), 6) AS divergence FROM c"""
)
def shard_edge_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that not all shards hold, of all edges."""
    e = load(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", (F.col("l_linenumber") % 4).alias("shard"))
    return integrity.shard_divergence(e, ["l_suppkey", "l_partkey"], 4)


STORES = "SELECT id, bool_or(s = 0) AS in_a, bool_or(s = 1) AS in_b, bool_or(s = 2) AS in_c FROM (SELECT doc_id AS id, 0 AS s FROM documents UNION ALL SELECT doc_id, 1 FROM labels UNION ALL SELECT vec_id, 2 FROM embeddings) GROUP BY id"


@query(f"WITH s AS ({STORES}) SELECT (in_a::INT || in_b::INT || in_c::INT) AS stores, count(*)::BIGINT AS n, min(id) AS first_id, CASE WHEN in_a::INT + in_b::INT + in_c::INT = 1 THEN 'only' WHEN in_a::INT + in_b::INT + in_c::INT = 3 THEN 'all' ELSE 'unflagged' END AS flag FROM s GROUP BY ALL")
def store_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids by the stores (documents, labels, vectors) that hold them. Ids in exactly two of three stores are flagged nowhere."""
    stores = [load(spark, sf_dir, t).select(F.col(c).alias("id")) for t, c in (("documents", "doc_id"), ("labels", "doc_id"), ("embeddings", "vec_id"))]
    return integrity.store_consistency(stores)


@query(sql("SELECT repo_id, count(*)::BIGINT AS total, count(*) FILTER (sha256(CASE WHEN doc_id % 13 = 5 THEN content || '!' ELSE content END) = source_sha)::BIGINT AS matched, min(doc_id) FILTER (doc_id % 13 = 5) AS first_mismatch FROM units GROUP BY repo_id", "units"))
def checksum_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents (some altered) against their recorded digests."""
    u = units(spark, sf_dir).withColumn("content", F.when(F.col("doc_id") % 13 == 5, F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    good = F.sha2("content", 256) == F.col("source_sha")
    return u.groupBy("repo_id").agg(F.count("*").alias("total"), F.count_if(good).alias("matched"), F.min(F.when(~good, F.col("doc_id"))).alias("first_mismatch"))


@query(sql("SELECT repo_id, count(*)::BIGINT AS n_bad, array_to_string(list_sort(list(DISTINCT (doc_id % 3)::VARCHAR)), ',') AS versions FROM units WHERE doc_id % 3 <> 1 GROUP BY repo_id", "units"))
def schema_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose schema version (here: id modulo 3) is not 1, and those versions."""
    u = units(spark, sf_dir).withColumn("version", (F.col("doc_id") % 3).cast("string")).filter("version <> '1'")
    return u.groupBy("repo_id").agg(F.count("*").alias("n_bad"), F.array_join(F.array_sort(F.collect_set("version")), ",").alias("versions"))


@query(
    sql("""c AS (SELECT unit_id AS id FROM units WHERE sha256(CASE WHEN doc_id % 13 = 5 THEN content || '!' ELSE content END) <> source_sha), v AS (SELECT unit_id AS id FROM units WHERE doc_id % 3 <> 1),
      g AS (SELECT src_id AS id FROM edges WHERE src_id NOT IN (SELECT node_id FROM nodes WHERE kind <> 'External') OR dst_id NOT IN (SELECT node_id FROM nodes WHERE kind <> 'External')),
      i AS (SELECT id FROM c UNION SELECT id FROM v UNION SELECT id FROM g)
      SELECT (SELECT count(*) FROM c)::BIGINT AS n_checksum, (SELECT count(*) FROM v)::BIGINT AS n_schema, (SELECT count(*) FROM g)::BIGINT AS n_graph, (SELECT count(*) FROM i)::BIGINT AS n_entities, (SELECT count(*) = 0 FROM events WHERE event_id % 97 = 5) AS chain_ok""", "units", "nodes", "edges")
)
def corruption_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents that miss their digests, other schema versions, edges to nodes that are not kept, all their entities, and whether the audit chain holds."""
    from ..operators import graph, sequential
    from ..tables import edge_parts, edges, nodes
    from .series import tampered_chain

    u = units(spark, sf_dir)
    altered = F.when(F.col("doc_id") % 13 == 5, F.concat("content", F.lit("!"))).otherwise(F.col("content"))
    bad = u.filter(F.sha2(altered, 256) != F.col("source_sha")).select(F.col("unit_id").alias("id"), F.lit("checksum").alias("check"))
    old = u.filter("doc_id % 3 <> 1").select("unit_id", F.lit("schema"))
    parts = edge_parts(spark, sf_dir)
    loose = graph.validate(edges(spark, sf_dir, parts), nodes(spark, sf_dir).filter("kind <> 'External'"), parts).filter("issue = 'orphan'").select("src_id", F.lit("graph"))
    found = bad.union(old).union(loose)
    counts = found.agg(*[F.count_if(F.col("check") == c).alias(f"n_{c}") for c in ("checksum", "schema", "graph")], F.countDistinct("id").alias("n_entities"))
    chain = sequential.verify_chain(tampered_chain(spark, sf_dir)).agg((F.coalesce(F.sum("n_broken"), F.lit(0)) == 0).alias("chain_ok"))
    return counts.join(F.broadcast(chain))  # a row each


@query(
    sql("""n AS (SELECT unit_id, CASE WHEN doc_id % 4 = 0 THEN sha256(content || 'x') ELSE source_sha END AS sha FROM units WHERE doc_id % 9 <> 3), o AS (SELECT unit_id, source_sha AS sha FROM units WHERE doc_id % 11 <> 4)
      SELECT coalesce(o.unit_id, n.unit_id) AS entity_id, coalesce(o.sha, repeat('0', 64)) AS before_hash, coalesce(n.sha, repeat('0', 64)) AS after_hash, CASE WHEN o.sha IS NULL THEN 'create' WHEN n.sha IS NULL THEN 'delete' ELSE 'update' END AS action
      FROM o FULL JOIN n ON n.unit_id = o.unit_id WHERE o.sha IS DISTINCT FROM n.sha""", "units")
)
def audit_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for each unit that differs between two states, with its digest before and after (zeros where it is not there)."""
    u = units(spark, sf_dir)
    sha = F.when(F.col("doc_id") % 4 == 0, F.sha2(F.concat("content", F.lit("x")), 256)).otherwise(F.col("source_sha"))
    return integrity.audit_records(u.filter("doc_id % 11 <> 4").select("unit_id", F.col("source_sha").alias("sha")), u.filter("doc_id % 9 <> 3").select("unit_id", sha.alias("sha")), "unit_id")


@query("SELECT count(*)::BIGINT AS n_users, count(DISTINCT c_nationkey)::BIGINT AS n_teams FROM customer")
def count_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "customer").agg(F.count("*").alias("n_users"), F.countDistinct("c_nationkey").alias("n_teams"))


USERS = "u AS (SELECT c_custkey AS user_id, c_nationkey AS team, c_mktsegment AS role, n_regionkey AS org FROM customer JOIN nation ON n_nationkey = c_nationkey), repos AS (SELECT DISTINCT repo, repo % 5 AS org FROM (SELECT o_orderkey % 50 AS repo FROM orders UNION ALL SELECT 100 + s_suppkey % 20 FROM supplier))"


def _users(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers as users (a nation is a team, a segment a role, a region an organisation), and the organisations' repositories."""
    places = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").cast("long").alias("org"))
    users = load(spark, sf_dir, "customer").join(places, "c_nationkey").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("team"), F.col("c_mktsegment").alias("role"), "org")
    repos = load(spark, sf_dir, "orders").select((F.col("o_orderkey") % 50).alias("repo")).union(load(spark, sf_dir, "supplier").select(100 + F.col("s_suppkey") % 20)).distinct()
    return users, repos.withColumn("org", F.col("repo") % 5)


@query(
    f"""WITH {USERS}, g AS (SELECT o_custkey AS user_id, o_orderkey % 50 AS repo, CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'P' THEN 2 ELSE 3 END AS lvl FROM orders
        UNION ALL SELECT user_id, 100 + s_suppkey % 20, 1 + s_suppkey % 3 FROM u JOIN supplier ON s_nationkey = team),
      r AS (SELECT user_id, repo, max(lvl) AS lvl FROM g GROUP BY 1, 2)
      SELECT user_id, repo, ['read', 'write', 'admin'][CASE WHEN role = 'MACHINERY' THEN 1 ELSE lvl END] AS access FROM r JOIN u USING (user_id) JOIN repos USING (repo, org) WHERE role <> 'BUILDING'
      UNION ALL SELECT user_id, repo, 'admin' FROM u JOIN repos USING (org) WHERE role = 'BUILDING'"""
)
def access_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grants to users (orders) and to their teams (suppliers): the highest per repository; roles (segments) raise or cap it."""
    users, repos = _users(spark, sf_dir)
    level = F.when(F.col("o_orderstatus") == "O", 1).when(F.col("o_orderstatus") == "P", 2).otherwise(3)
    direct = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), (F.col("o_orderkey") % 50).alias("repo"), level.alias("level"))
    team = load(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("team"), (100 + F.col("s_suppkey") % 20).alias("repo"), (1 + F.col("s_suppkey") % 3).cast("int").alias("level"))
    return integrity.resolve_access(users, repos, direct, team, privileged=["BUILDING"], capped=["MACHINERY"])


ACTIONS = "['retrieve', 'mcp_tool', 'ingest', 'read'][o_orderkey % 4 + 1]"


@query(
    f"""WITH {USERS}, q AS (SELECT o_orderkey, role, org, o_orderkey % 50 % 5 AS repo_org, {ACTIONS} AS action, o_orderstatus = 'P' AS outside, 't' || (o_orderkey % 3) AS tool, o_totalprice AS size, date_diff('day', o_orderdate, TIMESTAMP '1998-08-01') AS age FROM orders JOIN u ON user_id = o_custkey),
      p AS (SELECT *, CASE WHEN action = 'retrieve' AND outside THEN 'deny' ELSE 'neutral' END AS p1,
        CASE WHEN action <> 'mcp_tool' THEN 'neutral' WHEN tool = 't0' OR (role = 'BUILDING' AND tool IN ('t1', 't2')) OR (role = 'MACHINERY' AND tool = 't1') THEN 'allow' ELSE 'deny' END AS p2,
        CASE WHEN action = 'ingest' AND size > 150000 THEN 'deny' ELSE 'neutral' END AS p3, CASE WHEN age > 2000 THEN 'deny' ELSE 'neutral' END AS p4 FROM q),
      d AS (SELECT *, CASE WHEN org <> repo_org THEN 0 WHEN p1 <> 'neutral' THEN 1 WHEN p2 <> 'neutral' THEN 2 WHEN p3 <> 'neutral' THEN 3 WHEN p4 <> 'neutral' THEN 4 ELSE 5 END AS k FROM p)
      SELECT o_orderkey, CASE k WHEN 0 THEN false WHEN 1 THEN false WHEN 2 THEN p2 = 'allow' WHEN 3 THEN false WHEN 4 THEN false ELSE true END AS allowed,
        ['tenant_ownership', 'deny_external_retrieval', 'restrict_mcp_tool_by_role', 'limit_ingestion_size', 'enforce_retention', NULL][k + 1] AS policy,
        CASE WHEN k = 0 THEN 'tenant_ownership=deny' ELSE 'tenant_ownership=allow,deny_external_retrieval=' || p1 || CASE WHEN k > 1 THEN ',restrict_mcp_tool_by_role=' || p2 ELSE '' END
          || CASE WHEN k > 2 THEN ',limit_ingestion_size=' || p3 ELSE '' END || CASE WHEN k > 3 THEN ',enforce_retention=' || p4 ELSE '' END END AS trace FROM d"""
)
def access_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests (orders): the tenant must own the repository, then the first policy that decides; with the way there."""
    users, _ = _users(spark, sf_dir)
    o = load(spark, sf_dir, "orders").join(users.select(F.col("user_id").alias("o_custkey"), "role", "org"), "o_custkey")
    action = F.element_at(F.array(*map(F.lit, ["retrieve", "mcp_tool", "ingest", "read"])), (F.col("o_orderkey") % 4 + 1).cast("int"))
    kind = F.when(F.col("o_orderstatus") == "P", "External").otherwise("Function")
    age = F.datediff(F.lit("1998-08-01").cast("date"), F.col("o_orderdate"))
    policies = [
        (40, "enforce_retention", integrity.enforce_retention(age, 2000)), (10, "deny_external_retrieval", integrity.deny_external_retrieval(action, kind)), (30, "limit_ingestion_size", integrity.limit_ingest(action, F.col("o_totalprice"), 150_000)),
        (20, "restrict_mcp_tool_by_role", integrity.restrict_tool_by_role(action, F.col("role"), F.concat(F.lit("t"), (F.col("o_orderkey") % 3).cast("string")), {"*": ["t0"], "BUILDING": ["t1", "t2"], "MACHINERY": ["t1"]})),
    ]
    decision = integrity.first_decision(policies, before=F.col("org") == F.col("o_orderkey") % 50 % 5)
    return o.select("o_orderkey", decision.alias("d")).select("o_orderkey", "d.*")


@query(
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'DENY:status' WHEN o_totalprice > 300000 THEN 'DENY:size' WHEN o_orderpriority LIKE '1%' THEN 'ALLOW:priority' ELSE 'ALLOW:default' END AS decision FROM orders"""
)
def policy_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first policy that decides, by priority; those that do not apply are passed over."""
    rules = [("DENY:status", F.col("o_orderstatus") == "F"), ("DENY:size", F.col("o_totalprice") > 300000), ("ALLOW:priority", F.col("o_orderpriority").startswith("1"))]
    return load(spark, sf_dir, "orders").select("o_orderkey", integrity.first_match(rules, "ALLOW:default").alias("decision"))


MEMBERS = "m AS (SELECT c_custkey AS user_id, c_nationkey AS team FROM customer UNION SELECT c_custkey, c_custkey * 7 % 25 FROM customer)"


@query(f"WITH {MEMBERS} SELECT user_id, n_nationkey AS team, n_name AS name FROM m JOIN nation ON n_nationkey = team WHERE n_regionkey = 1")
def team_memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The teams of one organisation that each user is in."""
    c = load(spark, sf_dir, "customer")
    members = c.select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").cast("long").alias("n_nationkey")).union(c.select("c_custkey", F.col("c_custkey") * 7 % 25)).distinct()
    teams = load(spark, sf_dir, "nation").filter("n_regionkey = 1").select("n_nationkey", F.col("n_name").alias("name"))
    return members.join(teams, "n_nationkey").select("user_id", F.col("n_nationkey").alias("team"), "name")


@query("SELECT c_nationkey AS team, count(*)::BIGINT AS n_users, count(*) FILTER (c_acctbal > 0)::BIGINT AS n_active FROM customer GROUP BY 1")
def team_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users of each team, and those with a balance."""
    return load(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("team")).agg(F.count("*").alias("n_users"), F.count_if(F.col("c_acctbal") > 0).alias("n_active"))


@query(
    sql("""n AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN sha256(content || 'x') ELSE source_sha END AS sha FROM units WHERE doc_id % 9 <> 3),
      j AS (SELECT CASE WHEN n.doc_id IS NULL THEN 'obsolete' WHEN n.sha <> u.source_sha THEN 'updated' ELSE 'unchanged' END AS state, u.repo_id FROM units u LEFT JOIN n USING (doc_id))
      SELECT repo_id, count(*) FILTER (state = 'obsolete')::BIGINT AS obsolete, count(*) FILTER (state = 'updated')::BIGINT AS updated, count(*) FILTER (state = 'unchanged')::BIGINT AS unchanged FROM j GROUP BY repo_id""", "units")
)
def reconcile_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new state of the units against the old: only rows whose digest changed are written."""
    from ..sources import store

    old = units(spark, sf_dir)
    sha = F.when(F.col("doc_id") % 4 == 0, F.sha2(F.concat("content", F.lit("x")), 256)).otherwise(F.col("source_sha"))
    new = old.filter("doc_id % 9 <> 3").withColumn("source_sha", sha)
    return store.reconcile(old, new, "unit_id", "source_sha").groupBy("repo_id").agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("obsolete", "updated", "unchanged")])
