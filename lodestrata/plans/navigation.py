"""Parents, roots, suggestions, snapshots and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contract import query
from ..functions import text
from ..functions.paths import normal_url
from ..operators import navigation
from ..sources import store
from ..tables import load, nodes, units, usage
from .views import sql

#: Addresses as they are pushed: plain, as user@host:path, with doubled slashes and .git, with a user and a port's colon.
RAW_URL = "CASE page_id % 4 WHEN 1 THEN regexp_replace(regexp_replace(url, '^https?://', 'git@'), '/', ':') WHEN 2 THEN replace(upper(url), '/', '//') || '.git/' WHEN 3 THEN regexp_replace(url, '^https?://', 'ssh://me:pw@') ELSE url END"


def raw_url() -> Column:
    bare = F.regexp_replace("url", "^https?://", "git@")
    kind = F.col("page_id") % 4
    forms = F.when(kind == 1, F.regexp_replace(bare, "^([^/]*)/", "$1:")).when(kind == 2, F.concat(F.replace(F.upper("url"), F.lit("/"), F.lit("//")), F.lit(".git/")))
    return forms.when(kind == 3, F.regexp_replace("url", "^https?://", "ssh://me:pw@")).otherwise(F.col("url"))


def normal_url_sql(url: str) -> str:
    bare = f"regexp_replace(regexp_replace(lower(trim({url})), '^(https?|ssh)://', ''), '^[^@/]+@', '')"
    return f"regexp_replace(regexp_replace(regexp_replace(replace({bare}, ':', '/'), '/+', '/', 'g'), '/+$', ''), '\\.git$', '')"


@query(
    sql("""u AS (SELECT node_id AS unit_id, kind, qualified_name, CASE WHEN contains(qualified_name, '.') THEN regexp_replace(qualified_name, '\\.[^.]*$', '') END AS parent FROM nodes),
      c AS (SELECT unit_id, 1 AS hop, parent AS name FROM u WHERE parent IS NOT NULL UNION ALL SELECT c.unit_id, hop + 1, p.parent FROM c JOIN u p ON p.qualified_name = c.name WHERE hop < 5 AND p.parent IS NOT NULL)
      SELECT c.unit_id, hop::BIGINT AS hop, name, coalesce(p.kind, 'unknown') AS kind FROM c LEFT JOIN u p ON p.qualified_name = name""", "nodes", recursive=True)
)
def parent_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    parent = F.when(F.col("qualified_name").contains("."), F.regexp_replace("qualified_name", r"\.[^.]*$", ""))
    u = nodes(spark, sf_dir).select(F.col("node_id").alias("unit_id"), "kind", "qualified_name", parent.alias("parent_qualified_name"))
    # Only names that are someone's parent can be met; suppliers and customers are leaves.
    return navigation.parent_chain(u, u.filter("kind in ('File', 'Module')"))


@query(sql("SELECT DISTINCT file_path AS path, arg_max(repo, length(root)) AS repo_id FROM units, (VALUES ('en', 1), ('fr', 2), ('en/1.md', 3)) v(root, repo) WHERE file_path = root OR starts_with(file_path, root || '/') GROUP BY file_path", "units"))
def path_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest root above each changed path."""
    roots = spark.createDataFrame([("en", 1), ("fr", 2), ("en/1.md", 3)], "root string, repo_id int")
    return navigation.longest_root(units(spark, sf_dir).select(F.col("file_path").alias("path")).distinct(), roots)


@query(
    sql("""a AS (SELECT * FROM (VALUES ('EN.d1'), ('x.d7'), ('none'), ('.')) v(asked)), w AS (SELECT asked, qualified_name FROM a JOIN units ON contains(lower(qualified_name), lower(asked)) WHERE asked <> '.'),
      p AS (SELECT * FROM w UNION ALL SELECT asked, qualified_name FROM a JOIN units ON contains(lower(qualified_name), lower(split_part(asked, '.', -1))) WHERE asked NOT IN (SELECT asked FROM w) AND split_part(asked, '.', -1) <> ''),
      r AS (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY length(qualified_name), qualified_name) AS n FROM p) SELECT asked, qualified_name FROM r WHERE n <= 5""", "units")
)
def name_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return navigation.suggestions(units(spark, sf_dir), ["EN.d1", "x.d7", "none", "."])


@query(sql("r AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS n FROM usage) SELECT user_id, event_id, value FROM r WHERE n = 1", "usage"))
def best_per_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicates by id: the highest score stays, the first of equals."""
    return navigation.best_by_id(usage(spark, sf_dir).select("user_id", "event_id", "value"), "user_id", "value", "event_id")


@query(
    f"""WITH p AS (SELECT DISTINCT {RAW_URL} AS url FROM pages), n AS (SELECT url, {normal_url_sql("url")} AS w FROM p),
      r AS (SELECT page_id, split_part({normal_url_sql("url")}, '/', 1) AS k FROM pages WHERE page_id % 3 = 0 UNION ALL SELECT page_id, {normal_url_sql("url")} FROM pages WHERE page_id % 3 = 1)
      SELECT url, min(r.page_id) AS repo_id FROM n JOIN r ON w = k OR ends_with(w, '/' || k) OR ends_with(k, '/' || w) GROUP BY url"""
)
def webhook_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pushed addresses, in many forms, against registered ones: whole addresses, and here also bare hosts."""
    pages = load(spark, sf_dir, "pages").select("page_id", "url")
    hosts = pages.filter("page_id % 3 = 0").select(F.col("page_id").alias("repo_id"), F.split_part(normal_url(F.col("url")), F.lit("/"), F.lit(1)).alias("remote_url"))
    whole = pages.filter("page_id % 3 = 1").select(F.col("page_id").alias("repo_id"), F.col("url").alias("remote_url"))
    return navigation.match_urls(pages.select(raw_url().alias("url")).distinct(), hosts.union(whole))


@query(f"SELECT page_id, {normal_url_sql(RAW_URL)} AS url, split_part({normal_url_sql(RAW_URL)}, '/', 1) AS host FROM pages")
def normal_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = normal_url(raw_url())
    return load(spark, sf_dir, "pages").select("page_id", url.alias("url"), F.split_part(url, F.lit("/"), F.lit(1)).alias("host"))


REGISTRY = f"""ops AS (SELECT page_id AS at_t, split_part({normal_url_sql("url")}, '/', 1) AS repo_id, page_id % 5 AS op, url, 'b' || (page_id % 3) AS branch, md5(html) AS sha FROM pages),
  born AS (SELECT repo_id, min(at_t) AS created FROM ops WHERE op IN (0, 1) GROUP BY 1), live AS (SELECT o.*, created FROM ops o JOIN born USING (repo_id) WHERE at_t >= created),
  registry AS (SELECT repo_id, CASE WHEN bool_or(op = 1) THEN 'managed' ELSE 'local' END AS source_type, arg_max(url, at_t) FILTER (op IN (0, 1)) AS repo_path, arg_max(url, at_t) FILTER (op = 1) AS remote_url, arg_max(branch, at_t) FILTER (op = 1) AS branch,
    arg_max(sha, at_t) FILTER (op IN (0, 1, 2)) AS last_commit_sha, max(at_t) FILTER (op IN (0, 1, 2)) AS last_synced_at, max(at_t) FILTER (op = 3) AS last_change_at,
    CASE WHEN arg_max(op, at_t) FILTER (op <> 3) = 4 THEN arg_max(sha, at_t) FILTER (op = 4) END AS last_error, min(created) AS created_at, max(at_t) AS updated_at FROM live GROUP BY repo_id)"""


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state that all writes to the registry (pages in order of id; hosts are repositories) lead to."""
    op = F.element_at(F.array(*map(F.lit, ["local", "managed", "synced", "change", "error"])), (F.col("page_id") % 5 + 1).cast("int"))
    host = F.split_part(normal_url(F.col("url")), F.lit("/"), F.lit(1))
    writes = load(spark, sf_dir, "pages").select(F.col("page_id").alias("at"), host.alias("repo_id"), op.alias("op"), F.col("url").alias("path"), F.col("url"), F.concat(F.lit("b"), (F.col("page_id") % 3).cast("string")).alias("branch"), F.md5("html").alias("sha"), F.md5("html").alias("message"))
    return store.registry_state(writes)


@query("WITH " + REGISTRY + " SELECT * FROM registry")
def registry_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry(spark, sf_dir)


HEADS = "heads AS (SELECT split_part(" + normal_url_sql("url") + ", '/', 1) AS repo_id, arg_max(md5(html), page_id) AS head FROM pages GROUP BY 1)"


@query("WITH " + REGISTRY + ", " + HEADS + " SELECT repo_id, head, last_commit_sha FROM registry JOIN heads USING (repo_id) WHERE source_type = 'managed' AND head IS DISTINCT FROM last_commit_sha")
def poll_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Managed repositories whose remote head (here: their newest page) is not what was ingested last."""
    host = F.split_part(normal_url(F.col("url")), F.lit("/"), F.lit(1))
    heads = load(spark, sf_dir, "pages").groupBy(host.alias("repo_id")).agg(F.max_by(F.md5("html"), "page_id").alias("head"))
    return registry(spark, sf_dir).filter("source_type = 'managed'").join(heads, "repo_id").filter(~F.col("head").eqNullSafe(F.col("last_commit_sha"))).select("repo_id", "head", "last_commit_sha")


@query(
    sql("""s AS (SELECT repo_id, doc_id % 7 = 2 AND repo_id < 'src5' AS altered, kind, file_path, source_sha FROM units),
      a AS (SELECT repo_id, sha256(array_to_string(list_sort(list('{"k":"' || kind || '","p":"' || file_path || '","s":"' || source_sha || '"}')), chr(10))) AS expected FROM s GROUP BY 1),
      b AS (SELECT repo_id, sha256(array_to_string(list_sort(list('{"k":"' || kind || '","p":"' || file_path || '","s":"' || CASE WHEN altered THEN md5(source_sha) ELSE source_sha END || '"}')), chr(10))) AS actual FROM s GROUP BY 1)
      SELECT repo_id, expected, actual, expected = actual AS matches FROM a JOIN b USING (repo_id)""", "units")
)
def snapshot_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each repository's recorded snapshot hash against that of a later state, in which some repositories differ."""
    u = units(spark, sf_dir)
    altered = (F.col("doc_id") % 7 == 2) & (F.col("repo_id") < "src5")
    now = u.withColumn("source_sha", F.when(altered, F.md5("source_sha")).otherwise(F.col("source_sha")))
    rec = text.record(k=F.col("kind"), p=F.col("file_path"), s=F.col("source_sha"))
    hashes = [navigation.sorted_digests(df.select("repo_id", rec.alias("record")), "repo_id", "record").select("repo_id", F.col("snapshot").alias(name)) for df, name in ((u, "expected"), (now, "actual"))]
    return hashes[0].join(hashes[1], "repo_id").withColumn("matches", F.col("expected") == F.col("actual"))


@query(sql("""SELECT repo_id, sha256(array_to_string(list_sort(list('{"k":"' || kind || '","p":"' || file_path || '","s":"' || source_sha || '"}')), chr(10))) AS snapshot, count(*)::BIGINT AS n FROM units GROUP BY repo_id""", "units"))
def snapshot_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A repository's content hash over its sorted records; two states are equal if their hashes are."""
    rec = text.record(k=F.col("kind"), p=F.col("file_path"), s=F.col("source_sha"))
    return navigation.sorted_digests(units(spark, sf_dir).select("repo_id", rec.alias("record")), "repo_id", "record")


@query(
    sql("""c AS (SELECT shard, event_type, CASE WHEN avg(value) > 60 THEN 'failed' WHEN avg(value) > 49 THEN 'degraded' ELSE 'ok' END AS state FROM usage GROUP BY 1, 2)
      SELECT shard, bool_or(state = 'failed' AND event_type = 'error') AS blocked, count(*) FILTER (state = 'failed') > 0 OR count(*) FILTER (state = 'degraded') > 1 AS safe_mode FROM c GROUP BY shard""", "usage")
)
def boot_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A required check that fails blocks the start; a failed one or two degraded ones start in safe mode."""
    mean = F.avg("value")
    checks = usage(spark, sf_dir).groupBy("shard", "event_type").agg(F.when(mean > 60, "failed").when(mean > 49, "degraded").otherwise("ok").alias("state"))
    blocked = F.bool_or((F.col("state") == "failed") & (F.col("event_type") == "error"))
    safe = (F.count_if(F.col("state") == "failed") > 0) | (F.count_if(F.col("state") == "degraded") > 1)
    return checks.groupBy("shard").agg(blocked.alias("blocked"), safe.alias("safe_mode"))


@query("SELECT count(*) FILTER (o_orderstatus = 'O' AND o_orderdate > TIMESTAMP '1996-01-01')::BIGINT AS n_active, count(DISTINCT o_custkey) FILTER (o_orderstatus = 'O' AND o_orderdate > TIMESTAMP '1996-01-01')::BIGINT AS n_users FROM orders")
def active_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows neither revoked (status) nor expired (date), as for sessions, invitations and tokens."""
    active = (F.col("o_orderstatus") == "O") & (F.col("o_orderdate") > F.lit("1996-01-01").cast("timestamp_ntz"))
    return load(spark, sf_dir, "orders").agg(F.count_if(active).alias("n_active"), F.countDistinct(F.when(active, F.col("o_custkey"))).alias("n_users"))


@query(
    """SELECT 'session' AS what, count(*)::BIGINT AS n FROM orders WHERE o_orderstatus <> 'F' AND o_orderdate > TIMESTAMP '1996-01-01' UNION ALL SELECT 'invitation', count(*) FROM orders WHERE o_orderstatus = 'P' AND o_orderdate > TIMESTAMP '1996-01-01'
      UNION ALL SELECT 'token', count(*) FROM lineitem WHERE l_returnflag <> 'R' UNION ALL SELECT 'provider', count(*) FROM supplier WHERE s_acctbal > 0"""
)
def active_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions neither revoked nor expired, pending invitations, tokens not revoked, providers that are on (here by columns of other tables)."""
    orders = load(spark, sf_dir, "orders")
    fresh = F.col("o_orderdate") > F.lit("1996-01-01").cast("timestamp_ntz")
    kept = [("session", orders.filter((F.col("o_orderstatus") != "F") & fresh)), ("invitation", orders.filter((F.col("o_orderstatus") == "P") & fresh)), ("token", load(spark, sf_dir, "lineitem").filter("l_returnflag <> 'R'")), ("provider", load(spark, sf_dir, "supplier").filter("s_acctbal > 0"))]
    out = None
    for what, df in kept:
        row = df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
        out = row if out is None else out.union(row)
    return out


@query("SELECT event_id, CASE WHEN length(props) <= 40 THEN props ELSE substr(props, 1, 40) END AS head, length(props)::BIGINT AS n FROM events")
def payload_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads cut to ten tokens."""
    return load(spark, sf_dir, "events").select("event_id", text.cut_at_line(F.col("props"), 10).alias("head"), F.length("props").cast("long").alias("n"))


@query()
def canonical_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads with sorted keys, and their digests."""
    e = load(spark, sf_dir, "events").select("event_id", text.canonical_json(F.col("props")).alias("payload"))
    return e.withColumn("digest", F.sha2("payload", 256))


@query(sql("SELECT md5('repo=' || repo_id || '|q=' || language || '|k=10|kinds=class,module|seeds=|v=1') AS probe, repo_id, language, sha256('repo=' || repo_id || '|q=' || language || '|k=10|kinds=class,module|seeds=|v=1') AS cache_key FROM (SELECT DISTINCT repo_id, language FROM units)", "units"))
def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal requests share a key, whatever the order of their lists."""
    from ..functions.identity import cache_key

    u = units(spark, sf_dir).select("repo_id", "language").distinct()
    kinds = F.array(F.lit("module"), F.lit("class"), F.lit("module"))
    key = cache_key(F.col("repo_id"), F.col("language"), F.lit(10), kinds, F.array().cast("array<string>"), F.lit(1))
    plain = F.concat(F.lit("repo="), "repo_id", F.lit("|q="), "language", F.lit("|k=10|kinds=class,module|seeds=|v=1"))
    return u.select(F.md5(plain).alias("probe"), "repo_id", "language", key.alias("cache_key"))
