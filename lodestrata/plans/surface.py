"""What callers ask for, as queries: overviews, summaries, neighbours, provenance, rates, checks of requests, logs and payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contract import query
from ..functions import paths, scoring, text
from ..operators import build, graph, overview, search
from ..shared import new_path, settle
from ..sources import audit, store
from ..tables import code_units, edge_parts, edges, load, nodes, units, usage
from ..tools import MOST, request_faults
from .build import SUMMED
from .retrieval import KEYWORD, TEXT
from .views import sql

# Every fourth file is a document; the language goes by the file.
LANG = "CASE WHEN doc_id // 12 % 4 = 2 THEN 'markdown' ELSE 'python' END"
SHOWN = f"""seen AS (SELECT * REPLACE (CASE WHEN k % 4 = 2 THEN replace(file_path, '.py', '.MD') ELSE file_path END AS file_path), {LANG} AS language FROM code)"""


def _shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.expr("doc_id div 12 % 4 = 2")
    path = F.when(doc, F.replace("file_path", F.lit(".py"), F.lit(".MD"))).otherwise(F.col("file_path"))
    return code_units(spark, sf_dir).withColumns({"file_path": path, "language": F.when(doc, "markdown").otherwise("python")})


SIZES = """sizes AS (SELECT m.repo_id, m.qualified_name AS name, count(*)::BIGINT AS n FROM code m JOIN code c ON c.repo_id = m.repo_id AND (c.qualified_name = m.qualified_name OR starts_with(c.qualified_name, m.qualified_name || '.')) WHERE m.kind = 'module' GROUP BY 1, 2)"""


@query(
    sql(SHOWN + ", " + SIZES + """, ends AS (SELECT src_id AS id FROM built_edges WHERE kind <> 'CONTAINS' UNION ALL SELECT dst_id FROM built_edges WHERE kind <> 'CONTAINS'), deg AS (SELECT repo_id, qualified_name AS name, count(*)::BIGINT AS n FROM ends JOIN code ON unit_id = id GROUP BY repo_id, unit_id, qualified_name),
      tree AS (SELECT repo_id, split_part(qualified_name, '.', 1) AS name, count(*)::BIGINT AS n FROM code GROUP BY 1, 2)
      SELECT repo_id, 'totals' AS section, 1::BIGINT AS place, 'files' AS name, count(DISTINCT file_path)::BIGINT AS n FROM seen GROUP BY 1 UNION ALL SELECT repo_id, 'totals', 2, 'units', count(*) FROM seen GROUP BY 1
      UNION ALL SELECT repo_id, 'language', row_number() OVER (PARTITION BY repo_id ORDER BY language), language, n FROM (SELECT repo_id, language, count(*) AS n FROM seen GROUP BY 1, 2)
      UNION ALL SELECT repo_id, 'kind', row_number() OVER (PARTITION BY repo_id ORDER BY kind), kind, n FROM (SELECT repo_id, kind, count(*) AS n FROM seen GROUP BY 1, 2)
      UNION ALL SELECT repo_id, 'document', row_number() OVER (PARTITION BY repo_id ORDER BY file_path), file_path, n FROM (SELECT repo_id, file_path, count(*) AS n FROM seen WHERE ends_with(lower(file_path), '.md') GROUP BY 1, 2)
      UNION ALL SELECT repo_id, 'tree', row_number() OVER (PARTITION BY repo_id ORDER BY n DESC, name), name, n FROM tree
      UNION ALL SELECT * FROM (SELECT repo_id, 'largest', row_number() OVER (PARTITION BY repo_id ORDER BY n DESC, name) AS place, name, n FROM sizes) WHERE place <= 10
      UNION ALL SELECT * FROM (SELECT repo_id, 'connected', row_number() OVER (PARTITION BY repo_id ORDER BY n DESC, name) AS place, name, n FROM deg) WHERE place <= 10""", "built_edges")
)
def repo_overviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals, languages, kinds, documents, first parts of names, largest and most connected modules of every repository."""
    own = code_units(spark, sf_dir)
    found = build.graph_edges(own).filter("kind <> 'CONTAINS'").select("src_id", "kind", "dst_id").distinct()
    return overview.overview(_shown(spark, sf_dir), found)


@query(sql(SIZES + f", held AS (SELECT repo_id, module, {SUMMED}, max(array_to_string(list_sort(list_distinct(imports)), ',')) FILTER (kind = 'module') AS imp, max(file_path) FILTER (kind = 'module') AS file FROM code JOIN module_of USING (repo_id, unit_id) GROUP BY 1, 2 HAVING count(*) FILTER (kind = 'module') > 0) SELECT h.*, n AS unit_count FROM held h JOIN sizes s ON s.repo_id = h.repo_id AND s.name = h.module", "module_of"))
def module_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A module's summary and how many units its name begins."""
    listed = [F.array_join(c, ",").alias(c) for c in ("cls", "fn", "const", "imp")]
    return overview.module_summary(code_units(spark, sf_dir)).select("repo_id", "module", *listed, "file", "unit_count")


@query(sql("""SELECT DISTINCT e.src_id AS node_id, 'out' AS way, e.dst_id AS neighbour FROM edges e JOIN nodes n ON n.node_id = e.src_id WHERE n.kind <> 'External'
    UNION ALL SELECT DISTINCT e.dst_id, 'in', e.src_id FROM edges e JOIN nodes n ON n.node_id = e.dst_id WHERE n.kind <> 'External'""", "nodes", "edges"))  # fmt: skip
def slice_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The neighbours of each node that is not External, in and out, a row each: a node may have any number."""
    parts = edge_parts(spark, sf_dir)
    return graph.slice_lists(edges(spark, sf_dir, parts), nodes(spark, sf_dir), parts)


@query(sql("""v AS (SELECT unit_id, 1 AS o, NULL AS file_path, NULL AS qualified_name, kind FROM units WHERE doc_id % 3 = 0), g AS (SELECT unit_id, 2, NULL, CASE WHEN doc_id % 4 <> 0 THEN 'g:' || qualified_name END, 'g:' || kind FROM units WHERE doc_id % 2 = 0),
      m AS (SELECT unit_id, 3, 'm:' || file_path, 'm:' || qualified_name, 'm:' || kind FROM units WHERE doc_id % 5 <> 1), a AS (SELECT * FROM v UNION ALL SELECT * FROM g UNION ALL SELECT * FROM m)
      SELECT unit_id, arg_min(file_path, o) FILTER (file_path IS NOT NULL) AS file_path, arg_min(qualified_name, o) FILTER (qualified_name IS NOT NULL) AS qualified_name, arg_min(kind, o) FILTER (kind IS NOT NULL) AS kind FROM a GROUP BY unit_id""", "units"))  # fmt: skip
def fused_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path, name and kind of each fused unit: the first that a channel gives, in the channels' order."""
    u = units(spark, sf_dir)
    none = F.lit(None).cast("string")
    tag = lambda mark, c: F.concat(F.lit(mark), c)
    name = F.when(F.col("doc_id") % 4 != 0, tag("g:", "qualified_name"))
    vector = u.filter("doc_id % 3 = 0").select("unit_id", none.alias("file_path"), none.alias("qualified_name"), "kind")
    near = u.filter("doc_id % 2 = 0").select("unit_id", none.alias("file_path"), name.alias("qualified_name"), tag("g:", "kind").alias("kind"))
    keyword = u.filter("doc_id % 5 <> 1").select("unit_id", *[tag("m:", c).alias(c) for c in ("file_path", "qualified_name", "kind")])
    return search.provenance([vector, near, keyword])


@query(sql("m AS (SELECT event_type, shard, max(at_us) AS now_us FROM usage GROUP BY 1, 2) SELECT event_type, shard, count(*)::BIGINT AS n, round(count(*) / 60.0, 6) AS per_second FROM usage JOIN m USING (event_type, shard) WHERE at_us >= now_us - 60000000 GROUP BY 1, 2", "usage"))
def throughput_last_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the sixty seconds up to each type's and shard's newest, its first instant included, and their rate."""
    e = usage(spark, sf_dir)
    newest = e.groupBy("event_type", "shard").agg(F.max("at_us").alias("now_us"))
    last = e.join(newest, ["event_type", "shard"]).filter(F.col("at_us") >= F.col("now_us") - 60_000_000)
    return last.groupBy("event_type", "shard").agg(F.count("*").alias("n"), F.round(F.count("*") / 60.0, 6).alias("per_second"))


@query(sql("SELECT unit_id, doc_id FROM code WHERE NOT (k % 7 = 4 AND (repo_id = 'en' OR k % 3 = 0))", "code"))
def units_after_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units that stay when files are deleted; a path goes in the repositories that say so only."""
    u = code_units(spark, sf_dir)
    gone = u.filter("doc_id div 12 % 7 = 4 AND (repo_id = 'en' OR doc_id div 12 % 3 = 0)").select("repo_id", "file_path").distinct()
    return store.delete_files(u, gone).select("unit_id", "doc_id")


@query("SELECT event_id, user_id, event_type, props FROM events UNION ALL SELECT event_id + 1000000000, user_id, 'again', NULL FROM events WHERE event_id % 10 = 0")
def audit_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events appended to a log of JSON lines in two writes, and read back."""
    e = load(spark, sf_dir, "events")
    place = new_path(spark, "audit")
    audit.append(e.select("event_id", "user_id", "event_type", "props"), place)
    audit.append(e.filter("event_id % 10 = 0").select(F.col("event_id") + 1_000_000_000, "user_id", F.lit("again").alias("event_type"), F.lit(None).cast("string").alias("props")).toDF("event_id", "user_id", "event_type", "props"), place)
    return audit.replay(spark, place, "event_id long, user_id long, event_type string, props string")


FIELDS = {"a": "CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END", "b": "CASE WHEN doc_id % 4 = 0 THEN '0' ELSE source END", "c": "CASE WHEN doc_id % 5 = 0 THEN NULL ELSE CAST(doc_id % 2 AS VARCHAR) END", "d": "CASE WHEN doc_id % 6 = 1 THEN 'false' ELSE 'true' END"}


def _compacted(zeros: str) -> str:
    parts = ", ".join(f"CASE WHEN v.{k} IS NULL OR v.{k} IN ({zeros}) THEN NULL ELSE '{k}=' || v.{k} END" for k in FIELDS)
    return f"array_to_string(list_filter([{parts}], lambda x: x IS NOT NULL), ',')"


@query("WITH v AS (SELECT doc_id, " + ", ".join(f"{e} AS {k}" for k, e in FIELDS.items()) + " FROM documents) SELECT doc_id, " + _compacted("''") + " AS kept, " + _compacted("'', '0', '0.0', 'false'") + " AS kept_more FROM v")
def compact_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads without their empty values, and without zeros and false too."""
    d = load(spark, sf_dir, "documents")
    pairs = [x for k, e in FIELDS.items() for x in (F.lit(k), F.expr(e.replace("VARCHAR", "STRING")))]
    held = d.select("doc_id", F.create_map(*pairs).alias("payload"))
    line = lambda m: F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda x: F.concat(x["key"], F.lit("="), x["value"]))), ",")
    return held.select("doc_id", line(text.compact(F.col("payload"))).alias("kept"), line(text.compact(F.col("payload"), drop_zero=True)).alias("kept_more"))


@query(sql(f"SELECT unit_id, kind FROM units WHERE ({KEYWORD}) AND kind IN ('class', 'section') ORDER BY updated_s DESC, unit_id LIMIT 40", "units"))
def keyword_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest hits of some kinds."""
    return search.keyword_top_k(units(spark, sf_dir), TEXT, 40, ["class", "section"]).select("unit_id", "kind")


HEADING = "'  Of ' || substr(text, 1, 30) || ' -- ' || (doc_id % 10) || '!'"


@query(f"""WITH h AS (SELECT doc_id, text, CASE WHEN doc_id % 9 = 0 THEN '?!' ELSE {HEADING} END AS title FROM documents), p AS (SELECT *, trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-') AS s FROM h),
    l AS (SELECT *, string_split(text, chr(10)) AS lines FROM p), o AS (SELECT *, list_filter(lines, lambda x: trim(x) <> '') AS solid FROM l)
    SELECT doc_id, CASE WHEN s = '' THEN 'section' ELSE s END AS slug, substr(trim(coalesce(solid[1], '')), 1, 200) AS line, md5(array_to_string(lines[1:3], chr(10))) AS head, len(lines) > 3 AS more FROM o""")  # fmt: skip
def text_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A title as part of a name, a text as one line, and its first lines."""
    d = load(spark, sf_dir, "documents")
    title = F.when(F.col("doc_id") % 9 == 0, "?!").otherwise(F.expr(HEADING))
    head, more = paths.snippet(F.col("text"), 3)
    return d.select("doc_id", paths.slug(title).alias("slug"), F.coalesce(paths.one_line(F.col("text")), F.lit("")).alias("line"), F.md5(head).alias("head"), more.alias("more"))


@query("WITH s AS (SELECT event_id, event_type, (event_id % 83) / 100.0 AS x FROM events) SELECT event_id, CASE WHEN x >= 0.5 THEN 'CRITICAL' WHEN x >= 0.2 THEN 'HIGH' WHEN x >= 0.05 THEN 'MEDIUM' ELSE 'LOW' END AS severity, event_type || ': ' || CASE WHEN x >= 0.5 THEN 'ESCALATE — full re-index recommended' WHEN x >= 0.2 THEN 'trigger Phase-6 refresh for affected entities' WHEN x >= 0.05 THEN 'monitor; schedule a refresh on next idle cycle' ELSE 'within tolerance — no action' END AS action FROM s")
def drift_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drift by severity and what it calls for."""
    e = load(spark, sf_dir, "events").select("event_id", "event_type", (F.col("event_id") % 83 / 100.0).alias("x"))
    severity = scoring.severity(F.col("x"))
    return e.select("event_id", severity.alias("severity"), scoring.action(severity, F.col("event_type")).alias("action"))


@query(
    """WITH c AS (SELECT conv_id, turn, role, text, turn % 4 = 3 AS lost FROM conversations), s AS (SELECT conv_id, turn, '{"data":' || to_json(role || ':' || left(text, 20)) || ',"ts":' || turn || '}' AS entry FROM c WHERE NOT lost),
      e AS (SELECT conv_id, count(*)::BIGINT AS entries, md5(string_agg(entry, chr(10) ORDER BY turn)) AS memory, (max(turn) + 3600)::BIGINT AS expires FROM s GROUP BY 1) SELECT * FROM e"""
)
def session_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session memory after its turns were appended in two batches, the second of which came twice: entries in order, and when the last one lets it expire."""
    from ..sources.memory import SessionMemory

    c = load(spark, sf_dir, "conversations").filter("turn % 4 <> 3")
    said = F.concat("role", F.lit(":"), F.substring("text", 1, 20))
    entries = c.select(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("at"), said.alias("data"))
    held = SessionMemory(spark, new_path(spark, "memory"), ttl_s=3600)
    late = settle(entries.filter("at >= 2"), "late")
    for number, batch in ((0, entries.filter("at < 2")), (1, late), (1, late)):
        held.append(batch, number)
    return held.sessions().select(F.col("session_id").cast("long").alias("conv_id"), "entries", F.md5("memory").alias("memory"), "expires")


REQUESTS = "SELECT event_id, event_id % 230 AS top_k, event_id % 7 AS depth, event_id % 120 - 5 AS row_limit, CASE WHEN event_id % 11 = 0 THEN '' ELSE event_type END AS question FROM events"


@query(f"""WITH r AS ({REQUESTS}) SELECT event_id, concat_ws(',', CASE WHEN row_limit NOT BETWEEN 1 AND {MOST["limit"]} THEN 'limit' END, CASE WHEN depth NOT BETWEEN 1 AND {MOST["depth"]} THEN 'depth' END, CASE WHEN question = '' THEN 'question' END, CASE WHEN top_k NOT BETWEEN 1 AND {MOST["top_k"]} THEN 'top_k' END) AS faults FROM r""")
def request_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests (here by events) and the fields that are out of their ranges."""
    r = load(spark, sf_dir, "events").selectExpr("event_id", "event_id % 230 AS top_k", "event_id % 7 AS depth", "event_id % 120 - 5 AS limit", "CASE WHEN event_id % 11 = 0 THEN '' ELSE event_type END AS question")
    return r.select("event_id", request_faults(["limit", "depth", "question", "top_k"]).alias("faults"))


@query("SELECT label, count(*)::BIGINT AS n_points, CASE WHEN label % 3 = 0 THEN 'created' WHEN label % 3 = 1 THEN 'kept' ELSE 'recreated' END AS state, CASE WHEN label % 3 = 1 THEN count(*) ELSE 0 END::BIGINT AS n_left FROM embeddings GROUP BY label")
def collections_ensured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collections of vectors (here by label) as a write finds them: missing ones are made, those of another length made anew and empty."""
    v = load(spark, sf_dir, "embeddings").select(F.col("label").alias("collection"), F.size("embedding").alias("dim"))
    found = v.groupBy("collection", "dim").agg(F.count("*").alias("n_points"))
    there = found.filter("collection % 3 <> 0").select("collection", F.when(F.col("collection") % 3 == 1, F.col("dim")).otherwise(F.col("dim") * 2).alias("dim"), "n_points")
    ensured = store.ensure_collections(there, found.select("collection", "dim"))
    return ensured.join(found.select("collection", F.col("n_points").alias("n_all")), "collection").select(F.col("collection").alias("label"), F.col("n_all").alias("n_points"), "state", "n_left")


@query("""SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE '{"a":{"b":"' || event_type || '","y":' || user_id || '},"l":[' || event_id || ',"é"],"z":' || CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'null' END || '}' END AS payload FROM events""")
def sorted_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested payloads with sorted keys and no spaces; what is no JSON has none."""
    whole = F.format_string('{"z": %s, "l" : [%d, "\\u00e9"],\n "a": {"y": %d, "b":"%s"}}', F.when(F.col("event_id") % 2 == 0, "true").otherwise("null"), "event_id", "user_id", "event_type")
    payload = F.when(F.col("event_id") % 7 == 0, F.substring(whole, 1, 20)).otherwise(whole)
    return load(spark, sf_dir, "events").select("event_id", text.sorted_json(payload).alias("payload"))


NEAR = "near AS (SELECT dst_id AS node FROM edges WHERE kind = 'DEFINES' AND src_id = 'nation:3' UNION SELECT src_id FROM edges WHERE kind = 'DEFINES' AND dst_id = 'nation:3')"


@query(sql(NEAR + ", far AS (SELECT dst_id AS node FROM edges JOIN near ON src_id = near.node WHERE kind = 'DEFINES' UNION SELECT src_id FROM edges JOIN near ON dst_id = near.node WHERE kind = 'DEFINES') SELECT node AS node_id, min(depth)::BIGINT AS depth FROM (SELECT node, 1 AS depth FROM near UNION ALL SELECT node, 2 FROM far) WHERE node <> 'nation:3' GROUP BY 1", "edges"))
def neighbors_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes within two steps along edges of one kind."""
    start = spark.createDataFrame([("nation:3",)], "node_id string")
    return graph.neighbours(edges(spark, sf_dir), start, 2, ["DEFINES"])
