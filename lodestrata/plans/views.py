"""The model tables as DuckDB common table expressions, for the oracles."""

from __future__ import annotations



def _leaf(at: str) -> str:
    return f"(CASE WHEN ({at}) % 5 = 0 THEN '_d' ELSE 'd' END || ({at}))"


VIEWS = {
    "code": rf"""SELECT sha256(repo_id || chr(0) || file_path || chr(0) || qualified_name) AS unit_id, * FROM (SELECT *, CASE WHEN p = 0 THEN 'src.f' || k ELSE parent_qualified_name || '.' || name END AS qualified_name FROM (
        SELECT doc_id, doc_id % 12 AS p, doc_id // 12 AS k, lang AS repo_id, 'src/f' || k || '.py' AS file_path, text AS content, sha256(text) AS source_sha, doc_id % 12 * 10 + 1 AS line_start,
          ['module', 'class', 'class', 'function', 'function', 'function', 'method', 'method', 'method', 'constant', 'constant', 'section'][p + 1] AS kind,
          CASE WHEN p = 0 THEN 'f' || k ELSE {_leaf("doc_id")} END AS name,
          CASE WHEN p = 0 THEN NULL WHEN p BETWEEN 6 AND 8 THEN 'src.f' || k || '.' || {_leaf("k * 12 + 1")} WHEN p = 10 THEN 'src.f' || k || '.' || {_leaf("k * 12 + 2")} ELSE 'src.f' || k END AS parent_qualified_name,
          CASE WHEN p IN (0, 11) THEN ['src.f' || (k + 1), 'sys', 'src.f' || k] ELSE [] END AS imports,
          CASE WHEN p BETWEEN 3 AND 8 THEN [{_leaf("k * 12 + 3")}, {_leaf("k * 12 + 9")}, 'src.f' || (k + 1) || '.' || {_leaf("k * 12 + 16")}, 'print'] ELSE [] END AS calls,
          CASE WHEN p IN (1, 2) THEN [{_leaf("k * 12 + 2")}, 'src.f' || (k + 1) || '.' || {_leaf("k * 12 + 13")}, 'object'] ELSE [] END AS bases
        FROM documents))""",
    "built_edges": r"""WITH asked AS (SELECT unit_id, repo_id, 'src.f' || k AS module, 'IMPORTS' AS kind, 'module' AS kinds, unnest(imports) AS ref FROM code WHERE kind IN ('module', 'section')
            UNION ALL SELECT unit_id, repo_id, 'src.f' || k, 'CALLS', 'function,method', unnest(calls) FROM code WHERE kind IN ('function', 'method')
            UNION ALL SELECT unit_id, repo_id, 'src.f' || k, 'INHERITS', 'class', unnest(bases) FROM code WHERE kind = 'class'),
          met AS (SELECT a.*, coalesce(x.unit_id, y.unit_id, 'external:' || ref) AS dst FROM asked a LEFT JOIN code x ON x.repo_id = a.repo_id AND x.qualified_name = ref AND list_contains(string_split(kinds, ','), x.kind)
            LEFT JOIN code y ON a.kind <> 'IMPORTS' AND NOT contains(ref, '.') AND y.repo_id = a.repo_id AND y.qualified_name = module || '.' || ref AND list_contains(string_split(kinds, ','), y.kind))
        SELECT 'file:' || sha256(repo_id || chr(0) || file_path) AS src_id, 'CONTAINS' AS kind, unit_id AS dst_id FROM code WHERE kind <> 'module'
        UNION SELECT m.unit_id, 'DEFINES', c.unit_id FROM code c JOIN code m ON m.repo_id = c.repo_id AND m.file_path = c.file_path AND m.qualified_name = c.parent_qualified_name
        UNION SELECT unit_id, kind, dst FROM met WHERE dst <> unit_id""",
    "built_nodes": r"""SELECT DISTINCT 'file:' || sha256(repo_id || chr(0) || file_path) AS node_id, 'File' AS kind, repo_id, file_path AS qualified_name, split_part(file_path, '/', -1) AS name FROM code
        UNION ALL SELECT unit_id, upper(kind[1]) || kind[2:], repo_id, qualified_name, name FROM code
        UNION ALL SELECT dst_id, 'External', min(c.repo_id), dst_id[10:], split_part(dst_id[10:], '.', -1) FROM built_edges JOIN code c ON c.unit_id = src_id WHERE starts_with(dst_id, 'external:') GROUP BY dst_id""",
    "module_of": r"""WITH RECURSIVE up AS (SELECT repo_id, unit_id, CASE WHEN kind = 'module' THEN qualified_name END AS module, CASE WHEN kind <> 'module' THEN parent_qualified_name END AS up_q, qualified_name AS own FROM code
            UNION ALL SELECT u.repo_id, u.unit_id, CASE WHEN p.unit_id IS NULL OR p.kind = 'module' THEN u.up_q WHEN p.parent_qualified_name IS NULL THEN u.own END, CASE WHEN p.kind <> 'module' THEN p.parent_qualified_name END, u.own
              FROM up u LEFT JOIN code p ON p.repo_id = u.repo_id AND p.qualified_name = u.up_q WHERE u.module IS NULL AND u.up_q IS NOT NULL)
        SELECT repo_id, unit_id, coalesce(module, own) AS module FROM up WHERE module IS NOT NULL OR up_q IS NULL""",
    "units": r"""SELECT sha256(source || chr(0) || lang || '/' || doc_id || '.md' || chr(0) || source || '.' || lang || '.d' || doc_id) AS unit_id,
        doc_id, source AS repo_id, lang || '/' || doc_id || '.md' AS file_path, lang AS language,
        ['module', 'class', 'function', 'method', 'constant', 'section'][doc_id % 6 + 1] AS kind, 'd' || doc_id AS name,
        source || '.' || lang || '.d' || doc_id AS qualified_name, source || '.' || lang AS parent_qualified_name, text AS content,
        trim(string_split_regex(regexp_replace(text, '^\s+', ''), '\n\s*\n')[1]) AS docstring, 'd' || doc_id || '(' || lang || ')' AS signature, sha256(text) AS source_sha,
        1704067200 + doc_id * 60 AS updated_s, doc_id % 97 + 1 AS line_start, doc_id % 97 + 1 + n_chars % 40 AS line_end FROM documents""",
    "nodes": r"""SELECT 'region:' || r_regionkey AS node_id, 'File' AS kind, 'r' || r_regionkey AS repo_id, 'r' || r_regionkey AS qualified_name, 'r' || r_regionkey AS name FROM region
        UNION ALL SELECT 'nation:' || n_nationkey, 'Module', 'r' || n_regionkey, 'r' || n_regionkey || '.n' || n_nationkey, 'n' || n_nationkey FROM nation
        UNION ALL SELECT 'supplier:' || s_suppkey, 'Class', 'r' || n_regionkey, 'r' || n_regionkey || '.n' || n_nationkey || '.s' || s_suppkey, 's' || s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey
        UNION ALL SELECT 'customer:' || c_custkey, 'Function', 'r' || n_regionkey, 'r' || n_regionkey || '.n' || n_nationkey || '.c' || c_custkey, 'c' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey
        UNION ALL SELECT 'part:' || p_partkey, CASE WHEN p_partkey % 37 = 0 THEN 'External' ELSE 'Method' END, 'parts', 'p' || p_partkey, 'p' || p_partkey FROM part""",
    "edges": r"""SELECT 'region:' || n_regionkey AS src_id, 'CONTAINS' AS kind, 'nation:' || n_nationkey AS dst_id FROM nation
        UNION ALL SELECT 'nation:' || s_nationkey, 'DEFINES', 'supplier:' || s_suppkey FROM supplier
        UNION ALL SELECT 'nation:' || c_nationkey, 'DEFINES', 'customer:' || c_custkey FROM customer WHERE c_custkey % 5 <> 0
        UNION ALL SELECT DISTINCT 'supplier:' || l_suppkey, 'DEFINES', 'part:' || l_partkey FROM lineitem
        UNION ALL SELECT DISTINCT 'customer:' || o_custkey, 'CALLS', 'part:' || l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey""",
    "usage": r"""SELECT 'customer:' || user_id AS entity_id, event_id, user_id, event_type, value, ts, epoch_us(ts) AS at_us, user_id % 4 AS shard FROM events""",
    "usage_stats": r"""SELECT entity_id, count(*)::BIGINT AS usage_count, arg_max(at_us, (at_us, event_id)) AS last_us,
        count(*) FILTER (event_type IN ('view', 'click', 'purchase', 'error'))::BIGINT AS attempts, count(*) FILTER (event_type = 'purchase')::BIGINT AS successes FROM usage GROUP BY entity_id""",
    "in_degree": r"""SELECT n.node_id, count(e.dst_id)::BIGINT AS in_degree FROM nodes n LEFT JOIN edges e ON e.dst_id = n.node_id GROUP BY n.node_id""",
    "relevance": r"""SELECT *, round(least(1.0, greatest(0.0, 0.4 * sqrt(least(usage_count, 32) / 32.0) + 0.3 * recency + 0.2 * centrality + 0.1 * success_rate)), 6) AS score FROM (
        SELECT n.node_id AS entity_id, n.kind, n.qualified_name, coalesce(u.usage_count, 0) AS usage_count,
          CASE WHEN last_us IS NULL THEN 0.0 WHEN 1706659200000000 - last_us <= 0 THEN 1.0 ELSE pow(0.5, (1706659200000000 - last_us) / 86400000000.0 / 14.0) END AS recency,
          sqrt(least(i.in_degree, 16) / 16.0) AS centrality, CASE WHEN coalesce(attempts, 0) = 0 THEN 0.0 ELSE successes / attempts END AS success_rate,
          (1706659200000000 - last_us) / 86400000000.0 AS age_days
        FROM nodes n LEFT JOIN usage_stats u ON u.entity_id = n.node_id JOIN in_degree i USING (node_id))""",
}
NEEDS = {"built_edges": ["code"], "built_nodes": ["code", "built_edges"], "module_of": ["code"], "usage_stats": ["usage"], "in_degree": ["nodes", "edges"], "relevance": ["nodes", "edges", "usage", "usage_stats", "in_degree"]}


def sql(body: str, *views: str, recursive: bool = False) -> str:
    """``body`` after the views it names and those they need; a body may go on with ``name AS (...) SELECT``."""
    order: list[str] = []
    for v in views:
        for x in [*NEEDS.get(v, []), v]:
            if x not in order:
                order.append(x)
    head = ", ".join(f"{v} AS ({VIEWS[v]})" for v in order)
    start = "WITH RECURSIVE " if recursive else "WITH "
    body = body.strip()
    return start + head + (" " if body.upper().startswith("SELECT") else ", " if head else "") + body


SIGNED_PREVIOUS = """signed AS (SELECT node_id, sha256(coalesce(array_to_string(list_sort(list(dst_id) FILTER (dst_id IS NOT NULL)), ','), '')) AS signature FROM nodes LEFT JOIN edges ON src_id = node_id GROUP BY node_id),
  previous AS (SELECT node_id, sha256(coalesce(array_to_string(list_sort(list(dst_id) FILTER (dst_id IS NOT NULL)), ','), '')) AS signature FROM nodes LEFT JOIN (SELECT * FROM edges WHERE kind <> 'CALLS') ON src_id = node_id GROUP BY node_id)"""
