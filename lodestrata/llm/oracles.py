"""DuckDB SQL of the byte windows, the manifest and the conversation repair."""

from __future__ import annotations

# CRC-32 by bits: each byte of an ASCII text is followed by eight steps of -1.
_STEPS = "flatten(list_transform(string_split({s}, ''), lambda ch: [ascii(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
_STEP = "CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END"


def crc32(text: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {_STEPS.format(s=text)}), lambda c, x: {_STEP}), 4294967295)"


# Windows are runs of 400 hex digits.
OP11_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
s AS (SELECT doc_id, i, md5(substr(h, 2 * i - 1, 400)) AS k FROM d, LATERAL (SELECT unnest(range(1, n - 198)) AS i)),
again AS (SELECT k FROM s GROUP BY k HAVING count(*) > 1),
hit AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 200 THEN 0 ELSE 1 END AS fresh FROM s JOIN again USING (k)),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 199 AS b FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM hit) GROUP BY doc_id, g),
pieces AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM spans),
cut AS (SELECT p.doc_id, count(*)::BIGINT AS n_spans, sum(b - a + 1)::BIGINT AS n_removed,
    string_agg(substr(h, 2 * before + 1, 2 * (a - 1 - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept
  FROM pieces p JOIN d USING (doc_id) GROUP BY p.doc_id)
SELECT d.doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""


def manifest_sql(levels: int = 5) -> str:
    """The manifest of up to 16**levels rows a source, and as many sources: a table of nodes and one of their sides a level."""
    field = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    leaf = lambda text: "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    def tree(mark: str) -> str:
        out = []
        for k in range(levels):
            out.append(f"""{mark}{k + 1} AS (SELECT grp, place // 16 AS place, sha256(string_agg(h, '' ORDER BY place)) AS h, (size + 15) // 16 AS size FROM {mark}{k} WHERE size > 1 GROUP BY grp, place // 16, size
    UNION ALL SELECT grp, place, h, size FROM {mark}{k} WHERE size = 1)""")
            run = "OVER (PARTITION BY grp, place // 16 ORDER BY place ROWS BETWEEN"
            out.append(f"""{mark}_sides{k} AS (SELECT grp, place, CASE WHEN size > 1 THEN coalesce(string_agg(h, '') {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') END AS l,
    coalesce(string_agg(h, '') {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {mark}{k})""")
        return ",\n".join(out)

    steps = []
    for k in range(2 * levels):
        sides, grp, place = (f"own_sides{k}", "t.src", f"t.place // {16**k}") if k < levels else (f"top_sides{k - levels}", "''", f"t.sp // {16 ** (k - levels)}")
        steps.append(f"""x{k + 1} AS (SELECT t.doc_id, leaf, subroot, root, CASE WHEN l IS NULL THEN x ELSE sha256(l || x || r) END AS x, CASE WHEN l IS NULL THEN proof ELSE proof || l || r END AS proof, t.src, t.place, t.sp
    FROM x{k} t JOIN {sides} s ON s.grp = {grp} AND s.place = {place})""")
    return f"""
WITH leaves AS (SELECT doc_id, coalesce('=' || source, '') AS src, {leaf("text")} AS h, CASE WHEN {crc32("doc_id::VARCHAR")} % 5 = 0 THEN {leaf(lower)} END AS changed FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY doc_id NULLS FIRST, h) - 1 AS place, count(*) OVER (PARTITION BY src) AS size FROM leaves),
own0 AS (SELECT src AS grp, place, h, size FROM placed),
{tree("own")},
subs AS (SELECT grp AS src, h AS subroot, row_number() OVER (ORDER BY grp) - 1 AS sp, count(*) OVER () AS size FROM own{levels}),
top0 AS (SELECT '' AS grp, sp AS place, subroot AS h, size FROM subs),
{tree("top")},
x0 AS (SELECT p.doc_id, p.h AS leaf, s.subroot, (SELECT h FROM top{levels}) AS root, coalesce(changed, p.h) AS x, '' AS proof, p.src, p.place, s.sp FROM placed p JOIN subs s ON s.src = p.src),
{", ".join(steps)}
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, x AS folded_root, x = root AS verified FROM x{2 * levels}
"""


def repair_sql() -> str:
    """The repair row by row: four cells, each with the least of (cost, edits) and the rows that those edits give."""

    def edit(cell: str, when: str, cost: str, mark: str, row: str | None) -> str:
        rows = f"{cell}.o" if row is None else f"{cell}.o || chr(10) || {row}"
        return f"CASE WHEN {cell} IS NULL{when} THEN NULL ELSE {{'c': {cell}.c + {cost}, 'e': {cell}.e || '{mark}', 'o': {rows}}} END"

    insert = lambda cell, role: edit(cell, "", "3", "I", f"'{role}:'")
    delete = lambda cell: edit(cell, "", "4", "D", None)
    keep = lambda cell, first: edit(cell, f" OR dead OR first <> '{first}'", "more", "K", "role || ':' || text")
    rerole = lambda cell, role: edit(cell, " OR dead", "3 + more", "R", f"'{role}:' || text")
    least = lambda *cells: "list_min([" + ", ".join(cells) + "])"
    none = "NULL::STRUCT(c BIGINT, e VARCHAR, o VARCHAR)"
    after_user = least("s2", *[insert(s, "user") for s in ("s0", "s1", "s3")])
    after_assistant = least("s3", insert("j2", "assistant"))
    user = [f(s, x) for s in ("s0", "s1", "j3") for f, x in ((keep, "u"), (rerole, "user"))]
    white = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    counts = ", ".join(f"coalesce({c}, 0)::BIGINT AS {c}" for c in ("gaps", "blank", "duplicate", "truncated", "illegal"))
    return f"""
WITH RECURSIVE keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS fate FROM conversations),
damaged AS (SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role, CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN fate = 3 THEN [0, 1] ELSE [0] END) AS copy FROM keyed WHERE fate <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(role) || ':' || role || text), copy) AS n, right(rtrim(text, {white}), 1) AS last, left(role, 1) AS first FROM damaged),
judged AS (SELECT *, last = '' AS blank, last <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS duplicate, lag(first) OVER (PARTITION BY conv_id ORDER BY n) || first AS pair FROM placed),
coded AS (SELECT *, blank OR duplicate AS dead, NOT dead AND last NOT IN ('.', '!', '?') AS truncated, CASE WHEN truncated THEN 3 ELSE 0 END::BIGINT AS more FROM judged),
walk AS (SELECT DISTINCT conv_id, 0::BIGINT AS n, {{'c': 0::BIGINT, 'e': '', 'o': ''}} AS s0, {none} AS s1, {none} AS s2, {none} AS s3 FROM coded
  UNION ALL SELECT conv_id, n, {delete("s0")}, {least(delete("s1"), keep("s0", "s"))}, {least(delete("j2"), *user)}, {least(delete("j3"), keep("j2", "a"), rerole("j2", "assistant"))}
    FROM (SELECT *, {after_assistant} AS j3 FROM (SELECT c.conv_id, c.n, c.role, c.text, c.first, c.dead, c.more, s0, s1, s3, {after_user} AS j2 FROM walk w JOIN coded c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.n + 1))),
ends AS (SELECT conv_id, {least("s0", "s3", insert("j2", "assistant"))} AS best FROM (SELECT conv_id, s0, s3, {after_user} AS j2, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC) AS back FROM walk) WHERE back = 1),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
    count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM coded GROUP BY conv_id)
SELECT o.conv_id, {counts}, coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.e, '') AS audit, sha256(coalesce(best.o[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
"""


ORACLES = {"op11_suffix_dedup": OP11_SQL, "op12_merkle_manifest": manifest_sql(), "op13_conversation_repair": repair_sql()}
