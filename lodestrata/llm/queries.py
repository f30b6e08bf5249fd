"""The numbered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, licences, oracles, toxicity
from .conversation_repair import repair_damaged
from .jaccard_join import jaccard_components
from .line_dedup import remove_lines
from .merkle import manifest
from .mixing import mix
from .pseudonyms import pseudonymise
from .shared import table
from .substring_dedup import remove_repeats
from .suffix_dedup import remove_repeated_bytes
from .token_files import read_tokens, write_tokens
from .topk_search import top_k


#: From this score on a document counts as toxic.
TOXIC_FROM = 0.3


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lexicon = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, lexicon)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"), "n_clauses")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.coverage(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), seed=5, threshold=0.8)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), most=3).drop("copies")


#: A demonstration key; a real run passes its own, kept secret.
PSEUDONYM_KEY = b"lodestrata demonstration key"


def op4_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents"), PSEUDONYM_KEY)


def op5_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), k=5, every=50, scale=256)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_lines(table(spark, sf_dir, "documents"), lines=3)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), window=35, texts=False)


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), words=3, percent=90)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, shards = write_tokens(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=1)
    return read_tokens(folder, shards)


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_bytes(table(spark, sf_dir, "documents"), length=200, texts=False)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_damaged(table(spark, sf_dir, "conversations"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity,
        op2_decontamination,
        op3_mixing,
        op4_pseudonyms,
        op5_topk_search,
        op6_line_dedup,
        op7_substring_dedup,
        op8_licences,
        op9_jaccard_join,
        op10_token_files,
        op11_suffix_dedup,
        op12_merkle_manifest,
        op13_conversation_repair,
    )
}

OP3_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT AS h
  FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, ((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::DOUBLE AS w FROM src),
capped AS (SELECT *, (3 * source_size)::DOUBLE AS cap, (3 * source_size)::DOUBLE / w AS reach FROM ranked),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER p, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER p, 0)) AS level
  FROM capped WINDOW p AS (ORDER BY reach, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goal AS (SELECT source, source_size, least(cap, (SELECT max(level) FROM levels WHERE level <= reach) * w)::DOUBLE AS target FROM levels),
plan AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 2) ELSE 0 END::BIGINT AS whole FROM goal),
rest AS (SELECT *, CASE WHEN source_size > 0 THEN target - whole * source_size ELSE 0 END AS rest FROM plan),
cells AS (SELECT source, h, sum(size) AS words FROM sized GROUP BY source, h),
running AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY h) - words AS before FROM cells),
edges AS (
  SELECT r.source, max(h) AS h, arg_max(before, h) AS before, arg_max(words, h) AS words
  FROM running r JOIN rest ON r.source IS NOT DISTINCT FROM rest.source WHERE before <= rest.rest GROUP BY r.source)
SELECT doc_id, size, source_size, target,
       (whole + CASE WHEN s.h < e.h + CASE WHEN 2 * (rest - before) >= words THEN 1 ELSE 0 END THEN 1 ELSE 0 END)::BIGINT * size AS taken
FROM sized s JOIN rest r ON s.source IS NOT DISTINCT FROM r.source JOIN edges e ON s.source IS NOT DISTINCT FROM e.source
"""

OP5_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
           FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

OP6_SQL = r"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS parts, list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))) AS bare FROM documents),
w AS (SELECT doc_id, parts, p.i AS place, bare[p.i + 1] || chr(10) || bare[p.i + 2] || chr(10) || bare[p.i + 3] AS k
      FROM l, LATERAL (SELECT unnest(range(0, greatest(len(bare) - 2, 0))) AS i) p),
o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, place) AS nth FROM w WHERE length(k) > 2),
gone AS (SELECT DISTINCT doc_id, unnest([place, place + 1, place + 2]) AS place FROM o WHERE nth > 1),
cut AS (SELECT doc_id, list(place) AS places, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN 0 ELSE len(l.parts) END::BIGINT AS n_lines, coalesce(cut.n, 0)::BIGINT AS n_removed,
       CASE WHEN cut.n IS NULL THEN d.text ELSE array_to_string(list_filter(l.parts, lambda x, i: NOT list_contains(cut.places, i - 1)), chr(10)) END AS text
FROM documents d JOIN l ON d.doc_id = l.doc_id LEFT JOIN cut ON d.doc_id = cut.doc_id
"""

WORDS = r"'[^\x20\x09-\x0D]+'"

OP7_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {WORDS}) AS w FROM documents),
s AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS k FROM d, LATERAL (SELECT unnest(range(1, len(w) - 33)) AS i)),
again AS (SELECT k FROM s GROUP BY k HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS at FROM s JOIN again USING (k)),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS at FROM d),
left_over AS (SELECT words.doc_id, count(*) FILTER (gone.at IS NOT NULL) AS n_removed, string_agg(word, ' ' ORDER BY words.at) FILTER (gone.at IS NULL) AS kept
  FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.at = words.at GROUP BY words.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN left_over USING (doc_id)
"""

OP9_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {WORDS}) AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s FROM d, LATERAL (SELECT unnest(CASE WHEN len(w) >= 3 THEN range(1, len(w) - 1) WHEN len(w) > 0 THEN [1] ELSE [] END) AS i)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n_both FROM g x JOIN g y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * n_both >= 90 * (x.n + y.n - n_both)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1) c USING (doc_id)
"""

ORACLES: dict[str, str] = {"op7_substring_dedup": OP7_SQL, "op9_jaccard_join": OP9_SQL, "op3_mixing": OP3_SQL, "op5_topk_search": OP5_SQL, "op6_line_dedup": OP6_SQL, "op8_licences": licences.scan_sql(), **oracles.ORACLES}
