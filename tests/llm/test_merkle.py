"""The manifest against a brute-force tree, odd rows and tampered leaves."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from lodestrata.llm import merkle
from lodestrata.llm.queries import op12_merkle_manifest

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, place long, hash string, c0 string, grp string"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return digest(*["-" if row[k] is None else f"{len(str(row[k]).encode())}:{row[k]}" for k in FIELDS])


def ascii_lower(text):
    return text and "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def tree(nodes):
    """The one node left, and each leaf's (left, right) siblings from below to above."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, a in enumerate(at):
            g = a // 16 * 16
            paths[i].append((nodes[g:a], nodes[a + 1 : g + 16]))
            at[i] = a // 16
        nodes = [digest(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
    return (nodes[0] if nodes else None), paths


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for own in by.values():
        own.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)))
    below = {s: tree([leaf_of(r) for r in by[s]]) for s in order}
    root, above = tree([below[s][0] for s in order])
    out = []
    for s, top in zip(order, above, strict=True):
        for r, path in zip(by[s], below[s][1], strict=True):
            changed = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
            own = leaf_of({**r, "text": ascii_lower(r["text"])} if changed else r)
            for left, right in path + top:
                own = digest(*left, own, *right)
            proof = digest(*["".join(left + right) for left, right in path + top])
            out.append((r["doc_id"], leaf_of(r), below[s][0], root, proof, own, own == root))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_whole_query_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = brute([r.asDict() for r in docs.collect()])
    assert rows_of(op12_merkle_manifest(spark, sf_dir)) == want
    assert 0 < sum(not r[-1] for r in want) < len(want) / 2


def test_nulls_repeats_long_texts_and_clashing_names(spark):
    odd = [(None, "AbC", None, None, None)] * 2 + [(3, None, "en", "", 3), (5, "Ünï", None, "ü", None), (5, "X" * 2_000_000, None, "u", 1)]
    odd += [(7, "X Y", "en", "", 3)] * 40 + [(i, f"Text {i}", "de", "hot", i) for i in range(300)] + [(1, "a", "b", f"s{i}", 0) for i in range(20)]
    docs = spark.createDataFrame([(*r, 7, "h", "c", "g") for r in odd], COLUMNS)
    assert rows_of(merkle.manifest(docs)) == brute([r.asDict() for r in docs.collect()])


@pytest.mark.parametrize("count", [0, 1, 16, 17])
def test_small_tables(spark, count):
    docs = spark.createDataFrame([(i, f"T{i}", "en", "s", i) for i in range(count)], COLUMNS.split(", place")[0])
    assert rows_of(merkle.manifest(docs)) == brute([r.asDict() for r in docs.collect()])


def test_any_changed_text_shows(spark):
    docs = spark.createDataFrame([(i, f"t{i}", "en", f"s{i % 3}", i) for i in range(60)], COLUMNS.split(", place")[0])
    found = merkle.manifest(docs, F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).collect()
    assert all(r.verified == (r.doc_id % 7 != 0) for r in found)
