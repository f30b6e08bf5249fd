"""Suffix-array de-duplication against brute force; induced sorting against plain sorting, in memory and on disk."""

import collections
import hashlib
import random

import numpy as np
import pytest

from lodestrata.llm import induced_sort, suffix_dedup
from lodestrata.llm.queries import op11_suffix_dedup
from lodestrata.llm.shared import shared_dir
from lodestrata.llm.suffix_dedup import remove_repeated_bytes


def brute(rows, length):
    seen = collections.Counter()
    for _, text in rows:
        raw = (text or "").encode()
        seen.update(raw[i : i + length] for i in range(len(raw) - length + 1))
    out = []
    for doc_id, text in rows:
        raw = (text or "").encode()
        gone, until = bytearray(len(raw)), 0
        for i in range(len(raw) - length + 1):
            if seen[raw[i : i + length]] > 1:
                until = max(until, i)
                gone[until : i + length] = b"\1" * (i + length - until)
                until = i + length
        spans = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(raw)))
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out.append((doc_id, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r)[:5] for r in df.collect()), key=str)


def test_whole_query_equals_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(rows, 200)
    assert rows_of(op11_suffix_dedup(spark, sf_dir)) == want
    assert sum(r[2] for r in want) > 0


@pytest.mark.parametrize(("length", "memory", "hot"), [(40, 1 << 26, 4096), (40, 2000, 4096), (90, 1 << 26, 2), (300, 5000, 4096)])
def test_corpus(spark, documents, corpus, length, memory, hot):
    docs = documents(corpus)
    assert rows_of(remove_repeated_bytes(docs, length, memory=memory, hot=hot)) == brute(corpus, length)


def test_spans_and_kept_bytes(spark, documents):
    passage = "".join(random.Random(1).choice("abcdé") for _ in range(300))
    found = {r.doc_id: r for r in remove_repeated_bytes(documents([(1, "x" + passage), (2, passage + "yé")])).collect()}
    size = len(passage.encode())
    assert [(s.start, s.end) for s in found[1].spans] == [(1, size + 1)] and bytes(found[1].kept) == b"x"
    assert [(s.start, s.end) for s in found[2].spans] == [(0, size)] and bytes(found[2].kept).decode() == "yé"


def test_odd_ids_repeats_and_long_texts(spark, documents):
    rnd = random.Random(2)
    text = lambda n: "".join(rnd.choice("abcdefgh\0") for _ in range(n))
    long = text(300_000)
    rows = [(None, long), (None, "a" * 5000), (1, long[1000:3000]), (1, text(500)), (2, None), (3, ""), (4, "ab" * 150), (5, long[:199]), (6, text(250))]
    rows += [(7, rows[8][1])] * 30
    assert rows_of(remove_repeated_bytes(documents(rows))) == brute(rows, 200)
    assert remove_repeated_bytes(documents(rows).limit(0)).count() == 0


@pytest.mark.parametrize("memory", [1 << 30, 64 * 15, 200])
def test_induced_sorting(spark, monkeypatch, memory):
    rnd = random.Random(memory)
    spilled = 0
    for n in range(120):
        monkeypatch.setattr(induced_sort, "RANGES", rnd.choice([4, 256]))
        text = [rnd.randint(1, rnd.choice([1, 2, 3, 200])) for _ in range(rnd.randint(0, 400) if n % 4 == 0 else rnd.randint(0, 60))]
        text = bytes(text + text[: len(text) // 2] * (n % 3 == 0)) + b"\0"
        want = sorted(range(len(text)), key=lambda i: text[i:])
        shared = [0]
        for a, b in zip(want[:-1], want[1:], strict=True):
            k = 0
            while k < 30 and text[a + k] == text[b + k]:
                k += 1
            shared.append(k)
        for kind in (np.uint8, np.uint32):
            spool = induced_sort.Spool(shared_dir(spark), memory)
            pos, lcp = induced_sort.ordered(np.frombuffer(text, np.uint8).astype(kind), max(text), 30, spool)
            spool.close()
            spilled += spool.written
            assert pos.tolist() == want and lcp.tolist() == shared
    assert (spilled > 0) == (memory < 1 << 30)


def test_anchors_are_told_by_content():
    import pyarrow as pa

    rnd = random.Random(4)
    passage = "".join(rnd.choice("abcd") for _ in range(700))
    one, two = (suffix_dedup._Segments(pa.array([before + passage]), 200) for before in ("", "dcba" * 30))
    keys = set(one.key.tolist())
    assert keys - set(two.key.tolist()) == set() and one.size > 3
