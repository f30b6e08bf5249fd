"""Substring and line removal, similarity joins and token files against brute force."""

import collections
import hashlib
import random
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pytest
from lodestrata.llm import jaccard_join, line_dedup, postings, shared, substring_dedup, token_files
from lodestrata.llm.hashing import inside, text_words, windows
from lodestrata.llm.queries import tokenizer_path

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORDS.findall(text or "")


def test_word_hashes_agree_with_words():
    texts = ["a b  c", "", None, "é\ta b", "a b c d " * 9, "z" * 200 + " z", "C"]
    bounds, hashes = text_words(pa.array(texts))
    flat = [w for t in texts for w in words(t)]
    assert np.diff(bounds).tolist() == [len(words(t)) for t in texts]
    known = {}
    assert all(known.setdefault(w, h) == h for w, h in zip(flat, hashes.tolist(), strict=True))
    assert len(set(known.values())) == len(known)
    assert text_words(pa.array(["A c"]), lower=True)[1][0] == known["a"]
    loose = text_words(pa.array(["A, c!b"]), lower=True, loose=True)[1]
    assert loose.tolist() == [known["a"], known["c"], known["b"]]
    rolled = windows(hashes, 12)
    assert rolled.tolist() == [int(windows(hashes[i : i + 12], 12)[0]) for i in range(hashes.size - 11)]
    assert inside(np.array([0, 3, 3, 5]), 2).tolist() == [True, True, False, True]


def test_postings_round_trip():
    ids = np.array([5, -2, 9], np.int64)
    cell = postings.pack(*postings.pack_places(ids, np.array([0, 0, 2]), np.array([1, 7, 3])), np.array([1, 2, 3], np.uint64))
    doc, place = postings.unpack_places(*postings.unpack(cell)[:3])
    assert doc.tolist() == [5, 5, 9] and place.tolist() == [1, 7, 3]
    assert postings.unpack(cell)[3].tolist() == [1, 2, 3]


def brute_removal(rows, k):
    seen = collections.Counter(tuple(w[i : i + k]) for _, t in rows for w in [words(t)] for i in range(len(w) - k + 1))
    out = {}
    for i, t in rows:
        w = words(t)
        gone = {j for s in range(len(w) - k + 1) if seen[tuple(w[s : s + k])] > 1 for j in range(s, s + k)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("k", [35, 8])
def test_substring_dedup(documents, corpus, k):
    got = substring_dedup.remove_repeats(documents(corpus), window=k).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == brute_removal(corpus, k)


def test_substring_dedup_of_null_and_repeated_ids(documents):
    """Each row loses its own repeated words, whatever its id, also where a null id is the first to repeat in a batch."""
    passage = " ".join(f"p{i}" for i in range(40))
    texts = [passage + " x " + passage, "short", passage + " tail", "a b c " * 30, "only " + passage, None, "z " * 50, "y"]
    ids = [None, 2**60 + 1, 7, 7, 7, None, 2**60 + 1, None]
    got = substring_dedup.remove_repeats(documents(list(zip(ids, texts, strict=True)))).collect()
    want = brute_removal(list(enumerate(texts)), 35)
    order = lambda r: (r[0] is not None, *r[1:], r[0] or 0)
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=order) == sorted(((i, *want[k]) for k, i in enumerate(ids)), key=order)


def test_substring_dedup_empty(documents):
    assert substring_dedup.remove_repeats(documents([])).count() == 0
    assert substring_dedup.remove_repeats(documents([(1, None)])).first().n_words == 0


def brute_components(rows, n, percent):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in rows:
        w = words((t or "").translate(lower))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    root = {i: i for i in sets}
    while True:
        before = dict(root)
        for a in sets:
            for b in sets:
                if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
        if root == before:
            return {i: (len(sets[i]), root[i]) for i in sets}


@pytest.mark.parametrize(("n", "percent", "block"), [(3, 90, 2048), (5, 80, 2048), (1, 60, 4)])
def test_jaccard_components(documents, corpus, monkeypatch, n, percent, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rows = [r for r in corpus if len(r[1] or "") < 3000 or n == 3]
    got = jaccard_join.jaccard_components(documents(rows), n, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, n, percent)


def test_jaccard_components_of_chains_and_large_groups(documents, monkeypatch):
    """Neighbours in a chain link, its ends do not; hot tiles are cut into blocks."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 3)
    base = [f"w{i}" for i in range(40)]
    rows = [(100 + k, " ".join([*(f"c{i}" for i in range(k)), *base[k:]])) for k in range(0, 30, 2)]
    rows += [(k, " ".join(base[:20] + [f"z{k}{i}" for i in range(20)])) for k in range(20)]
    got = jaccard_join.jaccard_components(documents(rows), 1, 90).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, 1, 90)


def test_jaccard_components_of_null_and_repeated_ids(documents):
    """Rows of one id are linked each by its own text; a component is named by the least id in it."""
    text = {k: " ".join(f"{k}{i}" for i in range(60)) for k in "PUV"}
    rows = [(5, text["P"]), (5, text["U"]), (7, text["P"] + " z"), (None, text["U"]), (None, text["V"]), (9, None), (3, text["U"] + " z"), (5, text["P"])]
    got = jaccard_join.jaccard_components(documents(rows), 3, 90).collect()
    want = [(5, 58, 5), (5, 58, 3), (7, 59, 5), (None, 58, 3), (None, 58, None), (9, 0, 9), (3, 59, 3), (5, 58, 5)]
    assert sorted(map(str, ((r.doc_id, r.n_shingles, r.component_id) for r in got))) == sorted(map(str, want))


def test_linked_sets_share_a_first_segment_key():
    """Whatever order of keys is taken, linked sets share one of the first keys of each."""
    rnd = np.random.default_rng(2)
    for percent in (90, 80, 60):
        for n in [1, 2, 3, 5, 8, 9, 10, 12, 17, 30, 80, 300, 1000] * 4:
            a = np.unique(rnd.integers(0, 2**64, n, dtype=np.uint64))
            drop = rnd.integers(0, 1 + a.size * (100 - percent) // 100)
            b = np.unique(np.concatenate([a[drop:], rnd.integers(0, 2**64, rnd.integers(0, 1 + a.size * (100 - percent) // 200), dtype=np.uint64)]))
            both = np.intersect1d(a, b).size
            if 100 * both < percent * (a.size + b.size - both) or both == a.size == b.size:
                continue
            parts = [[], []]
            for key, at, place in jaccard_join.segment_keys([a, b], percent):
                for k in (0, 1):
                    for level in np.unique(place[at == k] & 255):
                        own = np.sort(key[(at == k) & (place & 255 == level)])
                        spare = int(place[(at == k) & (place & 255 == level)][0]) >> 8
                        parts[k].append(set(own[: own.size - spare].tolist()))
            assert set().union(*parts[0]) & set().union(*parts[1]), (percent, n)


def test_jaccard_components_empty(documents):
    assert jaccard_join.jaccard_components(documents([])).count() == 0
    got = jaccard_join.jaccard_components(documents([(1, None), (2, ""), (3, " ")])).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(1, 0, 1), (2, 0, 2), (3, 0, 3)}


def test_bitmap_bound_never_drops_a_link():
    rnd = np.random.default_rng(1)
    for _ in range(200):
        a = np.unique(rnd.integers(0, 2**63, rnd.integers(1, 400)).astype(np.uint64))
        b = np.unique(np.concatenate([a[rnd.random(a.size) < 0.9], rnd.integers(0, 2**63, rnd.integers(0, 60)).astype(np.uint64)]))
        if not b.size:
            continue
        x, y = jaccard_join.bitmap(a, 80), jaccard_join.bitmap(b, 80)
        size = min(len(x), len(y))
        differ = np.bitwise_count(jaccard_join.fold(x, size) ^ jaccard_join.fold(y, size)).sum()
        both = np.intersect1d(a, b).size
        if 100 * both >= 80 * (a.size + b.size - both):
            assert jaccard_join.may_link(np.array(a.size), np.array(b.size), differ, 80)


def test_line_dedup_of_null_and_repeated_ids(documents):
    """Rows of one id are documents of their own; of two equal rows one loses what the other keeps."""
    rows = [(1, "a\nb\nc\nd"), (2, "a\nb\nc\nd"), (2, "k1\nk2\nk3\nk4"), (5, "u\nv\nw"), (5, "u\nv\nw"), (None, "u\nv\nw\nx"), (None, "q\nr\ns")]
    got = sorted(((r.doc_id, r.n_lines, r.n_removed, r.text) for r in line_dedup.remove_lines(documents(rows)).collect()), key=repr)
    want = [(1, 4, 0, "a\nb\nc\nd"), (2, 4, 4, ""), (2, 4, 0, "k1\nk2\nk3\nk4"), (5, 3, 3, ""), (5, 3, 3, ""), (None, 4, 0, "u\nv\nw\nx"), (None, 3, 0, "q\nr\ns")]
    assert got == sorted(want, key=repr)
    twice = sorted((r.n_removed, r.text) for r in line_dedup.remove_lines(documents([(5, "u\nv\nw"), (5, "u\nv\nw")])).collect())
    assert twice == [(0, "u\nv\nw"), (3, "")]


def test_line_dedup(documents):
    rows = [(3, "a\nb\nc\nd"), (1, "x\n a\nb \nc\ny"), (2, None), (4, ""), (5, "a\nb\nc\na\nb\nc"), (6, "\n\n\n\n"), (7, "q\nq\nq\nq\nq"), (8, "b\nc"), (9, "b\nc\nd")]
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in line_dedup.remove_lines(documents(rows)).collect()}
    assert got == {
        1: (5, 0, "x\n a\nb \nc\ny"),
        2: (0, 0, None),
        3: (4, 3, "d"),
        4: (1, 0, ""),
        5: (6, 6, ""),
        6: (5, 0, "\n\n\n\n"),
        7: (5, 4, "q"),
        8: (2, 0, "b\nc"),
        9: (3, 3, ""),
    }
    assert line_dedup.remove_lines(documents([])).count() == 0


def test_token_files(spark, documents):
    from tokenizers import Tokenizer

    texts = ["Hello, World! it's 12 o'clock", None, "", "naïve Ünïcode ﬁ ½ İstanbuĺ ​ x", "<|endoftext|> a<|startoftext|>b", "word " * 3000, "tab\tnew\nline\x0bvt\x1cfs", "日本語 テスト", "á é"]
    rows = [(i * 7 % 10, t) for i, t in enumerate(texts)] + [(None, "null id")]
    folder, manifest = token_files.write_tokens(documents(rows), tokenizer_path())
    got = token_files.read_tokens(folder, manifest).collect()
    tokenizer, start, want = Tokenizer.from_file(tokenizer_path()), 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        want.append((i, start, len(ids), zlib.crc32(array("I", ids).tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    pick = rows[3][0]
    one = token_files.fetch(folder, manifest, [pick]).collect()
    assert [(r.doc_id, r.ids) for r in one] == [(pick, tokenizer.encode(rows[3][1], add_special_tokens=False).ids + [1])]
    folder, manifest = token_files.write_tokens(documents([]), tokenizer_path())
    assert token_files.read_tokens(folder, manifest).count() == 0


def test_token_frames_are_checked(tmp_path):
    import io

    import pyarrow.fs as pafs

    out = io.BytesIO()
    writer = token_files.ShardWriter(out, 2)
    ids = array("I", range(1000)).tobytes()
    for i in range(400):
        writer.add(i, ids)
    writer.close()
    raw = bytearray(out.getvalue())
    path = tmp_path / "shard"
    path.write_bytes(raw)
    reader = token_files.ShardReader(pafs.LocalFileSystem().open_input_file(str(path)))
    assert len(reader.sizes) > 3
    assert [(i, s, x.size) for i, s, x in reader.documents([399])] == [(399, 399_000, 1000)]
    raw[40] ^= 1
    path.write_bytes(raw)
    reader = token_files.ShardReader(pafs.LocalFileSystem().open_input_file(str(path)))
    assert [i for i, _, _ in reader.documents([399])] == [399]
    with pytest.raises(Exception, match="checksum|corrupt|decompress|Data"):
        list(reader.documents([0]))


def _family(count, words=200, differ=6):
    """Texts that differ from a template in some words each: near each other, and none links at 90%."""
    rnd = random.Random(9)
    template = [f"t{i}" for i in range(words)]
    out = []
    for i in range(count):
        own = list(template)
        for at in rnd.sample(range(words), differ):
            own[at] = f"x{i}_{at}"
        out.append((i, " ".join(own)))
    return out


def test_near_texts_that_do_not_link_write_rows_by_members(spark, documents, monkeypatch):
    written = []

    def counted(count):
        written.append(0)

        def settle(df, label):
            found = shared.settle(df, label)
            written[-1] += found.count() if label in ("pairs", "links", "asked") else 0
            return found

        monkeypatch.setattr(jaccard_join, "settle", settle)
        rows = _family(count) + [(count + i, t) for i, t in _family(20, differ=1)]
        return {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(documents(rows), words=1, percent=90).collect()}

    for count in (200, 800):
        found = counted(count)
        texts = [set(t.split()) for _, t in _family(count) + [(0, t) for _, t in _family(20, differ=1)]]
        up = list(range(len(texts)))
        for i, a in enumerate(texts):
            for j in range(i):
                if 10 * len(a & texts[j]) >= 9 * len(a | texts[j]):
                    one, other = sorted((up[i], up[j]))
                    up = [one if u == other else u for u in up]
        assert [found[i] for i in range(len(texts))] == up
    assert written[1] < 6 * written[0]
