"""Conversation repair against brute force, long conversations, ties and hash collisions."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from lodestrata.llm import conversation_repair as cr
from lodestrata.llm.queries import op13_conversation_repair

GOAL = re.compile(r"(s?(ua)+)?")
WHITE = " \t\n\x0b\x0c\r"


def damaged(rows):
    out = []
    for conv_id, turn, role, text in rows:
        fate = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fate == 0:
            continue
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(fate, text)
        out += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    return out


def cheapest(rows):
    """Every cost and audit, kept in plain strings by (rows used, roles so far)."""
    start = {"": (0, "", ())}
    for role, text, dead, cut in rows:
        start = step(inserted(start), role, text, dead, cut)
    ends = [v for k, v in inserted(start).items() if GOAL.fullmatch(k)]
    return min(ends)


def offer(into, roles, new):
    """Keeps the least of what leads to roles that can go on alike."""
    for alike, rest in (("", ""), ("s", "ua"), ("u", "a"), ("ua", "")):
        if bool(roles) == bool(alike) and (roles == "s") == (alike == "s") and GOAL.fullmatch(roles + rest):
            into[alike] = min(new, into.get(alike, new))


def inserted(cells):
    for _ in range(3):
        more = dict(cells)
        for roles, (cost, edits, rows) in cells.items():
            for r in ("user", "assistant"):
                offer(more, roles + r[0], (cost + 3, edits + "I", (*rows, (r, ""))))
        cells = more
    return cells


def step(cells, role, text, dead, cut):
    out = {}
    for roles, (cost, edits, rows) in cells.items():
        offer(out, roles, (cost + 4, edits + "D", rows))
        if not dead:
            offer(out, roles + (role[:1] or "x"), (cost + 3 * cut, edits + "K", (*rows, (role, text))))
            for r in ("user", "assistant"):
                offer(out, roles + r[0], (cost + 3 + 3 * cut, edits + "R", (*rows, (r, text))))
    return out


def brute(rows):
    out = []
    for conv_id in {r[0] for r in rows}:
        own = damaged([r for r in rows if r[0] == conv_id])
        tie = lambda r: hashlib.md5(f"{len(r[1].encode())}:{r[1]}{r[2]}".encode()).digest()
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, tie(r)))
        seen, plain, n = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in own:
            bare = text.strip(WHITE)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                n[fault] += 1
            plain.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        turns = {r[0] for r in own} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        cost, edits, kept = cheapest(plain)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        out.append((conv_id, gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, edits, digest))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_whole_query_equals_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(op13_conversation_repair(spark, sf_dir)) == brute(rows)


def test_odd_rows(spark):
    rnd = random.Random(3)
    role = lambda: rnd.choice(["user", "assistant", "system", "tool", "", None, "user", "assistant"])
    text = lambda: rnd.choice(["Yes.", "no", "", " \n", None, "So? ", "Why? \n", "é!", "x" * 50_000])
    rows = [(rnd.choice([None, *range(60)]), rnd.choice([None, *range(9)]), role(), text()) for _ in range(500)]
    rows += rows[:40] + [(100, i, ("user", "assistant")[i % 2] if i % 7 else "system", f"turn {i}.") for i in range(2500)]
    rows += [(101, 0, "user", "Gone.")] * 30
    turns = spark.createDataFrame([(*r, 1, "a") for r in rows], "conv_id long, turn long, role string, text string, kind int, tie string")
    assert rows_of(cr.repair_damaged(turns)) == brute(rows)
    assert cr.repair_damaged(turns.limit(0)).count() == 0


def test_conversations_with_nothing_left(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    turns = spark.createDataFrame([(gone, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    assert rows_of(cr.repair_damaged(turns)) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_repaired_rows_are_given_too(spark):
    turns = spark.createDataFrame([(1, 0, "assistant", "A."), (1, 1, "user", "B."), (1, 2, "user", " ")], "conv_id long, turn long, role string, text string")
    found = cr.audits(turns)
    assert [tuple(r)[-2:] for r in found.collect()] == [(10, "IKKDI")]
    assert [tuple(r) for r in cr.repair(turns, found).orderBy("turn").collect()] == [(1, 0, "user", ""), (1, 1, "assistant", "A."), (1, 2, "user", "B."), (1, 3, "assistant", "")]


@pytest.mark.parametrize("prime", [cr.PRIME, 7, 1])
def test_ties_with_colliding_hashes_and_trimmed_prefixes(monkeypatch, prime):
    monkeypatch.setattr(cr, "PRIME", prime)
    monkeypatch.setattr(cr, "TRIM", 5)
    rnd = random.Random(prime)
    for _ in range(150):
        codes = "".join(rnd.choice("suaxSUAX-") for _ in range(rnd.randint(0, 40)))
        names = {"s": "system", "u": "user", "a": "assistant", "x": "x", "-": "x"}
        rows = [(names[c.lower()], "t", c == "-", c.isupper()) for c in codes]
        assert cr.audit(codes) == cheapest(rows)[:2]
