"""Repair of conversations by the cheapest audit of edits.

The rows of a conversation, by turn, are edited until their role initials read ``(s?(ua)+)?``: Keep costs
nothing, Rerole (to user or assistant) and Insert (of an empty row) cost 3, Delete costs 4 and is the only edit
of a blank or a repeated row; a truncated row that stays costs 3 more. Of the cheapest sequences of edits the
one whose initials are least in ASCII is taken; its initials are the audit.

The audit is found by a persistent dynamic program: a cell for each row and each of four states (nothing yet,
after s, after u, after a) holds its cost and the last node of its edits, and cells share the nodes of the
edits they have in common. A node knows its depth, the rolling hash of the edits down to it, and its ancestors
at distances of powers of two. Two sequences of one cost are compared where they part: binary lifting finds the
longest prefix of equal hashes, which is then verified, and the next edits decide. Neither can be a prefix of
the other, as the edits name the rows that they use up and what they cost. Every ``TRIM`` rows what all cells share is put out as text, so
that what is held is the part in which they still differ.

Only codes of rows (role, fault) go through that program, streamed in order of turn; texts are shuffled once,
each conversation's rows behind its audit, and hashed as they pass. Whether a row repeats an earlier one is a
grouped minimum joined back, so the rows of a large conversation are dealt out for it.

Defined results: null ids make one conversation; a null role or text is one space; null turns come first; rows
of one turn stand in order of the digests of role and text; of equal rows the first is no repeat; no rows have
an empty audit; an empty table gives no rows; further columns take no part.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import partitions, settle

DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
TRIM, CACHED_ROWS = 1024, 24
PRIME, BASE = (1 << 61) - 1, 0x1F3D5B79A2C4E687
WHITE = " \t\n\x0b\x0c\r"
ROLES = {"u": "user", "a": "assistant"}
AUDITS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
#: The state after a row of this role, by the state before; other rows fit nowhere.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
WANTED = {0: "u", 1: "u", 2: "a", 3: "u"}


class Node:
    """The last of a sequence of edits; ``up[k]`` is the node 2**k edits before."""

    __slots__ = ("char", "depth", "hash", "up")

    def __init__(self, parent: Node | None, char: str = ""):
        self.char, self.depth, self.hash = char, 0, 0
        self.up: list[Node] = []
        if parent is not None:
            self.depth, self.hash = parent.depth + 1, (parent.hash * BASE + ord(char)) % PRIME
            step, k = parent, 0
            while True:
                self.up.append(step)
                if len(step.up) <= k:
                    break
                step, k = step.up[k], k + 1


def ancestor(node: Node, depth: int) -> Node:
    gap, k = node.depth - depth, 0
    while gap:
        if gap & 1:
            node = node.up[k]
        gap, k = gap >> 1, k + 1
    return node


def text_from(node: Node, depth: int = 0) -> str:
    """The edits from a depth on."""
    out = []
    while node.depth > depth:
        out.append(node.char)
        node = node.up[0]
    return "".join(reversed(out))


def _equal(a: Node, b: Node) -> bool:
    """Whether nodes of one depth and one hash have equal edits."""
    while a is not b:
        if a.char != b.char:
            return False
        a, b = a.up[0], b.up[0]
    return True


def less(a: Node, b: Node) -> bool:
    """Whether the edits down to ``a`` come before those down to ``b``."""
    depth = min(a.depth, b.depth)
    x, y = ancestor(a, depth), ancestor(b, depth)
    if x is y:
        return a.depth < b.depth
    if x.hash == y.hash:
        return a.depth < b.depth if _equal(x, y) else text_from(a) < text_from(b)
    for k in reversed(range(len(x.up))):
        if k < len(x.up) and x.up[k].hash != y.up[k].hash:
            x, y = x.up[k], y.up[k]
    if not _equal(x.up[0], y.up[0]):  # two prefixes of one hash
        return text_from(a) < text_from(b)
    return x.char < y.char


Cell = tuple[int, Node] | None


def _take(cells: list[Cell], state: int, cost: int, parent: Node, char: str) -> None:
    """Puts an edit's outcome into its cell if it is cheaper, or as cheap and less."""
    held = cells[state]
    if held is None or cost < held[0]:
        cells[state] = cost, Node(parent, char)
    elif cost == held[0]:
        new = Node(parent, char)
        if less(new, held[1]):
            cells[state] = cost, new


def _inserted(cells: list[Cell]) -> None:
    for state in (0, 1, 3, 2):  # a row after u last: it may follow one inserted just now
        if cells[state] is not None:
            _take(cells, NEXT[state, WANTED[state]], cells[state][0] + INSERT, cells[state][1], "I")


def _trimmed(cells: list[Cell]) -> str:
    """What all cells share, which leaves them."""
    live = [c[1] for c in cells if c is not None]
    depth = min(n.depth for n in live)
    level = [ancestor(n, depth) for n in live]
    for k in reversed(range(max(len(n.up) for n in level))):
        if len(level[0].up) > k and any(n.up[k] is not level[0].up[k] for n in level):
            level = [n.up[k] for n in level]
    shared = level[0] if all(n is level[0] for n in level) else level[0].up[0]
    fresh = {shared: Node(None)}
    for i, cell in enumerate(cells):
        if cell is not None:
            path, node = [], cell[1]
            while node not in fresh:
                path.append(node)
                node = node.up[0]
            for old in reversed(path):
                fresh[old] = Node(fresh[old.up[0]], old.char)
            cells[i] = cell[0], fresh[cell[1]]
    return text_from(shared)


def audit(codes: Iterable[str]) -> tuple[int, str]:
    """Cost and initials of the edits of rows given as codes: s, u, a or x for the role, upper case if truncated, - if it must go."""
    cells: list[Cell] = [(0, Node(None)), None, None, None]
    done = []
    for count, code in enumerate(codes, 1):
        _inserted(cells)
        after: list[Cell] = [None] * 4
        role, more = code.lower(), TRUNCATED if code.isupper() else 0
        for state, cell in enumerate(cells):
            if cell is None:
                continue
            cost, node = cell
            _take(after, state, cost + DELETE, node, "D")
            if code != "-":
                if (state, role) in NEXT:
                    _take(after, NEXT[state, role], cost + more, node, "K")
                _take(after, NEXT[state, WANTED[state]], cost + REROLE + more, node, "R")
        cells = after
        if count % TRIM == 0:
            done.append(_trimmed(cells))
    _inserted(cells)
    ends = [c for c in (cells[0], cells[3]) if c is not None]
    best = min(ends, key=lambda c: c[0])
    for cell in ends:
        if cell[0] == best[0] and cell is not best and less(cell[1], best[1]):
            best = cell
    return best[0], "".join(done) + text_from(best[1])


known_audit = functools.lru_cache(maxsize=1 << 16)(audit)


def repaired(edits: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """(role, text) of the rows after the edits."""
    state = 0
    for edit in edits:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        if edit != "K":
            role = ROLES[WANTED[state]]
        state = NEXT[state, role[:1]]
        yield role, text


def _order(role: Column, text: Column) -> Column:
    return F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))


def ordered(turns: DataFrame) -> DataFrame:
    """conv_id, known (whether there is a turn), turn, tie, role, text; sorted by the first four, rows are in order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    own = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    return own.select("conv_id", F.col("turn").isNotNull().alias("known"), "turn", _order(F.col("role"), F.col("text")).alias("tie"), "role", "text")


def coded(rows: DataFrame) -> DataFrame:
    """conv_id, known, turn, tie, role (s, u, a or x), fault (b, t or nothing) and the place where the row's like first stands, if there are two."""
    first = F.substring("role", 1, 1)
    role = F.when(first.isin("s", "u", "a"), first).otherwise("x")
    last = F.substring(F.rtrim("text", F.lit(WHITE)), -1, 1)
    fault = F.when(last == "", "b").when(~last.isin(".", "!", "?"), "t").otherwise("")
    own = settle(rows.select("conv_id", "known", "turn", "tie", role.alias("role"), fault.alias("fault")), "codes")
    like = own.groupBy(F.col("conv_id").alias("like_id"), F.col("tie").alias("like_tie")).agg(F.min(F.struct("known", "turn")).alias("first"), F.count("*").alias("n"))
    same = F.col("conv_id").eqNullSafe(F.col("like_id")) & (F.col("tie") == F.col("like_tie"))
    return own.join(like.filter("n > 1"), same, "left").select(*own.columns, (F.struct("known", "turn") > F.col("first")).alias("again"))


class _Tally:
    """What is counted of a conversation while its rows pass."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.blank, self.duplicate, self.truncated, self.illegal = conv_id, 0, 0, 0, 0
        self.role, self.before, self.turns, self.least, self.most = "", None, 0, None, None

    def code(self, known: bool, turn: int | None, tie: bytes, role: str, fault: str, again: bool | None) -> str:
        if self.role and self.role + role not in ("su", "ua", "au"):
            self.illegal += 1
        self.role = role
        if known and turn != self.most:
            self.turns, self.most = self.turns + 1, turn
            self.least = turn if self.least is None else self.least
        place = known, turn, tie
        again, self.before = bool(again) or place == self.before, place
        if fault == "b":
            self.blank += 1
        elif again:
            self.duplicate += 1
        elif fault == "t":
            self.truncated += 1
            return role.upper()
        return "-" if fault == "b" or again else role

    def row(self, cost: int, edits: str) -> tuple:
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        return self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, edits


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Iterator[tuple]]]:
    """Each conversation's id and its rows, which must be taken before the next is asked for."""
    rows = _rows(batches)
    row = next(rows, None)

    def own(conv_id: int | None) -> Iterator[tuple]:
        nonlocal row
        while row is not None and row[0] == conv_id:
            yield row
            row = next(rows, None)

    while row is not None:
        conv_id = row[0]
        group = own(conv_id)
        yield conv_id, group
        for _ in group:
            pass


def _batched(rows: Iterator[tuple], schema: pa.Schema, most: int = 4096) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for conv_id, group in _conversations(batches):
            tally, head = _Tally(conv_id), []
            codes = (tally.code(*row[1:]) for row in group)
            for code in codes:
                head.append(code)
                if len(head) > CACHED_ROWS:
                    break
            short = len(head) <= CACHED_ROWS
            cost, edits = known_audit("".join(head)) if short else audit(c for part in (head, codes) for c in part)
            yield tally.row(cost, edits)

    schema = pa.schema([(f.split()[0], pa.string() if f.endswith("string") else pa.int64()) for f in AUDITS.split(", ")])
    yield from _batched(rows(), schema)


def _dealt(rows: DataFrame, *order: str) -> DataFrame:
    n = partitions(rows.sparkSession)
    return rows.repartition(n, "conv_id").sortWithinPartitions(*[F.asc_nulls_first(c) for c in ("conv_id", *order)])


def audits(turns: DataFrame) -> DataFrame:
    """A row a conversation: its faults by kind, gaps, illegal neighbours, and the audit with its cost."""
    return _dealt(coded(ordered(turns)), "known", "turn", "tie").mapInArrow(_found, AUDITS)


def _applied(out: Callable[[int | None, Iterator[tuple[str, str]]], Iterator[tuple]], schema: pa.Schema) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for conv_id, group in _conversations(batches):
                edits = next(group)[-1]
                yield from out(conv_id, repaired(edits, ((row[-2], row[-1]) for row in group)))

        yield from _batched(rows(), schema)

    return run


def _digest(conv_id: int | None, rows: Iterator[tuple[str, str]]) -> Iterator[tuple]:
    total = hashlib.sha256()
    for i, (role, text) in enumerate(rows):
        total.update(f"{chr(10) if i else ''}{role}:{text}".encode())
    yield conv_id, total.hexdigest()


def _numbered(conv_id: int | None, rows: Iterator[tuple[str, str]]) -> Iterator[tuple]:
    for i, (role, text) in enumerate(rows):
        yield conv_id, i, role, text


def _behind_audits(turns: DataFrame, found: DataFrame) -> DataFrame:
    """Each conversation's audit as its first row, its rows in order after it."""
    rows = ordered(turns).withColumn("kind", F.lit(1))
    heads = found.select("conv_id", F.lit(0).alias("kind"), F.lit(False).alias("known"), F.lit(None).cast("long").alias("turn"), F.lit(b"").alias("tie"), F.lit("").alias("role"), F.col("audit").alias("text"))
    both = rows.select(heads.columns).unionByName(heads)
    return _dealt(both, "kind", "known", "turn", "tie")


def repair(turns: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id, turn (from 0), role, text: the repaired conversations, by their audits."""
    schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])
    return _behind_audits(turns, found).mapInArrow(_applied(_numbered, schema), "conv_id long, turn long, role string, text string")


def digests(turns: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id and repaired_sha256: the digest of the repaired rows, ``role:text`` joined by newlines."""
    schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])
    return _behind_audits(turns, found).mapInArrow(_applied(_digest, schema), "conv_id long, repaired_sha256 string")


def damage(turns: DataFrame) -> DataFrame:
    """The rows after damage, drawn from the CRC-32 of ``conv_id:turn`` modulo 20.

    0 drops the row, 1 empties its text, 2 takes its full stops, marks of exclamation and question, 3 repeats
    it, 4 makes its role user. Nulls count as one space in the key, and in role and text.
    """
    conv_id, turn, role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text"))
    fate = F.crc32(F.concat(conv_id, F.lit(":"), turn).cast("binary")) % 20
    own = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), fate.alias("fate")).filter("fate <> 0")
    copies = F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    return own.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies).drop("copy")


def repair_damaged(turns: DataFrame) -> DataFrame:
    """The counts, audit, cost and digest of every conversation of ``turns`` after ``damage``, zeros where no row is left."""
    rows = damage(turns)
    found = settle(audits(rows), "audits")
    hashed = digests(rows, found).withColumnRenamed("conv_id", "own_id")
    both = found.join(hashed, F.col("conv_id").eqNullSafe(F.col("own_id")))
    every = turns.select(F.col("conv_id").cast("long").alias("every")).distinct()
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = hashlib.sha256(b"").hexdigest()
    return every.join(both, F.col("every").eqNullSafe(F.col("conv_id")), "left").select(
        F.col("every").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256")
    )
