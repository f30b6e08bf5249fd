"""Toxicity by a weighted finite-state pattern grammar over clauses.

A sentence becomes a tape of word classes: I insult, H threat, T somebody addressed, O the same in object form,
N negation, R reported speech, a comma between clauses, - anything else. Transducers read the tape and add marks
to attacks (I and H); each one's output is the next one's input:

* ``SAID_AFTER`` (from right to left) marks r what a following clause reports (``..., he said``);
* ``AFTER`` (from right to left) marks t what is followed by T or O within ``NEAR`` words;
* ``BEFORE`` and ``OBJECT_BEFORE`` mark t an insult that T or O, and a threat that O precedes as closely: who
  stands before a threat in subject form makes it, and is no target;
* ``NEGATED`` marks n the next attack within ``NEAR`` words of N, and only that one;
* ``SAID_BEFORE`` marks r the attacks after R in its sentence.

The first two are composed into one machine for the way back, the others into one for the way forth. ``WEIGH`` turns
marked attacks into weights: an insult has its learned weight, a threat nearly none without a target; t raises,
n and r lower it. A clause's weight is the sum of its attacks'. A document's sum s of clause weights gives its score
1 / (1 + exp(-(a * log(1 + s) + b))), with a and b fitted on the labelled sample.

Learning: at most ``sample`` labelled rows, those of least hash, by default 20,000; texts are read whole.
Words, and word beginnings that a text has twice, are counted by label in Spark; a form that labels 1 and 0 by at
least ``LEAST`` log-odds (less two standard errors), and so surely that among all forms fewer than ``CHANCE`` would
seem to by chance, may enter the lexicon, strongest first, if it explains documents that few entries explain yet.
So words that only copies of one document share stay out.
With no usable labels, the built-in English insults alone are the lexicon. Labels, language, source
and id are never inputs of a score.

Defined results: null and empty texts score as documents without an attack; rows of null or repeated ids are scored
each by itself, null ids are never held out; null labels are not learned from; several labels for an id, and several rows
of a labelled id, count as several rows; extra columns take no part; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import slices
from .shared import settle

SAMPLE, ENTRIES, LEAST, COVER, CHANCE = 20_000, 400, 1.0, 3, 0.05
BEGINNINGS = (3, 4, 5, 6, 7, 8)
NEAR = 4
WORD = re.compile(r"\w+")
SENTENCE = re.compile(r"[.!?;\n]+")
CLAUSE = re.compile(r"[,:]+")
TOKEN = re.compile(r"\w+|[,:]+")

#: The closed word classes, in the corpus's four languages.
THREATS = "kill hurt destroy burn smash shoot stab strangle töten schlagen umbringen tuer frapper brûler matar golpear quemar"
TARGETS = "you your yours u ur they he she du ihr tu vous ils elle tú usted ustedes ellos"
OBJECTS = "them him her dich dir euch toi te ti"
NEGATIONS = "not never no without isn aren don doesn nicht kein keine nie ne pas jamais sans nunca jamás sin"
REPORTS = "said says say wrote writes claimed claims called quoted quote reported allegedly sagte schrieb angeblich dit écrit selon dijo escribió según"
INSULTS = "idiot moron stupid scum loser worthless pathetic disgusting trash clown imbecile bastard vermin"


@dataclass(frozen=True)
class Lexicon:
    """Weights of whole words and of word beginnings ('abcd*'), and the curve of the score."""

    weights: dict[str, float]
    a: float = 2.0
    b: float = -3.0
    threats: tuple[tuple[str, float], ...] = tuple((w, 1.0) for w in THREATS.split())

    def weight(self, word: str) -> float:
        best = self.weights.get(word, 0.0)
        for k in BEGINNINGS:
            if len(word) >= k and (found := self.weights.get(word[:k] + "*", 0.0)) > best:
                best = found
        return best


ATTACKS = "IH"
BREAK = ","


class Transducer:
    """Moves (state, class) -> (state, mark that the symbol gets); ``None`` is any other class. Without a move nothing changes."""

    def __init__(self, moves: dict[tuple, tuple]):
        self.moves = moves

    def step(self, state, symbol: str) -> tuple:
        state, mark = self.moves.get((state, symbol[0])) or self.moves.get((state, None)) or (state, "")
        return state, symbol if mark in symbol else symbol + mark


def _near(triggers: str, attacks: str, mark: str, spent: bool = False) -> Transducer:
    """Marks ``attacks`` within NEAR words of a trigger of the same clause; the first attack of any kind ends it if ``spent``."""
    moves: dict[tuple, tuple] = {(0, t): (NEAR, "") for t in triggers}
    for k in range(1, NEAR + 1):
        moves |= {(k, None): (k - 1, ""), (k, BREAK): (0, "")} | {(k, t): (NEAR, "") for t in triggers}
        moves |= {(k, a): (0 if spent else k - 1, mark if a in attacks else "") for a in ATTACKS}
    return Transducer(moves)


def _said_after() -> Transducer:
    """From right to left: states (words in which a comma must come, whether the clause is reported)."""
    moves: dict[tuple, tuple] = {}
    for k in range(3):
        for told in (False, True):
            less = (max(k - 1, 0), told)
            moves |= {((k, told), "R"): ((2, told), ""), ((k, told), BREAK): ((0, k > 0), ""), ((k, told), None): (less, "")}
            moves |= {((k, told), a): (less, "r" if told else "") for a in ATTACKS}
    return Transducer({**moves, (0, "R"): ((2, False), "")})


SAID_AFTER = _said_after()
AFTER = _near("TO", "IH", "t")
BEFORE = _near("TO", "I", "t")
OBJECT_BEFORE = _near("O", "H", "t")
NEGATED = _near("N", "IH", "n", spent=True)
SAID_BEFORE = Transducer({(0, "R"): (1, ""), (1, "I"): (1, "r"), (1, "H"): (1, "r")})
THREAT_ALONE = 0.05
MARKS = {"t": 1.5, "n": 0.6, "r": 0.7}


def weigh(symbol: str) -> float:
    """The factor of a marked attack; other symbols weigh nothing."""
    if symbol[0] not in ATTACKS:
        return 0.0
    return math.prod(MARKS[m] for m in symbol[1:]) * (THREAT_ALONE if symbol[0] == "H" and "t" not in symbol else 1.0)


def compose(*machines: Transducer) -> Callable[[list[str]], list[str]]:
    """One machine whose output is that of the last of ``machines``, each of which reads the one before; states are kept as they are met."""
    table: dict[tuple, tuple] = {}

    def run(tape: list[str]) -> list[str]:
        state, out = (0,) * len(machines), []
        for symbol in tape:
            if (found := table.get((state, symbol))) is None:
                states, made = [], symbol
                for machine, own in zip(machines, state, strict=True):
                    own, made = machine.step(own, made)
                    states.append(own)
                found = table[state, symbol] = (tuple(states), made)
            state, made = found
            out.append(made)
        return out

    return run


class Grammar:
    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.classes = {w: c for c, words in (("R", REPORTS), ("N", NEGATIONS), ("T", TARGETS), ("O", OBJECTS)) for w in words.split()}
        self.threats = dict(lexicon.threats)
        self.back, self.forth = compose(SAID_AFTER, AFTER), compose(BEFORE, OBJECT_BEFORE, NEGATED, SAID_BEFORE)
        self.seen: dict[str, tuple[str, float]] = {}

    def symbol(self, word: str) -> tuple[str, float]:
        if (found := self.seen.get(word)) is None:
            weight = self.lexicon.weight(word)
            threat = self.threats.get(word, 0.0)
            found = ("I", weight) if weight else ("H", threat) if threat > 0 else (BREAK if word[0] in ",:" else self.classes.get(word, "-"), 0.0)
            if len(self.seen) < 300_000:
                self.seen[word] = found
        return found

    def marked(self, tape: list[str]) -> list[str]:
        """The tape with all marks: the way back, then the way forth."""
        return self.forth(self.back(tape[::-1])[::-1])

    def clauses(self, text: str) -> list[tuple[str, float]]:
        """The clauses that attack, and their weights."""
        words = set(WORD.findall(text := text.lower()))
        symbol = self.symbol
        if not any(symbol(w)[0] in ATTACKS for w in words):
            return []
        found = []
        for sentence in SENTENCE.split(text):
            symbols = [symbol(w) for w in TOKEN.findall(sentence)]
            if not any(c in ATTACKS for c, _ in symbols):
                continue
            totals = [0.0]
            for made, (_, weight) in zip(self.marked([c for c, _ in symbols]), symbols, strict=True):
                if made == BREAK:
                    totals.append(0.0)
                elif made[0] in ATTACKS:
                    totals[-1] += weight * weigh(made)
            found += [(clause, total) for clause, total in zip(CLAUSE.split(sentence), totals, strict=True) if total > 0]
        return found

    def score(self, total: float) -> float:
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, self.lexicon.a * math.log1p(total) + self.lexicon.b))))


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _forms(text: str) -> set[str]:
    """Whole words, and beginnings of two or more of the words: one alone may be chance."""
    words = Counter(WORD.findall(text.lower()))
    once: set[str] = set()
    forms = set(words)
    for word, n in words.items():
        for k in BEGINNINGS:
            if len(word) >= k:
                start = word[:k] + "*"
                if n > 1 or start in once:
                    forms.add(start)
                else:
                    once.add(start)
    return forms


def _count_forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each label with each form, summed over the task's rows and sent in parts."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())

    def out() -> pa.RecordBatch:
        forms = list(counts[0].keys() | counts[1].keys())
        columns = [pa.array(forms), *(pa.array([c[f] for f in forms], pa.int64()) for c in counts)]
        for c in counts:
            c.clear()
        return pa.RecordBatch.from_arrays(columns, ["form", "label0", "label1"])

    for batch in slices(batches):
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts[label].update(_forms(text or ""))
        if len(counts[0]) + len(counts[1]) > 1_000_000:
            yield out()
    if counts[0] or counts[1]:
        yield out()


def _strength(one: float, zero: float, ones: int, zeros: int) -> tuple[float, float]:
    """Log-odds of label 1 for a form, and the same less two standard errors."""
    odds = math.log((one + 0.5) / (ones + 1)) - math.log((zero + 0.5) / (zeros + 1))
    return odds, odds - 2 * math.sqrt(1 / (one + 0.5) + 1 / (zero + 0.5))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(text, label) of the bounded sample: no held-out row, no null label.

    ``sample`` bounds the rows themselves: of an id that several rows of ``docs`` have, one text counts for each
    label, that of the least digest. Other rows of the id are scored as all are.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic").cast("int") != 0).cast("int").alias("label")).filter(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    picked = own.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    held = texts.join(F.broadcast(picked.distinct()), "doc_id")  # ``sample`` ids at most
    return held.groupBy("doc_id", "label").agg(F.min_by("text", F.md5("text")).alias("text")).select("text", "label")


def _places(forms: dict[str, float]) -> Callable:
    """Which candidate forms each text of label 1 holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array([sorted(_forms(t or "") & forms.keys()) for t in batch.column(0).to_pylist()], pa.list_(pa.string()))], ["forms"])

    return run


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Lexicon:
    """Learns the lexicon and the score's curve from a bounded sample of labelled rows.

    The model is bounded too: of the forms that tell, the surest 5,000 are looked at, and at most ENTRIES enter the lexicon.
    """
    rows = settle(training_rows(docs, labels, sample), "labelled")
    built_in = Lexicon({w: 1.0 for w in INSULTS.split()})
    counts = rows.mapInArrow(_count_forms, "form string, label0 long, label1 long").groupBy("form").agg(F.sum("label0").alias("label0"), F.sum("label1").alias("label1"))
    counts = settle(counts.filter("label0 + label1 >= 3"), "forms")
    totals = rows.groupBy("label").count().collect()
    ones, zeros = (sum(r["count"] for r in totals if r["label"] == k) for k in (1, 0))
    if not ones or not zeros:
        return built_in
    # Of the forms that enough rows of label 1 have, at most 5,000, the surest first.
    tested = counts.filter("label1 >= 3")
    # Among so many forms some seem to tell by chance: n * KL(share of label 1 | that of all) bounds how likely.
    n, share, base = F.col("label0") + F.col("label1"), F.col("label1") / (F.col("label0") + F.col("label1")), ones / (ones + zeros)
    gain = share * F.log(share / base) + F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - base))).otherwise(0.0)
    tested = tested.filter(n * gain >= math.log(max(1, tested.count()) / CHANCE))
    ranked = tested.withColumn("odds", F.log((F.col("label1") + 0.5) / (ones + 1)) - F.log((F.col("label0") + 0.5) / (zeros + 1)))
    sure = F.col("odds") - 2 * F.sqrt(1 / (F.col("label1") + 0.5) + 1 / (F.col("label0") + 0.5))
    found = ranked.withColumn("sure", sure).filter(F.col("sure") >= LEAST).orderBy(F.desc("sure"), F.col("form").contains("*"), F.desc(F.length("form")), "form").limit(5000).collect()
    odds = {r["form"]: r["odds"] for r in found}
    if not odds:
        return built_in
    held = [set(r["forms"]) for r in rows.filter("label = 1").select("text").mapInArrow(_places(odds), "forms array<string>").collect()]
    chosen, covered = {}, np.zeros(len(held), int)
    for form in odds:
        fresh = [i for i, h in enumerate(held) if form in h and covered[i] < COVER]
        if len(fresh) >= max(4, 0.01 * len(held)) and not any(form.startswith(c.rstrip("*")) or c.rstrip("*").startswith(form.rstrip("*")) for c in chosen):
            chosen[form] = odds[form] / (10 if form.endswith("*") else 5)  # a beginning counts by its second match
            covered[[i for i, h in enumerate(held) if form in h]] += 1
            if len(chosen) >= ENTRIES:
                break
    if not chosen:
        return built_in
    # A threat word that the sample shows often keeps the weight it shows; a rare one has the mean insult's.
    known = {r["form"]: r for r in counts.filter(F.col("form").isin(THREATS.split())).collect()}
    mean = sum(chosen.values()) / len(chosen)
    threats = []
    for word in THREATS.split():
        r = known.get(word)
        often = r is not None and r["label0"] + r["label1"] >= 10
        threats.append((word, max(0.0, _strength(r["label1"], r["label0"], ones, zeros)[0] / 5) if often else mean))
    return _curve(Lexicon(chosen, threats=tuple(threats)), rows)


def _curve(lexicon: Lexicon, rows: DataFrame) -> Lexicon:
    """Fits a and b to the sample's sums, by Newton's method on counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(lexicon)
        for batch in slices(batches):
            sums = [round(math.log1p(sum(w for _, w in grammar.clauses(t or ""))), 2) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(sums, pa.float64()), batch.column(1)], ["x", "label"])

    points = rows.mapInArrow(run, "x double, label int").groupBy("x", "label").count().collect()
    x, y, n = (np.array([float(r[c]) for r in points]) for c in ("x", "label", "count"))
    design, theta = np.stack([x, np.ones_like(x)], 1), np.array([2.0, -3.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        slope = design.T @ (n * (y - p)) - 0.1 * theta
        curve = (design * (n * p * (1 - p))[:, None]).T @ design + 0.1 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        theta = theta + np.clip(step, -2, 2)
    return Lexicon(lexicon.weights, float(theta[0]), float(theta[1]), lexicon.threats) if theta[0] > 0 else lexicon


def score(docs: DataFrame, lexicon: Lexicon, column: str = "text") -> DataFrame:
    """doc_id, score, n_clauses and the weightiest clause of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(lexicon)
        for batch in slices(batches):
            found = [grammar.clauses(t.as_py()) if t.is_valid else [] for t in batch.column(1)]
            scores = [grammar.score(sum(w for _, w in f)) for f in found]
            top = [max(f, key=lambda x: x[1])[0].strip() if f else None for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array([len(f) for f in found], pa.int64()), pa.array(top, pa.string())], ["doc_id", "score", "n_clauses", "top_clause"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, n_clauses long, top_clause string")


def label_crc(doc_id: int) -> int:
    """The remainder that decides whether a row is held out, as the tests compute it."""
    return zlib.crc32(str(doc_id).encode()) % 4


def below(docs: DataFrame, lexicon: Lexicon, threshold: float) -> DataFrame:
    """The rows whose score is under ``threshold``, with all their columns, in one narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(lexicon)
        for batch in batches:
            totals = [sum(w for _, w in grammar.clauses(t.as_py())) if t.is_valid else 0.0 for t in batch.column(batch.schema.get_field_index("text"))]
            yield batch.filter(pa.array([grammar.score(t) < threshold for t in totals], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
