"""PII: format-preserving Feistel pseudonyms.

Numbers, dates, addresses and keys that pass their validation are taken for integers of a domain that
their format gives, and permuted there by a keyed Feistel network; values that leave the domain walk the
cycle until they are in it again. The result has the same format and passes the same validation: card
numbers keep their length and a right check digit, IBANs their country and right check digits, dates
stay dates with as many digits a part, keys keep the prefix that they are known by. Separators and leading
zeros stay as they are and do not count, so equal values get equal pseudonyms in every document, however they
are written, and different values different ones. With the key, ``back`` gives every text back byte for byte.

=========  ==========================================================================
card       13 to 19 digits, Luhn check; all digits but the check digit are permuted
iban       two letters, check digits by modulus 97, the rest permuted by class
ssn        ddd-dd-dddd with area, group and serial in use
phone      + and 8 to 15 digits, (ddd) ddd-dddd or ddd-ddd-dddd; North American numbers stay valid
ip         four numbers up to 255 without leading zeros, each with as many digits after
date       year-month-day, day.month.year or month/day/year from 1900 to 2099; days and months
           under 10 stay under 10
email      the part before @, letters and digits permuted by class
secret     keys of known shape behind their prefix, and values after ``key=`` and the like, by class
=========  ==========================================================================

Overlapping finds: the one that starts first, then the longer. What fails its validation stays as it is.

Defined results: null texts stay null; texts without finds stay byte for byte; each row is treated by itself, whatever
its id; columns besides doc_id and text take no part; an empty table gives no rows.
"""

from __future__ import annotations

import datetime
import hashlib
import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import slices

ROUNDS = 8
KINDS = ("card", "iban", "ssn", "phone", "ip", "date", "email", "secret")
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()

#: The prefixes of keys of known shape, and what follows them.
TOKENS = r"AKIA[0-9A-Z]{16}|gh[pousr]_\w{30,}|sk-\w{20,}"
_PREFIX = re.compile("AKIA|gh[pousr]_|sk-")
_ANNOUNCED = re.compile("(?:key|token|secret|password|passwd)$")

FINDS = re.compile(
    rf"""(?P<email>[A-Za-z0-9][\w.+-]{{0,63}}@[A-Za-z0-9][\w-]*(?:\.[\w-]+)+)
    |(?P<token>\b(?:{TOKENS}))
    |(?P<secret>(?:(?<=key=)|(?<=token=)|(?<=secret=)|(?<=password=)|(?<=passwd=)|(?<=key="))[\w/+-]{{12,}})
    |(?P<iban>\b[A-Z]{{2}}[0-9]{{2}}(?:\ ?[A-Z0-9]{{4}}){{2,7}}(?:\ ?[A-Z0-9]{{1,3}})?\b)
    |(?P<date>(?<![\w.-])(?:[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}|[0-9]{{1,2}}\.[0-9]{{1,2}}\.[0-9]{{4}})(?![\w-]|\.[0-9]))
    |(?P<ip>(?<![\w.])[0-9]{{1,3}}(?:\.[0-9]{{1,3}}){{3}}(?![\w]|\.[0-9]))
    |(?P<ssn>(?<![\w-])[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}(?![\w-]))
    |(?P<phone>(?<![\w+])(?:\+[0-9]{{1,3}}[ .-]?)?\([0-9]{{3}}\)[ ]?[0-9]{{3}}[ .-]?[0-9]{{4}}(?!\w)|(?<![\w+])\+[0-9]{{1,3}}(?:[ .-]?[0-9]{{2,4}}){{2,5}}(?!\w)|(?<![\w.+-])[0-9]{{3}}(?P<gap>[.-])[0-9]{{3}}(?P=gap)[0-9]{{4}}(?![\w-]|\.[0-9]))
    |(?P<card>(?<![\w.-])[0-9](?:[ -]?[0-9]){{12,18}}(?![\w-]))""",
    re.X,
)
_HINT = re.compile(r"[\d@]|sk-|key=|token=|secret=|passw")
_CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


class Feistel:
    """A keyed permutation of the integers under a bound; ``tweak`` gives each format its own."""

    def __init__(self, key: bytes):
        self.key = key

    def _round(self, tweak: str, i: int, half: int) -> int:
        return int.from_bytes(hashlib.blake2b(f"{tweak}|{i}|{half}".encode(), key=self.key[:64], digest_size=16).digest(), "big")

    def _once(self, x: int, a: int, b: int, tweak: str, back: bool) -> int:
        """x is left * b + right; rounds add to the left (below a) and to the right (below b) in turn."""
        left, right = divmod(x, b)
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            if i % 2:
                right = (right + sign * self._round(tweak, i, left)) % b
            else:
                left = (left + sign * self._round(tweak, i, right)) % a
        return left * b + right

    def permute(self, x: int, size: int, tweak: str, back: bool = False, good: Callable[[int], bool] = lambda _: True) -> int:
        """Walks until the value is under ``size`` and ``good``; x itself must be both."""
        if size < 2:
            return x
        b = math.isqrt(size - 1) + 1
        a = -(-size // b)
        while True:
            x = self._once(x, a, b, tweak, back)
            if x < size and good(x):
                return x


def luhn(digits: str) -> int:
    """The sum that a right card number makes a multiple of 10."""
    return sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits)))


def _refill(template: str, digits: str) -> str:
    fresh = iter(digits)
    return "".join(next(fresh) if c.isdigit() else c for c in template)


def _mixed(text: str) -> tuple[int, list[tuple[int, str]]]:
    """A text as an integer in mixed radix over its characters' classes; other characters are fixed."""
    value, places = 0, []
    for i, c in enumerate(text):
        if (kind := next((k for k in _CLASSES if c in k), None)) is not None:
            value = value * len(kind) + kind.index(c)
            places.append((i, kind))
    return value, places


def by_class(text: str, feistel: Feistel, tweak: str, back: bool, good: Callable[[str], bool] = lambda _: True) -> str:
    """Characters permuted together, each within its class; ``text`` and the result are ``good``."""
    value, places = _mixed(text)
    shape = "".join("9aA"[_CLASSES.index(k)] for _, k in places)

    def written(value: int) -> str:
        out = list(text)
        for i, kind in reversed(places):
            value, c = divmod(value, len(kind))
            out[i] = kind[c]
        return "".join(out)

    return written(feistel.permute(value, math.prod(len(k) for _, k in places), f"{tweak}|{shape}", back, lambda x: good(written(x))))


def _card(text: str, f: Feistel, back: bool) -> str | None:
    digits = re.sub(r"\D", "", text)
    if luhn(digits) % 10 or len(set(digits)) == 1:
        return None
    n = len(digits) - 1
    many = lambda x: len(set(f"{x:0{n}d}")) > 1
    body = f"{f.permute(int(digits[:-1]), 10**n, f'card{n}', back, many):0{n}d}" if many(int(digits[:-1])) else digits[:-1]
    return _refill(text, body + str(-luhn(body + "0") % 10))


def _iban(text: str, f: Feistel, back: bool) -> str | None:
    bare = text.replace(" ", "")
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    if not 15 <= len(bare) <= 34 or number(bare[4:] + bare[:4]) % 97 != 1:
        return None
    body = by_class(bare[4:], f, "iban" + bare[:2], back)
    fresh = iter(bare[:2] + f"{98 - number(body + bare[:2] + '00') % 97:02d}" + body)
    return "".join(c if c == " " else next(fresh) for c in text)


def _ssn(text: str, f: Feistel, back: bool) -> str | None:
    good = lambda x: 0 < x // 10**6 < 900 and x // 10**6 != 666 and x // 10**4 % 100 and x % 10**4
    value = int(text.replace("-", ""))
    return _refill(text, f"{f.permute(value, 10**9, 'ssn', back, good):09d}") if good(value) else None


def _phone(text: str, f: Feistel, back: bool) -> str | None:
    digits = re.sub(r"\D", "", text)
    if not 8 <= len(digits) <= 15:
        return None
    north = len(digits) == 10 and "+" not in text or len(digits) == 11 and digits[0] == "1"
    keep = len(digits) - 10 if north else min(2, len(digits) - 7)
    body = digits[keep:]
    valid = (lambda x: x // 10**9 >= 2 and x // 10**6 % 10 >= 2) if north else (lambda _: True)
    if north and not valid(int(body)):
        valid = lambda x: not (x // 10**9 >= 2 and x // 10**6 % 10 >= 2)
    tweak = "phone" if north else f"phone{digits[:keep]}{len(body)}"
    return _refill(text, digits[:keep] + f"{f.permute(int(body), 10 ** len(body), tweak, back, valid):0{len(body)}d}")


def _ip(text: str, f: Feistel, back: bool) -> str | None:
    parts = [int(x) for x in text.split(".")]
    if max(parts) > 255 or ".".join(map(str, parts)) != text:
        return None
    # Each part keeps its width: with another, what stands beside it might be found otherwise on the way back.
    ranges = [(0, 9) if p < 10 else (10, 99) if p < 100 else (100, 255) for p in parts]
    value = size = 0
    for p, (low, high) in zip(parts, ranges, strict=True):
        value = value * (high - low + 1) + p - low
        size = max(size, 1) * (high - low + 1)
    value, fresh = f.permute(value, size, "ip" + "".join(str(len(str(p))) for p in parts), back), []
    for low, high in reversed(ranges):
        value, p = divmod(value, high - low + 1)
        fresh.append(str(low + p))
    return ".".join(reversed(fresh))


def _date(text: str, f: Feistel, back: bool) -> str | None:
    parts = re.split(r"[-/.]", text)
    order = (0, 1, 2) if "-" in text else (2, 1, 0) if "." in text else (2, 0, 1)  # where year, month and day stand
    try:
        day = datetime.date(*(int(parts[k]) for k in order))
    except ValueError:
        return None
    if not FIRST_DAY <= day.toordinal() <= LAST_DAY:
        return None
    # Days and months of one digit stay such, so that a part's width need not change, however it is written.
    small = lambda d: (d.day < 10, d.month < 10)
    good = lambda x: small(datetime.date.fromordinal(FIRST_DAY + x)) == small(day)
    fresh = datetime.date.fromordinal(FIRST_DAY + f.permute(day.toordinal() - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, "date", back, good))
    for k, value in zip(order, (fresh.year, fresh.month, fresh.day), strict=True):
        parts[k] = f"{value:0{len(parts[k])}d}"
    return ("-" if "-" in text else "." if "." in text else "/").join(parts)


def _email(text: str, f: Feistel, back: bool) -> str | None:
    name, _, host = text.rpartition("@")
    return by_class(name, f, "email", back) + "@" + host


def _by_class_before(text: str, feistel: Feistel, tweak: str, back: bool, good: Callable[[str], bool] = lambda _: True) -> str:
    """As ``by_class``; a word at the end that would announce a value after it stays, and none comes about."""
    end = _ANNOUNCED.search(text)
    body = text[: end.start()] if end else text
    return by_class(body, feistel, tweak, back, lambda x: good(x) and (end is not None or _ANNOUNCED.search(x) is None)) + text[len(body) :]


def _token(text: str, f: Feistel, back: bool) -> str | None:
    at = _PREFIX.match(text).end()
    return text[:at] + _by_class_before(text[at:], f, "token" + text[:at], back)


def _secret(text: str, f: Feistel, back: bool) -> str | None:
    return _by_class_before(text, f, "secret", back, lambda x: re.match(TOKENS, x) is None)  # else it would be found as a token


_BY_KIND: dict[str, Callable[[str, Feistel, bool], str | None]] = {"card": _card, "iban": _iban, "ssn": _ssn, "phone": _phone, "ip": _ip, "date": _date, "email": _email, "token": _token, "secret": _secret}


def replace(text: str, feistel: Feistel, back: bool = False) -> tuple[str, list[str]]:
    """The text with its pseudonyms, and the kinds that were replaced, in order."""
    if _HINT.search(text) is None:
        return text, []
    kinds: list[str] = []

    def one(match: re.Match) -> str:
        kind = "phone" if match.lastgroup == "gap" else match.lastgroup
        fresh = _BY_KIND[kind](match.group(), feistel, back)
        if fresh is None:
            return match.group()
        kinds.append("secret" if kind == "token" else kind)
        return fresh

    return FINDS.sub(one, text), kinds


def pseudonymise(docs: DataFrame, key: bytes, back: bool = False) -> DataFrame:
    """doc_id, n_found, n_<kind> for each kind and the text with pseudonyms, a row a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feistel = Feistel(key)
        for batch in slices(batches):
            texts, counts = [], []
            for text in batch.column(1).to_pylist():
                fresh, kinds = (None, []) if text is None else replace(text, feistel, back)
                texts.append(fresh)
                counts.append([len(kinds), *(kinds.count(k) for k in KINDS)])
            columns = [pa.array([c[i] for c in counts], pa.int64()) for i in range(len(KINDS) + 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(texts, pa.string())], ["doc_id", "n_found", *(f"n_{k}" for k in KINDS), "text"])

    schema = "doc_id long, n_found long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", text string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
