"""Derived identities and shard numbers, byte for byte."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _joined(*parts: Column) -> Column:
    return F.concat_ws("\0", *parts)


def unit_id(repo: Column, path: Column, qname: Column) -> Column:
    return F.sha2(_joined(repo, path, qname), 256)


def query_id(repo: Column, text: Column) -> Column:
    return F.substring(F.sha2(_joined(repo, text), 256), 1, 16)


def cache_key(repo: Column, text: Column, k: Column, kinds: Column, seeds: Column, version: Column) -> Column:
    """Lists are sorted and distinct, so equal requests have equal keys."""
    flat = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    fields = [("repo", repo), ("q", text), ("k", k.cast("string")), ("kinds", flat(kinds)), ("seeds", flat(seeds)), ("v", version.cast("string"))]
    return F.sha2(F.concat_ws("|", *[F.concat(F.lit(name + "="), value) for name, value in fields]), 256)


def shard(key: Column, count: int) -> Column:
    """The first eight bytes of the key's SHA-256, big-endian, modulo ``count``."""
    return F.pmod(F.conv(F.substring(F.sha2(key, 256), 1, 16), 16, 10).cast("decimal(20,0)"), F.lit(count)).cast("long")


def signature(ids: Column) -> Column:
    """Of a list of neighbour ids: duplicates count, order does not."""
    return F.sha2(F.concat_ws(",", F.sort_array(ids)), 256)


def is_unit_id(text: Column) -> Column:
    return text.rlike("^[0-9a-f]{64}$")
