"""Substring search by an index of trigrams.

Every text gives its distinct runs of three lower-case characters. A search intersects the lists of its own
rarest trigrams and verifies what is left, so it reads those lists and not all texts. Lists are sorted by trigram,
so that Parquet's statistics leave out the others; a list, however long, spans as many files as it needs.
Texts asked for that have no three characters in a row beside wildcards name no list; all rows are their candidates.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..shared import settle

#: Lists that a search intersects.
LISTS = 3


@F.pandas_udf(ArrayType(StringType()))
def _runs(texts: pd.Series) -> pd.Series:
    def one(text: str | None) -> list[str]:
        if text is None or len(text) < 3:
            return []
        codes = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)  # a code point has 21 bits
        found = np.unique(codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:])
        every = np.stack([found >> 42, found >> 21 & 0x1FFFFF, found & 0x1FFFFF], 1).astype("<u4").tobytes().decode("utf-32-le")
        return [every[i : i + 3] for i in range(0, len(every), 3)]

    return texts.map(one, na_action=None)


def grams(text: Column) -> Column:
    """The distinct trigrams of a text in lower case; empty for null and for fewer than three characters. Time grows with the text, not with its square."""
    return _runs(F.lower(text))


@dataclass(frozen=True)
class Trigrams:
    """``lists`` (gram, key) sorted by gram, and ``sizes`` (gram, n)."""

    lists: DataFrame
    sizes: DataFrame

    def rarest(self, asked: str, wildcards: bool) -> list[str] | None:
        """The trigrams of ``asked`` with the shortest lists; none if one has no list, None if it has no trigrams."""
        parts = [p for p in (re.split(r"[%_]", asked) if wildcards else [asked]) if len(p) >= 3 and "\\" not in p]
        if not parts:
            return None
        own = self.lists.sparkSession.range(1).select(F.explode(F.array_distinct(F.flatten(F.array(*[grams(F.lit(p)) for p in parts])))).alias("gram"))
        found = own.join(self.sizes.filter(F.col("gram").isin([r.gram for r in own.collect()])), "gram", "left").collect()  # as many rows as the asked text has
        if any(r.n is None for r in found):
            return []
        return [r.gram for r in sorted(found, key=lambda r: (r.n, r.gram))[:LISTS]]

    def candidates(self, asked: str, wildcards: bool = False) -> DataFrame | None:
        """(key) of the texts that may hold ``asked``, of which % and _ match anything with ``wildcards``; None for all."""
        chosen = self.rarest(asked, wildcards)
        if chosen is None:
            return None
        held = self.lists.filter(F.col("gram").isin(chosen)).groupBy("key").agg(F.count("*").alias("n"))
        return held.filter(F.col("n") == len(chosen)).select("key")

    def within(self, rows: DataFrame, key: str, asked: list[str], wildcards: bool = False) -> DataFrame:
        """The rows whose texts may hold one of a few asked texts; which do is left to the search over them."""
        found = [self.candidates(a, wildcards) for a in asked]
        if any(f is None for f in found):
            return rows
        every = found[0]
        for f in found[1:]:
            every = every.union(f)
        return rows.join(every.withColumnRenamed("key", key), key, "left_semi")


def index(rows: DataFrame, key: str, *texts: str) -> Trigrams:
    """An index over some text columns of ``rows``, whose ``key`` tells them apart; a search of any of them may use it."""
    every = F.array_distinct(F.flatten(F.array(*[grams(F.col(t)) for t in texts])))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = settle(rows.select(F.explode(every).alias("gram"), F.col(key).alias("key")), "grams")  # ranges read their rows twice; texts are read once
    lists = settle(found.repartitionByRange(n, "gram", "key").sortWithinPartitions("gram", "key"), "trigrams")
    return Trigrams(lists, settle(lists.groupBy("gram").agg(F.count("*").alias("n")), "sizes"))
