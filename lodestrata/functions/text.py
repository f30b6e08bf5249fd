"""Canonical JSON, payload compaction and cuts of text."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_json(payload: Column) -> Column:
    """Any JSON text with sorted keys, compact separators and unescaped Unicode; what is no JSON gives null."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            try:
                return None if text is None else json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
            except ValueError:
                return None

        return texts.map(one)

    return run(payload)


def sorted_json(payload: Column) -> Column:
    """As ``canonical_json`` without leaving the JVM: a variant keeps the keys of objects sorted; what is no JSON gives null.

    Numbers with a fraction are written as decimals without closing zeros, not as Python writes them.
    """
    return F.to_json(F.try_parse_json(payload))


def record(**fields: Column) -> Column:
    """Canonical JSON of a fixed shape, in the JVM: fields in the order of their names, nulls left out."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))


def compact(payload: Column, drop_zero: bool = False) -> Column:
    """A map of strings without empty values and, if asked, without zeros and false."""
    empty = [""] + (["0", "0.0", "false"] if drop_zero else [])
    return F.map_filter(payload, lambda k, v: v.isNotNull() & ~v.isin(empty))


def cut_at_line(text: Column, tokens: int) -> Column:
    """At most four characters a token, back to the last whole line; a line end that is just within counts as the last."""
    size = tokens * 4
    head = F.substring(text, 1, size)
    return F.when(F.length(text) <= size, text).otherwise(F.when(F.contains(head, F.lit("\n")), F.regexp_replace(head, r"\n[^\n]*\z", "")).otherwise(head))
