"""A deterministic embedder: numbers from SHA-512, normalised."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def vector(text: str, dim: int) -> list[float]:
    """Big-endian 32-bit numbers of the digests of ``text:0``, ``text:1`` ... over 2**31, at unit length. For one text on the driver."""
    raw = b"".join(hashlib.sha512(f"{text}:{i}".encode()).digest() for i in range(-(-dim // 16)))
    values = np.frombuffer(raw, ">i4", dim).astype(np.float64) / 2**31
    norm = np.linalg.norm(values)
    return (values / norm if norm else values).astype(np.float32).tolist()


def _once(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def embed(text: Column, dim: int) -> Column:
    """The same vectors as a column, in the JVM; null for a null text."""
    digests = F.array(*[F.sha2(F.concat(text, F.lit(f":{i}")), 512) for i in range(-(-dim // 16))])
    number = lambda digest, k: F.conv(F.substring(digest, k * 8 + 1, F.lit(8)), 16, 10).cast("long")
    signed = lambda x: (x - F.when(x >= 2**31, F.lit(2**32)).otherwise(F.lit(0))) / F.lit(2.0**31)
    flat = F.flatten(F.transform(digests, lambda d: F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: signed(number(d, k)))))
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    scaled = lambda v: _once(norm(v), lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(x)))
    return F.when(text.isNotNull(), _once(F.slice(flat, 1, dim), scaled).cast("array<float>"))
