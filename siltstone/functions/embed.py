"""Hash embeddings: signed feature hashing of tokens into 256 whole numbers, and exact similarity of them.

Components are integers before they are divided by their norm, so sums are exact in any order. A text is embedded in one
Arrow pass without a shuffle; each worker hashes a term once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType

DIM = 256
TOKEN = re.compile(rb"[a-z0-9_]+")
CELLS = 1 << 16  # terms a worker remembers
_cells: dict[bytes, tuple[int, int]] = {}
# FNV-1a with 64 bits.
FNV_BASIS, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def fnv1a(data: bytes) -> int:
    h = FNV_BASIS
    for b in data:
        h = (h ^ b) * FNV_PRIME & 0xFFFFFFFFFFFFFFFF
    return h


def fnv1a_limbs(term: Column) -> Column:
    """The same as two unsigned 32-bit halves (struct hi, lo), from built-in functions: no 64-bit product overflows."""
    data = F.transform(F.sequence(F.lit(1), F.octet_length(term)), lambda i: F.conv(F.hex(F.substring(F.encode(term, "UTF-8"), i, F.lit(1))), 16, 10).cast("long"))
    start = F.struct(F.lit(FNV_BASIS >> 32).cast("long").alias("hi"), F.lit(FNV_BASIS & 0xFFFFFFFF).cast("long").alias("lo"))
    low = lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF))

    def step(acc: Column, byte: Column) -> Column:
        x = acc["lo"].bitwiseXOR(byte)
        product = x * 0x1B3
        carry = F.shiftright(product, 32) + F.shiftleft(x.bitwiseAND(F.lit(0xFFFFFF)), 8)
        return F.struct(low(acc["hi"] * 0x1B3 + carry).alias("hi"), low(product).alias("lo"))

    return F.when(F.octet_length(term) > 0, F.aggregate(data, start, step)).otherwise(start)


def cell(term: bytes) -> tuple[int, int]:
    """Bucket and sign of a term."""
    found = _cells.get(term)
    if found is None:
        if len(_cells) >= CELLS:
            _cells.clear()
        h = fnv1a(term)
        found = _cells[term] = (h & (DIM - 1), -1 if h >> 63 else 1)
    return found


def embed_counts(text: str | None) -> np.ndarray:
    """Signed counts of each bucket."""
    return counted(TOKEN.findall((text or "").encode().lower()))


def counted(tokens: list[bytes]) -> np.ndarray:
    found = [cell(t) for t in tokens]
    if not found:
        return np.zeros(DIM)
    at, sign = zip(*found)
    return np.bincount(at, sign, DIM)


@pandas_udf(ArrayType(DoubleType()))
def hash_counts(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The embedding before it is divided by its norm."""
    for own in texts:
        yield pd.Series([embed_counts(t) for t in own])


def norm(counts: Column) -> Column:
    return F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, x: s + x * x))


def normalised(counts: Column) -> Column:
    n = norm(counts)
    return F.when(n > 0, F.transform(counts, lambda x: x / n)).otherwise(counts)


def dot(a: Column, b: Column) -> Column:
    """Over the shorter length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x * y, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)


def cosine_counts(a: Column, b: Column) -> Column:
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


class Embedder(Protocol):
    """What turns texts into vectors: a name that stores are keyed by, and a column of vectors of a column of texts."""

    name: str

    def column(self, texts: Column) -> Column: ...


class HashEmbedder:
    name = "hash"

    def column(self, texts: Column) -> Column:
        return hash_counts(texts)
