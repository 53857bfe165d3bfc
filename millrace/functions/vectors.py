"""Vector expressions, and the deterministic hash embedding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(a, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine similarity; 0 where a vector has no length."""
    n = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def hash_slot(token: Column, dim: int) -> Column:
    """md5 of a token, as a 128-bit number, modulo dim: by Horner over its 32-bit parts."""
    h = F.md5(token)
    at = F.lit(0).cast("long")
    # parts that are multiples of dim add nothing
    for i in range(4) if (1 << 32) % dim else [3]:
        part = F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("long")
        at = (at * F.lit((1 << 32) % dim) + part) % dim
    return at.cast("int")


def hash_embedding(text: Column, dim: int = 1536) -> Column:
    """Counts of white-space tokens in hashed slots, at length 1; zeros for an empty text.

    The slots a text has are grouped first, so the work is in its tokens, and a dense
    vector is laid out once."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda t: t != "")
    slots = F.transform(words, lambda t: hash_slot(t, dim))
    counts = F.aggregate(slots, F.array_repeat(F.lit(0.0), dim), lambda acc, s: F.concat(F.slice(acc, F.lit(1), s), F.array(F.element_at(acc, s + 1) + 1.0), F.slice(acc, s + 2, F.lit(dim))))
    length = norm(counts)
    return F.transform(counts, lambda v: F.when(length > 0, v / length).otherwise(F.lit(0.0)))
