"""Vector functions over arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of different lengths, empty ones and those of norm 0."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (F.size(a) <= 0) | (n == 0), F.lit(0.0)).otherwise(dot(a, b) / n)


def unit(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def hashed_embedding(tokens: Column, size: int = 384) -> Column:
    """A unit vector of ``size`` numbers: each token adds one, with a sign, at the place that its hash says."""
    at = F.transform(tokens, lambda t: F.struct(F.pmod(F.xxhash64(t), F.lit(size)).cast("int").alias("i"), F.when(F.xxhash64(F.lit(1), t) % 2 == 0, 1.0).otherwise(-1.0).alias("s")))
    raw = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.aggregate(F.filter(at, lambda p: p["i"] == i), F.lit(0.0), lambda s, p: s + p["s"]))
    return unit(raw)


def digest(a: Column) -> Column:
    """128 bits of SHA-256 of a vector's numbers, so that equal vectors meet without being moved; 0 and -0 are equal."""
    return F.substring(F.sha2(F.array_join(F.transform(a, lambda x: (x.cast("double") + 0.0).cast("string")), ","), 256), 1, 32)
