"""Vectors as array columns, and draws by hash that Spark and other SQL engines agree on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def distance(a: str, b: str) -> Column:
    """Euclidean distance of two array columns."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def dot(a: str, b: str) -> Column:
    """Inner product of two array columns."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def total(a: str) -> Column:
    """Sum of an array column."""
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def row_normalised(a: str) -> Column:
    """An array column over its sum; as it is where that is 0."""
    s = total(a)
    return F.when(s == 0, F.col(a)).otherwise(F.transform(a, lambda x: x / s))


def drawn(seed: int | str, *key: str) -> Column:
    """A text that orders rows at random, the same for the same key."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(k).cast("string") for k in key)))


def unit(seed: int | str, *key: str) -> Column:
    """A number from 0 to 1, evenly spread over keys."""
    return F.conv(F.substring(drawn(seed, *key), 1, 12), 16, 10).cast("double") / float(16**12)
