"""Vector functions over array<float>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from matchlake.functions.text import let

EPSILON = 1e-12


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda total, x: total + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")))


def cosine_similarity(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(EPSILON))


def l2_normalize(a: Column) -> Column:
    # ``let``: inside the lambda the length would be computed for every element
    return let(F.greatest(norm(a), F.lit(EPSILON)), lambda length: F.transform(
        a, lambda x: (x.cast("double") / length).cast("float")))


def round2(c: Column) -> Column:
    """Two decimals the way numpy rounds: half to even on the binary value."""
    return F.rint(c * 100) / 100
