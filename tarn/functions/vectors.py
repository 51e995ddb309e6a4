"""Arithmetic on arrays of numbers, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fold(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _double(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def literal(vector: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def dot(a: Column, b: Column) -> Column:
    return _fold(F.zip_with(_double(a), _double(b), lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of different lengths and where one is zero."""
    scale = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (scale > 0), dot(a, b) / scale).otherwise(0.0)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(_fold(F.zip_with(_double(a), _double(b), lambda x, y: (x - y) * (x - y))))


def manhattan(a: Column, b: Column) -> Column:
    return _fold(F.zip_with(_double(a), _double(b), lambda x, y: F.abs(x - y)))


METRICS = {"cosine": (cosine, True), "dot": (dot, True), "euclidean": (euclidean, False), "manhattan": (manhattan, False)}


def unit(a: Column) -> Column:
    """A vector scaled to length one; a zero vector stays."""
    # the length is computed once for a vector, not for each of its coordinates
    scaled = F.transform(F.array(F.struct(_double(a).alias("v"), norm(a).alias("n"))), lambda s: F.when(s["n"] > 0, F.transform(s["v"], lambda x: x / s["n"])).otherwise(s["v"]))
    return F.element_at(scaled, 1)


def mean_pool(vectors: Column, mask: Column) -> Column:
    """Mean of the vectors whose mask is 1, scaled to length one."""
    kept = F.transform(F.filter(F.arrays_zip(vectors.alias("v"), mask.alias("m")), lambda x: x["m"] == 1), lambda x: x["v"])
    total = F.aggregate(kept, F.transform(_double(vectors[0]), lambda x: F.lit(0.0)), lambda a, v: F.zip_with(a, _double(v), lambda p, q: p + q))
    return unit(F.transform(total, lambda x: x / F.greatest(F.size(kept), F.lit(1))))


def hash_embedding(text: Column, dim: int = 384) -> Column:
    """A placeholder embedding: it fixes dimension and length, and ranks nothing.

    It is a ramp of alternating sign, scaled by a positive number that the text gives, then to length one: the same vector
    for every text but null.
    """
    ramp = [(1.0 if i % 2 == 0 else -1.0) * (i + 1) / dim for i in range(dim)]
    length = sum(x * x for x in ramp) ** 0.5
    return F.when(text.isNotNull(), literal([x / length for x in ramp]))
