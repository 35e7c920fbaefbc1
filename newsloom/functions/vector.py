"""Column functions over vectors: arrays of numbers, folded in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column, least: float = 1e-12) -> Column:
    """v over its norm; the norm is taken as at least ``least``."""
    d = doubles(v)
    return F.element_at(F.transform(F.array(F.struct(d.alias("v"), F.greatest(norm(d), F.lit(least)).alias("n"))), lambda s: F.transform(s["v"], lambda x: x / s["n"])), 1)


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - cosine(a, b)


def plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def as_text(v: Column) -> Column:
    return F.to_json(v)


def from_text(x: Column) -> Column:
    return F.from_json(x, "array<double>")


def checked(v: Column, dim: int) -> Column:
    """v, or an error if its length isn't dim."""
    return F.when(F.size(v) == dim, v).otherwise(F.raise_error(F.concat(F.lit("a vector has "), F.size(v).cast("string"), F.lit(f" numbers, not {dim}"))).cast("array<double>"))
