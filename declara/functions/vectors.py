"""Vector arithmetic on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: an expression mentioned inside a lambda
    would otherwise run again for every element."""
    return F.transform(F.array(value), lambda bound: use(bound))[0]


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x * x)))


def cosine(a: Column, b: Column) -> Column:
    """Null where one of them is a zero vector."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def squared_distance(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def hamming(a: Column, b: Column) -> Column:
    """How many positions differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 0).otherwise(1)), F.lit(0), lambda s, x: s + x)


def mixed_distance(num_a: Column, num_b: Column, cat_a: Column, cat_b: Column, gamma: float = 1.0) -> Column:
    """Squared Euclid plus ``gamma`` times the number of differing categories (no root)."""
    return squared_distance(num_a, num_b) + F.lit(float(gamma)) * hamming(cat_a, cat_b)


def scaled(v: Column, by: Column) -> Column:
    """Every element divided by ``by``; zeros where ``by`` is zero."""
    return let(v, lambda a: let(by, lambda total: F.transform(a, lambda x: F.when(total == 0, 0.0).otherwise(x / total))))


def unit(v: Column) -> Column:
    return let(v, lambda a: scaled(a, norm(a)))


def to_shares(v: Column) -> Column:
    """Absolute values scaled to sum 1: a topic-like distribution."""
    return let(F.transform(v, lambda x: F.abs(x)), lambda a: scaled(a, _sum(a)))


def soft_weights(distances: Column, m: float = 2.0) -> Column:
    """Fuzzy memberships 1 / sum_j (d_i / d_j)^(2/(m-1)) from an array of distances.

    Distances are scaled by the smallest one first, so that large powers neither
    overflow nor vanish; zero distances share the whole weight.
    """
    power = F.lit(2.0 / (m - 1.0))

    def scores(d, nearest):
        return F.when(
            nearest == 0, F.transform(d, lambda x: F.when(x == 0, 1.0).otherwise(0.0))
        ).otherwise(F.transform(d, lambda x: F.pow(nearest / x, power)))

    return let(distances, lambda d: let(
        let(F.array_min(d), lambda nearest: scores(d, nearest)), lambda s: scaled(s, _sum(s))
    ))


def argmax(values: Column) -> Column:
    """Zero-based position of the first largest value."""
    return let(values, lambda v: (F.array_position(v, F.array_max(v)) - 1).cast("int"))


def argmin(values: Column) -> Column:
    return let(values, lambda v: (F.array_position(v, F.array_min(v)) - 1).cast("int"))
