"""Vector arithmetic on array<double> columns, inside code generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO = 1e-8


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(total(F.transform(a, lambda x: x * x)))


def over(a: Column, n: Column) -> Column:
    """Each element of a over n; n is made once for a row, not inside the lambda."""
    return F.zip_with(a, F.array_repeat(n, F.size(a)), lambda x, y: F.try_divide(x, y))


def unit(a: Column) -> Column:
    """a over its length plus 1e-8, so that a zero vector stays zero."""
    return over(a, norm(a) + F.lit(ZERO))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null where a vector is zero, which callers decide about."""
    return 1 - F.try_divide(dot(a, b), norm(a) * norm(b))


def weighted_concat(a: Column, b: Column, first: float = 0.7, second: float = 0.3) -> Column:
    """The elements of a times first, then those of b times second; a alone, unweighted, where b is null."""
    scaled = lambda x, w: F.transform(x, lambda v: v * F.lit(w))
    return F.when(b.isNull(), a).otherwise(F.concat(scaled(a, first), scaled(b, second)))


def clipped(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def first_match(rules: list[tuple[Column, Column]], default: Column) -> Column:
    """The value of the first condition that holds; a condition that is null doesn't."""
    return reduce(lambda out, r: F.when(r[0], r[1]).otherwise(out), reversed(rules), default)
