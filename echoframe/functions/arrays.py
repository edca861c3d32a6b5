"""Vector arithmetic as Column expressions over arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value) with the value computed once: an expression that a lambda mentions is computed at every call."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column, eps: float = 1e-12) -> Column:
    """v over the greater of its length and eps."""
    return let(F.greatest(norm(v), F.lit(eps)), lambda n: F.transform(v, lambda x: x / n))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def scale(v: Column, by: Column) -> Column:
    return F.transform(v, lambda x: x * by)


def zeros(n) -> Column:
    return F.array_repeat(F.lit(0.0), n)


def mean_rows(frames: Column) -> Column:
    """Mean over the rows of a matrix; rows divide by one at least."""


    def of(fs: Column) -> Column:
        n = F.greatest(F.size(fs), F.lit(1)).cast("double")
        sums = F.aggregate(fs, zeros(F.size(F.get(fs, F.lit(0)))), add)
        return F.transform(sums, lambda x: x / n)

    return let(frames, of)


def softplus(x: Column) -> Column:
    """log(1 + exp(x)) without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def positional_encoding(length: Column, dim: int) -> Column:
    """Sinusoidal encoding as an array of `length` rows: even places sin, odd cos; odd widths end in sin."""
    rates = [10000.0 ** (-2 * (k // 2) / dim) for k in range(dim)]
    cell = lambda p, k: F.sin(p * F.lit(rates[k])) if k % 2 == 0 else F.cos(p * F.lit(rates[k]))
    return F.transform(F.sequence(F.lit(0), length - 1), lambda p: F.array(*(cell(p.cast("double"), k) for k in range(dim))))
