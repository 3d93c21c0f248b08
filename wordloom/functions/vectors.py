"""Vector arithmetic on arrays of doubles, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def unit(a: Column) -> Column:
    """``a`` over its Euclidean length; a zero vector stays."""
    length = F.sqrt(total(F.transform(a, lambda x: x * x)))
    return F.transform(a, lambda x: F.when(length > 0, x / length).otherwise(x))


def mean_of(rows: Column, size: int) -> list[Column]:
    """The average of each component over a group: one built-in aggregate a component."""
    return [F.avg(F.get(rows, F.lit(i))) for i in range(size)]


def pair_of_index(k: Column, n: Column) -> Column:
    """struct<i, j>: the k-th pair (from 0) of the strict upper triangle of n rows, row by row.

    The row is found from the triangle that remains below it; the square root
    may be off by one for large n and is corrected in integers.
    """
    left = n * (n - 1) / 2 - 1 - k
    guess = (n - 2 - F.floor((F.sqrt(8 * left.cast("double") + 1) - 1) / 2)).cast("long")

    def before(i: Column) -> Column:
        return (i * (2 * n - i - 1) / 2).cast("long")

    i = F.when(before(guess) > k, guess - 1).when(before(guess + 1) <= k, guess + 1).otherwise(guess)
    return F.struct(i.alias("i"), (k - before(i) + i + 1).cast("long").alias("j"))
