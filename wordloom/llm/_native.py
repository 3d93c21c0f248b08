"""Spark expressions shared by the operators that run no Python on the executors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A private-use code point that marks borders; one already in a text is read as its neighbour,
#: which no pattern here tells apart from it, so positions stay as they are.
SENTINEL, STAND_IN = "", ""
#: Code points of a text that one list of running sums handles at a time.
BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once and not wherever a lambda mentions it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unmarked(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), SENTINEL, STAND_IN)


def cut_at(text: Column, pattern: str) -> Column:
    """``text`` (without sentinels) as an array: text, match, text, match, ..., text."""
    return F.split(F.regexp_replace(text, pattern, f"{SENTINEL}$0{SENTINEL}"), SENTINEL)


def running_starts(lengths: Column) -> Column:
    """Sum of the entries before each entry of an array of longs."""
    return _running(lengths, lambda a, x: a + x)


def running_tops(values: Column) -> Column:
    """The greatest of the entries before each entry of an array of longs that are 0 or more."""
    return _running(values, lambda a, x: F.greatest(a, x))


def _running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """``op`` over the entries before each entry, from 0.

    It runs within blocks, then over blocks, so that no step copies an array
    that grows with the whole.
    """

    def total(xs: Column) -> Column:
        return F.aggregate(xs, F.lit(0).cast("long"), op)

    def running(xs: Column) -> Column:
        sums = F.aggregate(xs, F.array(F.lit(0).cast("long")), lambda a, x: F.concat(a, F.array(op(F.element_at(a, -1), x))))
        return let(sums, lambda found: F.slice(found, 1, F.size(found) - 1))

    def cut(all_of: Column) -> Column:
        last = F.floor((F.greatest(F.size(all_of), F.lit(1)) - 1) / BLOCK).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(all_of, k * BLOCK + 1, BLOCK))

    def joined(blocks: Column) -> Column:
        bases = running(F.transform(blocks, total))
        return F.flatten(F.zip_with(blocks, bases, lambda xs, b: F.transform(running(xs), lambda s: op(s, b))))

    return let(values, lambda all_of: let(cut(all_of), joined))
