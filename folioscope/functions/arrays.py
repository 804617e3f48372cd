"""Folds and groupings over arrays of one row, for pages and tables that are nested in their rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles() -> Column:
    return F.array().cast("array<double>")


def let(value: Column, use) -> Column:
    """use(value) with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def dedupe_bounds(values: Column, gap: float) -> Column:
    """Sorted values, each kept if it is more than gap past the last one that was kept."""
    step = lambda kept, v: F.when((F.size(kept) == 0) | (v - F.try_element_at(kept, F.lit(-1)) > gap), F.concat(kept, F.array(v))).otherwise(kept)
    return F.aggregate(F.array_sort(values.cast("array<double>")), doubles(), step)


def slices(items: Column, parted) -> Column:
    """items cut into arrays wherever parted(one, the next) holds; the work is in proportion to the items."""

    def cut(own: Column) -> Column:
        n = F.size(own)
        places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        begins = F.filter(places, lambda k: (k == 0) | parted(F.get(own, k - 1), F.get(own, k)))
        return let(begins, lambda at: F.when(own.isNotNull(), F.transform(at, lambda a, j: F.slice(own, a + 1, F.coalesce(F.get(at, j + 1), n) - a))))

    return let(items, cut)


def apart(before: Column, value: Column, tolerance: float) -> Column:
    """Whether a sorted value is more than tolerance past the one before it."""
    return ~F.coalesce(value - before <= tolerance, F.lit(False))


def cluster(values: Column, tolerance: float) -> Column:
    """Means of runs of sorted values in which neighbours are tolerance apart at most; nulls are dropped."""
    known = F.filter(values.cast("array<double>"), lambda v: v.isNotNull())
    return F.transform(slices(F.sort_array(known), lambda a, b: apart(a, b, tolerance)), lambda g: total(g) / F.size(g))


def neighbours(values: Column) -> Column:
    """(a, b) for every value and the next one."""
    return let(values, lambda own: F.transform(F.slice(own, 1, F.greatest(F.lit(0), F.size(own) - 1)), lambda v, k: F.struct(v.alias("a"), F.get(own, k + 1).alias("b"))))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def mean(values: Column) -> Column:
    return let(values, lambda own: total(own) / F.size(own))


def count(values: Column, test) -> Column:
    return F.size(F.filter(values, test))


def longest_common_prefix(a: Column, b: Column) -> Column:
    """Characters that two strings have in common from the beginning."""
    n = F.least(F.length(a), F.length(b))
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    first = F.array_min(F.filter(places, lambda k: F.substring(a, k, F.lit(1)) != F.substring(b, k, F.lit(1))))
    return F.coalesce(first - 1, n)
