"""Sequences of tokens, snapshots and masks: bans, rings, chunks, offsets, positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import let, mean


def banned(ids: Column, n: int = 35, window: int = 128, allowed: list | None = None) -> Column:
    """Distinct ids that would repeat an n-gram of the window, in order of their values; allowed ones are taken out."""
    size = F.size(ids)
    first, last = F.greatest(F.lit(0), size - window), size - n
    prefix = F.slice(ids, size - n + 2, F.lit(n - 1)) if n > 1 else None
    starts = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    hits = F.filter(starts, lambda k: F.slice(ids, k + 1, F.lit(n - 1)) == prefix) if n > 1 else starts
    found = F.array_sort(F.array_distinct(F.transform(hits, lambda k: F.get(ids, k + n - 1))))
    out = F.array_except(found, F.array(*map(F.lit, allowed))) if allowed else found
    return F.when(size >= n, out).otherwise(F.slice(ids, 1, 0))


def ring(rows: DataFrame, keys: list[str], order: list[str], prefix: str, width: int) -> DataFrame:
    """Rows that a ring buffer still shows: all of the prefix, and the last width others."""
    late = Window.partitionBy(*keys).orderBy(F.col(prefix).cast("int"), *(F.col(c).desc() for c in order))
    return rows.withColumn("age", F.row_number().over(late)).where(F.col(prefix) | (F.col("age") <= width)).drop("age")


def chunks(markdown: Column, size: int = 320) -> Column:
    """Cumulative snapshots (end, text, tokens, done) of a text; none of an empty one."""
    n = F.length(markdown)
    ends = F.when(n > 0, F.sequence(F.lit(size), n + size - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))
    text = lambda e: F.substring(markdown, F.lit(1), F.least(e, n))
    return F.transform(ends, lambda e: F.struct(F.least(e, n).alias("end"), text(e).alias("text"), F.greatest(F.lit(1), F.floor(F.least(e, n) / 4).cast("int")).alias("tokens"), (e >= n).alias("done")))


def latest(snapshots: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """The newest snapshot of each key."""
    return snapshots.groupBy(*keys).agg(F.max_by(text, order).alias(text), F.max(order).alias(order))


def stable(snapshots: DataFrame, keys: list[str], order: list[str], text: str, is_stable: Column, done: Column) -> DataFrame:
    """Adds stable: the last text up to here that was stable or final."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return snapshots.withColumn("stable", F.last(F.when(is_stable | done, F.col(text)), ignorenulls=True).over(w))


def unpadded(mask: Column) -> Column:
    """(length, places of ones) of a mask."""
    places = F.filter(F.transform(mask, lambda m, k: F.when(m == 1, k)), lambda k: k.isNotNull())
    return F.struct(F.size(places).alias("length"), places.alias("places"))


def positions(mask: Column) -> Column:
    """Running counts of ones less 1; 1 where the mask is 0."""
    return F.transform(mask, lambda m, k: F.when(m == 1, F.aggregate(F.slice(mask, F.lit(1), k + 1), F.lit(0), lambda a, v: a + v.cast("int")) - 1).otherwise(F.lit(1)))


def repeated(values: Column, n: int) -> Column:
    """Every value n times in a row."""
    return F.flatten(F.transform(values, lambda v: F.array_repeat(v, n)))


def shifted(labels: Column) -> Column:
    """(given, next) pairs of a sequence."""
    return F.transform(F.slice(labels, 1, F.greatest(F.lit(0), F.size(labels) - 1)), lambda v, k: F.struct(v.alias("given"), F.get(labels, k + 1).alias("next")))


def filled_slots(slots: Column, values: Column, own: Column) -> Column:
    """own with the k-th true slot taking the k-th value."""
    rank = lambda k: F.aggregate(F.slice(slots, F.lit(1), k), F.lit(0), lambda a, s: a + s.cast("int"))
    return F.transform(own, lambda v, k: F.when(F.get(slots, k), F.get(values, rank(k))).otherwise(v))


def offsets(rows: DataFrame, keys: list[str], order: list[str], size: str) -> DataFrame:
    """Adds start, the sizes of all rows before of the same keys."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("start", F.coalesce(F.sum(size).over(w), F.lit(0)))


def throughput(snapshots: DataFrame, keys: list[str]) -> DataFrame:
    """tokens, seconds, tokens_per_second of each key from snapshots (tokens, seconds); halves go away from zero."""
    # Scaled before it is rounded, as DuckDB does it: the product's own rounding decides what is a half.
    rounded = lambda c, scale: F.round(c * scale) / scale
    rows = snapshots.groupBy(*keys).agg(F.max("tokens").alias("tokens"), rounded(F.max("seconds"), 100.0).alias("seconds"))
    return rows.withColumn("tokens_per_second", F.when(F.col("seconds") > 0, rounded(F.col("tokens") / F.col("seconds"), 10.0)))


def rms_norm(values: Column, weight: float = 1.0, eps: float = 1e-6) -> Column:
    """Values by the root of their mean square."""
    square = lambda own: F.sqrt(mean(F.transform(own, lambda v: v * v)) + eps)
    return let(values.cast("array<double>"), lambda own: let(square(own), lambda root: F.transform(own, lambda v: v / root * weight)))


def layer_norm(values: Column, eps: float = 1e-6) -> Column:
    """Values less their mean, by their population deviation."""
    centred = lambda own: let(mean(own), lambda m: F.transform(own, lambda v: v - m))
    return let(centred(values.cast("array<double>")), lambda own: let(F.sqrt(mean(F.transform(own, lambda v: v * v)) + eps), lambda root: F.transform(own, lambda v: v / root)))


def grid_rows(rows: Column, cols: Column) -> Column:
    """Places of a feature grid in reading order, a newline (col -1) after every row and a separator (row -1) at the end."""
    places = F.flatten(F.transform(F.sequence(F.lit(0), rows - 1), lambda r: F.concat(F.transform(F.sequence(F.lit(0), cols - 1), lambda c: F.struct(r.alias("row"), c.alias("col"))), F.array(F.struct(r.alias("row"), F.lit(-1).alias("col"))))))
    return F.concat(places, F.array(F.struct(F.lit(-1).alias("row"), F.lit(-1).alias("col"))))
