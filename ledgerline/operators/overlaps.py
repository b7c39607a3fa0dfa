"""Join of intervals that overlap, by equal time bins.

An interval has a level, by its length: bins of that level are at least as long as it, so it lies in
one or two of them. Two intervals that overlap meet in the bins of the longer one's level. Each side is
therefore put into the bins of its own level and of the higher levels of the other side, and the pairs
are those of an interval at its own level with one that is there by itself or from below. Of the bins
that both lie in, the one in which the later of the two begins owns the pair, so no pair comes twice and
none must be made distinct. A very long interval is in two bins, not in thousands.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVEL_BITS = 2  # bins of a level are four times as long as those of the level below


def _level(length: Column) -> Column:
    """The least level whose bins are at least ``length`` long."""
    bits = F.when(length > 1, F.ceil(F.log2(length.cast("double")))).otherwise(0)
    level = F.ceil(bits / LEVEL_BITS).cast("int")
    # The logarithm of a large number is rounded; one level more is never wrong.
    exact = F.call_function("shiftleft", F.lit(1).cast("long"), level * LEVEL_BITS) >= length
    return F.when(exact, level).otherwise(level + 1)


def _bin(time: Column, level: Column) -> Column:
    return F.call_function("shiftright", time, level * LEVEL_BITS)


def levels(intervals: DataFrame, start: str, end: str) -> list[int]:
    """The levels that occur, of which there are a few at most."""
    found = intervals.where(F.col(start) <= F.col(end)).select(_level(F.col(end) - F.col(start) + 1).alias("level"))
    return sorted(r["level"] for r in found.distinct().collect())


def _in_bins(df: DataFrame, keys: Sequence[str], start: str, end: str, side: str, found: list[int], own: bool) -> DataFrame:
    """A row for each bin: of the interval's own level, or of the higher ones in ``found``."""
    first, last = F.col(f"`{start}`"), F.col(f"`{end}`")
    rows = df.where(first <= last).select(
        *[F.col(f"`{k}`").alias(f"{side}_key_{i}") for i, k in enumerate(keys)],
        first.cast("long").alias(f"{side}_start"), last.cast("long").alias(f"{side}_end"),
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(side),
        _level((last - first + 1).cast("long")).alias("level_of"),
    )
    if own:
        rows = rows.withColumn(f"{side}_level", F.col("level_of"))
    else:
        higher = F.filter(F.array(*[F.lit(x) for x in found]).cast("array<int>"), lambda x: x > F.col("level_of"))
        rows = rows.withColumn(f"{side}_level", F.explode(higher))
    level = F.col(f"{side}_level")
    ends = F.array_distinct(F.array(_bin(F.col(f"{side}_start"), level), _bin(F.col(f"{side}_end"), level)))
    return rows.withColumn(f"{side}_bin", F.explode(ends)).drop("level_of")


def overlap_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end"
) -> DataFrame:
    """All pairs with equal keys whose intervals share a moment, as structs ``a`` (left) and ``b`` (right).

    ``start`` and ``end`` are whole numbers such as milliseconds, both inside the interval, and smaller
    than 2 ** 60 in amount. Intervals that end before they begin, or lack a key, a start or an end, have
    no pairs. The levels of both sides are worked out first, in one pass over the lengths.
    """

    def pairs(a_own: bool, b_own: bool) -> DataFrame:
        a = _in_bins(left, keys, start, end, "a", of_b, a_own)
        b = _in_bins(right, keys, start, end, "b", of_a, b_own)
        on = (F.col("a_level") == F.col("b_level")) & (F.col("a_bin") == F.col("b_bin"))
        for i in range(len(keys)):
            on &= F.col(f"a_key_{i}") == F.col(f"b_key_{i}")
        on &= (F.col("a_start") <= F.col("b_end")) & (F.col("b_start") <= F.col("a_end"))
        on &= F.col("a_bin") == _bin(F.greatest("a_start", "b_start"), F.col("a_level"))
        return a.join(b, on).select("a", "b")

    of_a, of_b = levels(left, start, end), levels(right, start, end)
    out = pairs(True, True)
    if of_b and of_a and of_b[-1] > of_a[0]:
        out = out.unionByName(pairs(False, True))
    if of_b and of_a and of_a[-1] > of_b[0]:
        out = out.unionByName(pairs(True, False))
    return out
