"""Rows in a total order, and their ranks, without a task that sees more than its share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.session import fresh_path, write_and_read

PART_BITS = 33  # of a position: the place of a row in its sort partition; the number of the partition is above


def in_order(df: DataFrame, keys: Sequence[str], name: str = "pos") -> DataFrame:
    """``df`` in ascending order of ``keys`` (nulls first), stored in the shared folder, with positions that rise in that order.

    The rows are dealt by ranges of the keys. Rows with equal keys are told apart by the order in which they are
    read, so they need not come into one task; callers give keys that make such rows alike. Finding the ranges
    reads ``df`` once more, so it should be cheap to read.
    """
    read = df.withColumn("tie", F.monotonically_increasing_id())
    order = [*(F.col(key).asc_nulls_first() for key in keys), F.col("tie")]
    placed = read.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie")
    return write_and_read(placed.withColumn(name, F.monotonically_increasing_id()), fresh_path(df.sparkSession, "in-order"))


def ranked(df: DataFrame, keys: Sequence[str], within: str | None = None) -> DataFrame:
    """``df`` with ``idx``, the rank from 0 by ``keys`` among the rows with the same ``within``, and ``n``, their number.

    What comes before a sort partition is a sum over one narrow row for each partition (and each value of ``within``
    in it), which a window of one task adds up; the rows themselves are only sorted within their partitions.
    """
    rows = in_order(df, [within, *keys] if within else keys).withColumn("part", F.shiftright("pos", PART_BITS))
    group = [F.col(within)] if within else []
    spans = rows.groupBy("part", *group).agg(F.count(F.lit(1)).alias("rows"), F.min("pos").alias("first"))
    whole = Window.partitionBy(*group)
    before = F.coalesce(F.sum("rows").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = spans.select(F.col("part").alias("of_part"), *(x.alias("of_group") for x in group), (before - F.col("first")).alias("shift"), F.sum("rows").over(whole).alias("n"))
    spans = write_and_read(spans, fresh_path(df.sparkSession, "spans"))
    on = F.col("part") == F.col("of_part")
    if within:
        on &= F.col(within).eqNullSafe(F.col("of_group"))
    return rows.join(spans, on).select(*(F.col(f"`{c}`") for c in df.columns), (F.col("pos") + F.col("shift")).alias("idx"), "n")
