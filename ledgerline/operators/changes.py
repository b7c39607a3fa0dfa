"""What changed between two versions of a table, and the newest rows of each group.

A table is a multiset of rows: repeated rows count. Rows are compared by all their cells; only counts
of them meet, so a row that is there very often is one row after the aggregation before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def row_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """The rows to take away and to add, with ``change`` (``removed``, ``added``) and ``copies``."""
    columns = old.columns
    counted = old.select(*columns, F.lit(-1).alias("copies")).unionByName(
        new.select(*columns, F.lit(1).alias("copies"))
    )
    net = counted.groupBy(*columns).agg(F.sum("copies").alias("net")).where("net != 0")
    return net.select(
        *columns, F.when(F.col("net") > 0, "added").otherwise("removed").alias("change"),
        F.abs("net").alias("copies"),
    )


def apply_changes(old: DataFrame, changes: DataFrame) -> DataFrame:
    """The new version from the old one and what `row_changes` gave."""
    columns = old.columns
    sign = F.when(F.col("change") == "added", F.col("copies")).otherwise(-F.col("copies"))
    counted = old.select(*columns, F.lit(1).cast("long").alias("copies")).unionByName(
        changes.select(*columns, sign.alias("copies"))
    )
    left = counted.groupBy(*columns).agg(F.sum("copies").cast("int").alias("copies"))
    repeated = left.where("copies > 0").withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("copies"))))
    return repeated.select(*columns)


def cell_changes(changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """For each key with one removed and one added row: ``column``, ``old`` and ``new`` as texts, NULL for NULL.

    Keys whose rows were only added or only removed, or that have several, are in `row_changes` alone.
    """
    columns = [c for c in changes.columns if c not in ("change", "copies", *keys)]
    cells = F.struct(*[F.col(c).cast("string").alias(c) for c in columns])

    def of(side: str, value: Column) -> Column:
        return F.when(F.col("change") == side, value)

    sides = changes.groupBy(*keys).agg(
        F.sum(of("removed", F.col("copies"))).alias("rows_removed"),
        F.sum(of("added", F.col("copies"))).alias("rows_added"),
        F.any_value(of("removed", cells), ignoreNulls=True).alias("was"),
        F.any_value(of("added", cells), ignoreNulls=True).alias("now"),
    ).where("rows_removed = 1 AND rows_added = 1")
    entries = F.array(*[
        F.when(
            ~F.col("was")[c].eqNullSafe(F.col("now")[c]),
            F.struct(F.lit(c).alias("column"), F.col("was")[c].alias("old"), F.col("now")[c].alias("new")),
        )
        for c in columns
    ])
    return sides.select(*keys, F.inline(F.array_compact(entries)))


def newest_of_each(df: DataFrame, groups: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group by ``order``, with their ``rank`` from 1.

    Each task keeps ``k`` rows of a group before the shuffle, so a group that holds much of the table
    sends ``k`` rows for each task. End ``order`` with something unique for ties that do not depend on
    how the rows are dealt.
    """
    rank = F.row_number().over(Window.partitionBy(*groups).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= k)
