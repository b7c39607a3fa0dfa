"""Histories: what came last before a row, as-of joins, and sessions between gaps.

All of them need rows in the order of a key and a time, and something that is carried from row to row.
Rows are dealt by ranges of key and time and stored, so a key that holds much of the table takes as
many partitions as its rows need. Inside a partition a window carries; what goes from one partition
to the next is one narrow row for each partition and key, and only keys that go on in another
partition are joined back. No task sees a whole key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.session import fresh_path, write_and_read

PART_BITS = 33  # of a position: the place of a row in its partition; the number of the partition is above


def in_order(df: DataFrame, order: Sequence[str], name: str = "pos") -> DataFrame:
    """``df`` stored in ascending order (nulls first), with positions that rise in that order.

    Rows that agree in all of ``order`` are told apart by the order in which they are read, so that
    they need not come into one task; name columns enough to make such rows alike. Finding the ranges
    reads ``df`` once more: it should be no dearer than a scan.
    """
    columns = [*(F.col(c).asc_nulls_first() for c in order), F.col("tie")]
    dealt = df.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*columns)
    placed = dealt.sortWithinPartitions(*columns).drop("tie")
    placed = placed.withColumn(name, F.monotonically_increasing_id())
    return write_and_read(placed, fresh_path(df.sparkSession, "in-order"))


def _part() -> Column:
    return F.shiftright("pos", PART_BITS)


def _with_carry(rows: DataFrame, keys: Sequence[str], carry: DataFrame) -> DataFrame:
    """``rows`` (with ``part``) and the ``carry`` of their partition and key; NULL keys are equal."""
    carry = carry.select(F.col("part").alias("of_part"), *[F.col(k).alias(f"of_{k}") for k in keys], "carry")
    on = F.col("part") == F.col("of_part")
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"of_{k}"))
    return rows.join(carry, on, "left").drop("of_part", *[f"of_{k}" for k in keys])


def with_last(
    ordered: DataFrame, keys: Sequence[str], value: Column, name: str, with_own: bool = False
) -> DataFrame:
    """Add the last ``value`` that is not NULL of the rows before with the same ``keys``.

    ``ordered`` comes from `in_order` by the keys first. ``with_own`` counts the row itself too.
    """
    rows = ordered.select("*", _part().alias("part"), value.alias("value"))
    until = 0 if with_own else -1
    inside = Window.partitionBy("part", *keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, until)
    filled = F.last("value", ignorenulls=True).over(inside)
    at = F.when(F.col("value").isNotNull(), F.col("pos"))
    ends = rows.groupBy("part", *keys).agg(F.max_by("value", at).alias("end"))
    before = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.withColumn("carry", F.last("end", ignorenulls=True).over(before))
    rows = _with_carry(rows.withColumn("filled", filled), keys, carry.where("carry IS NOT NULL"))
    return rows.select(*ordered.columns, F.coalesce("filled", "carry").alias(name))


def with_running_count(ordered: DataFrame, keys: Sequence[str], counted: Column, name: str) -> DataFrame:
    """Add how many rows with the same ``keys``, up to the row itself, are ``counted``."""
    one = F.when(counted, 1).otherwise(0).cast("long")
    rows = ordered.select("*", _part().alias("part"), one.alias("value"))
    inside = Window.partitionBy("part", *keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.groupBy("part", *keys).agg(F.sum("value").alias("sum"))
    before = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.withColumn("carry", F.sum("sum").over(before)).where("carry > 0")
    rows = _with_carry(rows.withColumn("inside", F.sum("value").over(inside)), keys, carry)
    return rows.select(*ordered.columns, (F.col("inside") + F.coalesce("carry", F.lit(0))).alias(name))


def as_of(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, name: str = "found"
) -> DataFrame:
    """The rows of ``left``, with a struct of the columns of ``right`` that were in force at their time.

    That is the row with the same keys and the latest time not after that of the left row; of rows of
    the same key and time the largest by its other columns. NULL where there is none. Rows without a
    key or a time find nothing and are not found; no row of ``left`` is lost or repeated.
    """
    named = [f"key_{i}" for i in range(len(keys))]

    def side(df: DataFrame, time: str, kind: int) -> list[Column]:
        return [
            *[F.col(f"`{k}`").alias(n) for k, n in zip(keys, named, strict=True)],
            F.col(f"`{time}`").alias("time"), F.lit(kind).alias("kind"),
        ]

    def whole(df: DataFrame) -> Column:
        return F.struct(*[F.col(f"`{c}`") for c in df.columns])

    versions = right.dropna(subset=[*keys, right_time])
    versions = versions.select(*side(right, right_time, 0), whole(right).alias("entry"))
    rows = left.select(*side(left, left_time, 1), whole(left).alias("row"))
    both = versions.unionByName(rows, allowMissingColumns=True)
    ordered = in_order(both, [*named, "time", "kind", "entry"])
    filled = with_last(ordered, named, F.col("entry"), "last")
    known = F.col("time").isNotNull()
    for n in named:
        known &= F.col(n).isNotNull()
    kept = [F.col("row")[c].alias(c) for c in left.columns if c != name]
    return filled.where("kind = 1").select(*kept, F.when(known, F.col("last")).alias(name))


def with_sessions(
    events: DataFrame, keys: Sequence[str], time: str, gap_seconds: float, name: str = "session"
) -> DataFrame:
    """Number the sessions of each key from 1: one begins where more than ``gap_seconds`` have passed
    since the event before. Events of the same time are in the same session; a session of events
    without a time comes first. Columns of ``events`` stay."""
    others = [c for c in events.columns if c not in (*keys, time, name)]
    rows = events.select(*[c for c in events.columns if c != name])
    ordered = in_order(rows, [*keys, time, *others])
    seconds = F.col(time).cast("timestamp").cast("double")
    before = with_last(ordered, keys, F.struct(seconds.alias("at")), "earlier")
    # In sum a session begins at the first event, at the first with a time, and after each gap.
    gone = seconds - F.col("earlier")["at"]
    first = F.col("earlier").isNull() | (F.col("earlier")["at"].isNull() & F.col(time).isNotNull())
    begins = first | F.coalesce(gone > gap_seconds, F.lit(False))
    counted = with_running_count(before, keys, begins, name)
    return counted.select(*rows.columns, name)


def session_rows(sessions: DataFrame, keys: Sequence[str], time: str, name: str = "session") -> DataFrame:
    """One row for each session: its events, the first and the last time."""
    return sessions.groupBy(*keys, name).agg(
        F.count(F.lit(1)).alias("events"), F.min(time).alias("started_at"), F.max(time).alias("finished_at")
    )
