"""Order. A DataFrame has none, so positions are columns, and dense ones are counted in blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A block is 2**20 neighbouring positions, unless the caller knows them to be sparse.
BLOCK_BITS = 20


def with_sum_before(
    df: DataFrame, position: str, weight: Column, name: str, groups: Sequence[str] = (),
    bits: int = BLOCK_BITS,
) -> DataFrame:
    """Add the sum of ``weight`` over the rows of ``groups`` with a smaller ``position`` (a long).

    A window over a whole group would sort it in one task. Here a task sorts one block of 2**bits
    neighbouring positions; what comes before a block is a running sum over one narrow row per
    block. Sparse positions, such as a row number with some bits for what is inside the row, take
    larger blocks. Of equal positions one counts as the smaller.
    """
    groups = list(groups)
    rows = df.select("*", F.shiftright(position, bits).alias("block"), weight.alias("weight"))
    sums = rows.groupBy(*groups, "block").agg(F.sum("weight").alias("n"))
    earlier = Window.partitionBy(*groups).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*groups, "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy(*groups, "block").orderBy(position)
    inside = inside.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("weight").over(inside), F.lit(0)))
    return _join(rows, sums, [*groups, "block"]).select(
        *df.columns, (F.col("before") + F.col("inside")).alias(name)
    )


def with_rank(
    df: DataFrame, position: str, name: str = "rank", groups: Sequence[str] = (),
    bits: int = BLOCK_BITS,
) -> DataFrame:
    """Add the dense 0-based rank of ``position`` (a long) within ``groups``, block by block. The
    input is read for one count per block, and once more for its rows."""
    return with_sum_before(df, position, F.lit(1), name, groups, bits)


def _join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join that treats NULL keys as equal."""
    right = right.select(*[F.col(c).alias(f"r_{c}") if c in keys else F.col(c) for c in right.columns])
    on = [F.col(k).eqNullSafe(F.col(f"r_{k}")) for k in keys]
    return left.join(right, on).drop(*[f"r_{k}" for k in keys])


def read_order(scan: DataFrame) -> DataFrame:
    """Add the file and the split of each row to a plain file scan."""
    return scan.select(
        "*",
        F.col("_metadata.file_path").alias("in_file"),
        F.col("_metadata.file_block_start").alias("in_block"),
    )


def number_rows(
    ordered: DataFrame, name: str = "row_idx", start: Column | None = None, broadcast: bool = True
) -> DataFrame:
    """Turn the columns of ``read_order`` into one dense position, in file order.

    Within one split, rows are read in order, so the id given while reading is increasing and has
    no gaps; the rows before a split are a sum over one count per split (a split is about 128 MB,
    so there are few, and all tasks get them). The rows themselves are neither sorted nor shuffled. Without
    ``broadcast``, for files that are a row each, joins are left to measured sizes.
    """
    ordered = ordered.withColumn("in_split", F.monotonically_increasing_id())
    splits = ordered.groupBy("in_file", "in_block").agg(
        F.count(F.lit(1)).alias("n"), F.min("in_split").alias("first")
    )
    order = Window.orderBy("in_file", "in_block").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(order), F.lit(0)) + (F.lit(0) if start is None else start)
    splits = splits.select("in_file", "in_block", (before - F.col("first")).alias("shift"))
    kept = [c for c in ordered.columns if c not in ("in_file", "in_block", "in_split")]
    splits = F.broadcast(splits) if broadcast else splits
    return ordered.join(splits, ["in_file", "in_block"]).select(
        (F.col("in_split") + F.col("shift")).alias(name), *kept
    )


def with_file_position(scan: DataFrame, name: str = "row_idx", broadcast: bool = True) -> DataFrame:
    """Number the rows of a file source from 0, in file order. ``scan`` must be a plain scan."""
    return number_rows(read_order(scan), name, broadcast=broadcast)
