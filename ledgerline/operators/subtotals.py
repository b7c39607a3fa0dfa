"""Subtotals over several sets of keys, with counts of distinct values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def subtotals(
    df: DataFrame, sets: Sequence[Sequence[str]], distinct: str, sums: Mapping[str, Column],
) -> DataFrame:
    """One row for each group of each set of keys: the keys (NULL where the set does not have them), ``grouping_id``
    (a bit for each key that is not in the set, the first key highest), ``rows``, ``distinct_values`` of the column
    ``distinct`` (NULL not counted) and a sum for each of ``sums``. Sets given twice count once; the empty set is
    the total, which an empty table lacks.

    Rows are first summed up by all keys and the value, and only what is left is repeated for each set. Values are
    told apart by group and value together, so a group that holds all rows, the total, is spread over all tasks; what
    meets in one task for a group is one row from each of the others. Names that begin with ``_`` are the operator's.
    """
    keys = list(dict.fromkeys(key for one in sets for key in one))
    once = list(dict.fromkeys(tuple(key in one for key in keys) for one in sets))
    totals = {"rows": F.lit(1), **sums}
    cells = df.groupBy(*keys, F.col(distinct).alias("_value")).agg(*[F.sum(c).alias(n) for n, c in totals.items()])

    def group(present: Sequence[bool]) -> Column:
        number = sum(1 << (len(keys) - 1 - i) for i, there in enumerate(present) if not there)
        held = [(F.col(k) if there else F.lit(None).cast(df.schema[k].dataType)).alias(k) for k, there in zip(keys, present, strict=True)]
        return F.struct(*held, F.lit(number).alias("grouping_id"))

    each = cells.select(F.explode(F.array(*map(group, once))).alias("_group"), "_value", *totals)
    each = each.select("_group.*", "_value", *totals)
    values = each.groupBy(*keys, "grouping_id", "_value").agg(*[F.sum(n).alias(n) for n in totals])
    return values.groupBy(*keys, "grouping_id").agg(
        F.sum("rows").alias("rows"), F.count("_value").alias("distinct_values"), *[F.sum(n).alias(n) for n in sums]
    )
