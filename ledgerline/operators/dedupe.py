"""Keyed deduplication and small ordered previews."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ledgerline.functions.text import is_blank
from ledgerline.rules import Dedupe


def any_blank(df: DataFrame, keys: Sequence[str]) -> Column:
    blanks = [
        is_blank(F.col(k)) if isinstance(df.schema[k].dataType, StringType) else F.col(k).isNull()
        for k in keys
    ]
    return reduce(or_, blanks)


def dedupe(df: DataFrame, rule: Dedupe, order: str = "row_idx") -> DataFrame:
    """One row per key. ``first`` keeps the first row; ``last`` keeps the last content at the
    position of the first. Rows with a blank key part are all kept.

    The winners are found on keys and positions alone, by a hash aggregate that collapses copies
    before its shuffle; a key that holds much of the table leaves at most one row per input
    partition. The rows then meet the winners by position, which is unique. Rows with a blank key
    need no partner and pass all this by.

    ``df`` is read three times: store it, unless it costs no more than a scan.
    """
    if not rule.keys:
        return df
    missing = [k for k in rule.keys if k not in df.columns]
    if missing:  # a key that no row has is blank in every row
        return df
    alone = any_blank(df, rule.keys)
    keyed = df.where(~alone)
    pick = F.min if rule.keep == "first" else F.max
    winners = keyed.groupBy(*[F.col(k).alias(f"key_{i}") for i, k in enumerate(rule.keys)]).agg(
        pick(order).alias("winner"), F.min(order).alias("place")
    )
    kept = keyed.join(winners.select("winner", "place"), F.col(order) == F.col("winner"))
    kept = kept.select(*[F.col("place").alias(c) if c == order else F.col(c) for c in df.columns])
    return kept.unionByName(df.where(alone))


def removed_count(df: DataFrame, rule: Dedupe, where: Column | None = None) -> Column:
    """Aggregate: how many rows (of those under ``where``) the deduplication takes away."""
    if not rule.keys or any(k not in df.columns for k in rule.keys):
        return F.lit(0).cast("long")
    counted = ~any_blank(df, rule.keys)
    if where is not None:
        counted = counted & where
    key = F.when(counted, F.struct(*rule.keys))
    return F.count_if(counted) - F.count_distinct(key)


def dedupe_counts(df: DataFrame, rule: Dedupe) -> DataFrame:
    removed = removed_count(df, rule)
    total = F.count(F.lit(1))
    return df.agg(
        total.alias("rows_in"),
        removed.alias("dedupe_removed"),
        (total - removed).alias("rows_out"),
    )


def head(df: DataFrame, n: int, order: str | Sequence[str] = "row_idx") -> DataFrame:
    """The first ``n`` rows by position, for previews and examples."""
    return df.orderBy(*([order] if isinstance(order, str) else order)).limit(n)
