"""Sketches that are stored with each run and merged over runs without reading rows again.

HyperLogLog counts distinct values, KLL gives quantiles and ranks. A sketch is a few kilobytes however
many rows it stands for, and sketches of parts merge into that of the whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HLL_BITS = 12  # log2 of the registers; the relative standard error is about 1.04 / 2 ** (bits / 2)
KLL_K = 200  # the rank error is about 1.65 % of the rows with a probability of 99 %


def sketches_of(df: DataFrame, groups: Sequence[str], distinct: str, amount: str) -> DataFrame:
    """One row for each group: ``rows``, ``distinct_sketch`` and ``amount_sketch``. NULL values are left out."""
    return df.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("rows"),
        F.hll_sketch_agg(F.col(distinct), F.lit(HLL_BITS)).alias("distinct_sketch"),
        F.kll_sketch_agg_double(F.col(amount).cast("double"), F.lit(KLL_K)).alias("amount_sketch"),
    )


def merged(sketches: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """The sketches of several groups as one for each of ``groups``."""
    return sketches.groupBy(*groups).agg(
        F.sum("rows").alias("rows"),
        F.hll_union_agg("distinct_sketch").alias("distinct_sketch"),
        F.kll_merge_agg_double("amount_sketch").alias("amount_sketch"),
    )


def estimates(sketches: DataFrame, shares: Sequence[float] = (0.5, 0.9, 0.99)) -> DataFrame:
    """What the sketches say: ``distinct_estimate`` and a quantile ``q50``, ``q90``, ... for each share."""
    quantiles = [
        F.kll_sketch_get_quantile_double("amount_sketch", F.lit(float(share))).alias(f"q{round(share * 100)}")
        for share in shares
    ]
    others = [c for c in sketches.columns if not c.endswith("_sketch")]
    return sketches.select(*others, F.hll_sketch_estimate("distinct_sketch").alias("distinct_estimate"), *quantiles)
