"""Line dedup by spread: a line that stands on many sites is boilerplate, whatever its count.

The sites of each line are counted with HyperLogLog sketches, which merge as they are aggregated, so that a
line costs a few bytes for each task however often it comes. Where the estimate is near the threshold, the
sites are counted exactly.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.session import fresh_path, write_and_read

LEAST_SITES = 10
SKETCH_BITS = 10


def normalized(line: Column) -> Column:
    """What makes lines the same: case and the amount of blanks do not matter."""
    return F.lower(F.trim(F.regexp_replace(line, r"[ \t\r\f\x0B]+", " ")))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def places(docs: DataFrame, site_col: str, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``body_key``, ``site``, ``pos``, ``k1``, ``k2``: the lines that are not blank, by 128 bits of each."""
    text = F.col(f"`{text_col}`").cast("string")
    keys = F.transform(_lines(text), normalized)
    lines = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("body_key"), F.col(f"`{site_col}`").cast("string").alias("site"), F.posexplode(keys).alias("pos", "line"))
    return lines.where(F.col("line") != "").select("id", "body_key", "site", "pos", F.xxhash64("line").alias("k1"), F.xxhash64(F.lit(1), "line").alias("k2"))


def spread(lines: DataFrame, least_sites: int = LEAST_SITES, bits: int = SKETCH_BITS) -> DataFrame:
    """``k1``, ``k2``, ``first``: the lines on ``least_sites`` sites or more, and the first place of each.

    ``lines`` is as `places` returns it. Every line gets a sketch of its sites. Estimates further from the
    threshold than five standard errors decide; the lines between are counted exactly. A line of fewer rows
    than ``least_sites`` cannot reach it and needs no estimate.
    """
    error = 5 * 1.04 / math.sqrt(2**bits)
    sketched = lines.groupBy("k1", "k2").agg(F.count("site").alias("n"), F.min(F.when(F.col("id").isNotNull(), F.struct("id", "pos"))).alias("first"), F.hll_sketch_agg("site", bits).alias("sites"))
    estimates = sketched.where(F.col("n") >= least_sites).select("k1", "k2", "first", F.hll_sketch_estimate("sites").alias("estimate"))
    estimates = write_and_read(estimates.where(F.col("estimate") >= math.floor(least_sites * (1 - error))), fresh_path(lines.sparkSession, "line-spread"))
    sure = F.col("estimate") > math.ceil(least_sites * (1 + error))
    near = estimates.where(~sure)
    sites = lines.where(F.col("site").isNotNull()).join(near.select("k1", "k2"), ["k1", "k2"], "left_semi").select("k1", "k2", "site").distinct()
    enough = sites.groupBy("k1", "k2").agg(F.count("*").alias("n_sites")).where(F.col("n_sites") >= least_sites)
    return estimates.where(sure).unionByName(near.join(enough, ["k1", "k2"], "left_semi")).select("k1", "k2", "first")


def clean(docs: DataFrame, least_sites: int = LEAST_SITES, site_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without boilerplate lines, with ``n_lines`` and ``n_removed`` (long) added.

    A line on ``least_sites`` or more different sites stays only at its first place: the document with the
    smallest id that has it, and there the first line; all other places lose it. Lines end at a newline and are
    compared without regard to case and the amount of blanks. Blank lines stay. A null text stays null and has
    no lines; an empty text has one blank line. A row without site counts for no site; a row without id is no
    first place. Rows with one id are judged each by itself; where they are equal both keep the first place.
    Other columns stay; columns named ``n_lines`` and ``n_removed`` are replaced. Only keys of lines are grouped
    and joined; the places to remove then come to the texts by id and text hash.
    """
    spark = docs.sparkSession
    lines = write_and_read(places(docs, site_col, id_col, text_col), fresh_path(spark, "lines"))
    boilerplate = write_and_read(spread(lines, least_sites), fresh_path(spark, "boilerplate"))
    is_first = F.coalesce((F.col("id") == F.col("first.id")) & (F.col("pos") == F.col("first.pos")), F.lit(False))
    found = lines.join(boilerplate, ["k1", "k2"]).where(~is_first)
    by_row = found.groupBy(F.col("id").alias("_id"), F.col("body_key").alias("_key")).agg(F.collect_set("pos").alias("_gone"))
    names = [name for name in docs.columns if name not in ("n_lines", "n_removed")]
    text = F.col(f"`{text_col}`").cast("string")
    same = F.col(f"`{id_col}`").eqNullSafe(F.col("_id")) & (F.xxhash64(text) == F.col("_key"))
    rest = F.array_join(F.filter(_lines(text), lambda line, i: ~F.array_contains("_gone", i)), "\n")
    kept = [F.when(F.col("_gone").isNotNull(), rest).otherwise(F.col(f"`{name}`")).alias(name) if name == text_col else F.col(f"`{name}`") for name in names]
    n_lines = F.when(text.isNull(), 0).otherwise(F.size(_lines(text))).cast("long")
    joined = docs.select(*(F.col(f"`{name}`") for name in names)).join(by_row, same, "left")
    return joined.select(*kept, n_lines.alias("n_lines"), F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_removed"))
