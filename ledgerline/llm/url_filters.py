"""URL filters over time: dated list entries become validity intervals, captures meet those valid when fetched.

An entry adds a host, a domain or a path prefix to a list, or takes it away, from some moment on. The as-of join
works by key and day: inside a day the last interval begun is found in order of time, and what holds at the
beginning of a day is worked out from one row for each key and day. So no pair of captures and entries is
formed, and a host with a third of all captures or entries is spread over its days.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerline.session import fresh_path, write_and_read

KEY = ["list", "kind", "pattern"]
SITE = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?"
FOREVER = 1 << 60


def host_of(url: Column) -> Column:
    """The host in lower case, empty for what is not an absolute URL."""
    return F.lower(F.regexp_extract(url, SITE, 1))


def path_of(url: Column) -> Column:
    """The path without query and fragment, ``/`` if there is none."""
    path = F.regexp_extract(url, SITE + r"([^?#]*)", 2)
    return F.when(path == "", F.lit("/")).otherwise(path)


def keys_of(url: Column) -> Column:
    """All (kind, pattern) that an entry for this URL can have.

    ``host``: the host; ``domain``: the host and each domain above it; ``prefix``: host and path up to each slash,
    and the whole path.
    """
    host, path = host_of(url), path_of(url)
    labels, steps = F.split(host, r"\."), F.split(path, "/")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    folders = F.transform(F.sequence(F.lit(1), F.greatest(F.size(steps) - 1, F.lit(1))), lambda i: F.concat(host, F.array_join(F.slice(steps, F.lit(1), i), "/"), F.lit("/")))
    prefixes = F.array_distinct(F.concat(folders, F.array(F.concat(host, path))))

    def of_kind(kind: str, patterns: Column) -> Column:
        return F.transform(patterns, lambda pattern: F.struct(F.lit(kind).alias("kind"), pattern.alias("pattern")))

    keys = F.concat(of_kind("host", F.array(host)), of_kind("domain", domains), of_kind("prefix", prefixes))
    return F.when(host != "", keys)


def _day(seconds: Column, day: int) -> Column:
    return F.floor(seconds / day).cast("long")


def validity_intervals(entries: DataFrame, day: int = 86_400) -> DataFrame:
    """``list``, ``kind``, ``pattern``, ``valid_from``, ``valid_to`` of what was added, in seconds since 1970.

    An interval ends at the next entry for its key, whichever it is; without one it stays open. Of entries for
    one key and moment one counts, an addition before a removal. Entries with a null in any column have no effect.
    The next entry is looked for inside the day, and for the last one of a day among the first ones of days.
    """
    known = entries.select(*KEY, F.col("effective_at").cast("long").alias("at"), (F.col("action") == "add").alias("on")).dropna()
    known = known.groupBy(*KEY, "at").agg(F.max("on").alias("on")).withColumn("day", _day(F.col("at"), day))
    inside = known.withColumn("next", F.lead("at").over(Window.partitionBy(*KEY, "day").orderBy("at")))
    days = known.groupBy(*KEY, "day").agg(F.min("at").alias("first"))
    days = days.withColumn("next_day", F.lead("first").over(Window.partitionBy(*KEY).orderBy("day"))).drop("first")
    both = inside.join(days, [*KEY, "day"])
    return both.where("on").select(*KEY, F.col("at").alias("valid_from"), F.coalesce("next", "next_day", F.lit(FOREVER)).alias("valid_to"))


def active_entries(captures: DataFrame, entries: DataFrame, day: int = 86_400) -> DataFrame:
    """``id``, ``url``, ``at`` and the key of each list entry valid for a capture when it was fetched.

    ``captures`` has ``id``, ``url``, ``at`` (seconds) without repetitions.
    """
    spark = captures.sparkSession
    intervals = write_and_read(validity_intervals(entries, day).withColumn("day", _day(F.col("valid_from"), day)), fresh_path(spark, "url-intervals"))
    asked = captures.withColumn("key", F.explode(keys_of(F.col("url")))).select("id", "url", "at", "key.kind", "key.pattern")
    asked = asked.where(F.col("at").isNotNull()).join(intervals.select(*KEY).distinct(), ["kind", "pattern"]).withColumn("day", _day(F.col("at"), day))
    asked = write_and_read(asked.select("id", "url", "at", *KEY, "day"), fresh_path(spark, "url-asked"))
    begun = intervals.select(F.lit(None).cast(captures.schema["id"].dataType).alias("id"), F.lit(None).cast("string").alias("url"), F.col("valid_from").alias("at"), *KEY, "day", "valid_to", F.lit(0).alias("later"))
    timeline = begun.unionByName(asked.withColumns({"valid_to": F.lit(None).cast("long"), "later": F.lit(1)}))
    in_time = Window.partitionBy(*KEY, "day").orderBy("at", "later").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = timeline.withColumn("until", F.last("valid_to", ignorenulls=True).over(in_time)).where("later = 1")
    last = intervals.groupBy(*KEY, "day").agg(F.max("valid_from").alias("valid_from")).join(intervals, [*KEY, "day", "valid_from"]).select(*KEY, "day", "valid_to")
    days = last.unionByName(asked.select(*KEY, "day").distinct().withColumn("valid_to", F.lit(None).cast("long")))
    days = days.groupBy(*KEY, "day").agg(F.max("valid_to").alias("valid_to"))
    before = Window.partitionBy(*KEY).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select(*KEY, "day", F.last("valid_to", ignorenulls=True).over(before).alias("carried")).where("carried IS NOT NULL")
    found = inside.join(days, [*KEY, "day"], "left").where(F.col("at") < F.coalesce("until", "carried"))
    return found.select("id", "url", "at", *KEY)


def evaluate(captures: DataFrame, entries: DataFrame, allow_lists: Sequence[str] = (), id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched_at", day: int = 86_400) -> DataFrame:
    """Per capture: id, url, ``seconds`` (its time), ``n_active`` (entries valid when it was fetched), ``allowed``, ``blocked``.

    A capture is blocked if an entry of a list that is not in ``allow_lists`` was valid and none of those was. A
    null or relative URL and a capture without time match nothing. Each row is answered, repeated ones alike; ids
    may be null. Other columns are not read. ``entries`` has ``list``, ``kind``, ``pattern``, ``action`` (``add``
    or anything else for a removal) and ``effective_at``; see `validity_intervals`. Without entries nothing is
    blocked. The same key in several lists counts for each.
    """
    rows = captures.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(time_col).cast("long").alias("at"))
    active = active_entries(rows.distinct(), entries, day)
    allows = F.col("list").isin(*allow_lists) if allow_lists else F.lit(False)
    counts = active.groupBy(F.col("id").alias("_id"), F.col("url").alias("_url"), F.col("at").alias("_at")).agg(F.count("*").alias("n_active"), F.max(allows).alias("allowed"), F.max(~allows).alias("listed"))
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("url") == F.col("_url")) & (F.col("at") == F.col("_at"))
    joined = rows.join(counts, same, "left")
    allowed = F.coalesce("allowed", F.lit(False))
    return joined.select(F.col("id").alias(id_col), F.col("url").alias(url_col), F.col("at").alias("seconds"), F.coalesce("n_active", F.lit(0)).alias("n_active"), allowed.alias("allowed"), (F.coalesce("listed", F.lit(False)) & ~allowed).alias("blocked"))
