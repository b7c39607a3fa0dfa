"""Queries on histories: versions in force, overlaps, sessions, late streams, sketches, changes, newest rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline import derived
from ledgerline.operators import changes, overlaps, sketches, subtotals, timelines
from ledgerline.session import fresh_path, write_and_read
from ledgerline.streaming import runs as late

# A third of all lines and versions have one key.
HOT_KEY = "CASE WHEN {n} % 3 = 0 THEN 'default' ELSE {key} END"
LINES = {
    "line": "l_orderkey * 10 + l_linenumber",
    "rule": HOT_KEY.format(n="l_orderkey", key="concat(l_returnflag, l_linestatus)"),
    "shipped": "CASE WHEN l_linenumber = 7 THEN CAST(NULL AS TIMESTAMP) ELSE l_shipdate END",
}
VERSIONS = {
    "rule": HOT_KEY.format(n="o_custkey", key="concat(CASE o_orderstatus WHEN 'P' THEN 'N' WHEN 'F' THEN 'A' ELSE 'R' END, CASE WHEN o_custkey % 2 = 0 THEN 'O' ELSE 'F' END)"),
    "since": "o_orderdate",
    "least": "CAST(floor(o_totalprice) AS BIGINT)",
    "version": "o_orderkey",
}


def as_of_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Each line with the version of its rule that was in force when it was shipped."""
    lines = derived.read(spark, folder, "lineitem").select(*[F.expr(e).alias(n) for n, e in LINES.items()])
    versions = derived.read(spark, folder, "orders").select(*[F.expr(e).alias(n) for n, e in VERSIONS.items()])
    found = timelines.as_of(lines, versions, ["rule"], "shipped", "since", "in_force")
    return found.select("line", "rule", "shipped", "in_force.version", "in_force.least", "in_force.since")


# Intervals in milliseconds: runs of a day and of all days of a user, and steps of some seconds to hours.
SPANS = "CAST(floor(epoch(ts) * 1000) AS BIGINT)"


def _millis(column: str):
    return F.floor(F.col(column).cast("timestamp").cast("double") * 1000).cast("long")


def spans(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    events = derived.read(spark, folder, "events").withColumn("at", _millis("ts"))
    day = F.floor(F.col("at") / 86_400_000)
    runs = events.groupBy("user_id", day.alias("day")).agg(F.min("at").alias("start"), F.max("at").alias("end"))
    every = events.groupBy("user_id").agg(F.min("at").alias("start"), F.max("at").alias("end"))
    runs = runs.unionByName(every.withColumn("day", F.lit(-1).cast("long")))
    lasting = (F.floor(F.col("value")) * 60_000).cast("long")
    steps = events.select("user_id", "event_id", F.col("at").alias("start"), (F.col("at") + lasting).alias("end"))
    return runs, steps


def overlapping_runs(spark: SparkSession, folder: str) -> DataFrame:
    """How many steps of its user a run overlaps, and which first and last."""
    pairs = overlaps.overlap_join(*spans(spark, folder), ["user_id"])
    return pairs.groupBy("a.user_id", "a.day").agg(
        F.count(F.lit(1)).alias("steps"), F.min("b.event_id").alias("first_step"), F.max("b.event_id").alias("last_step")
    )


def visits(spark: SparkSession, folder: str) -> DataFrame:
    """Events of a user, a third of all those of one, with a minute as the unit of time."""
    return derived.read(spark, folder, "events").select(
        F.when(F.col("event_id") % 3 == 0, 0).otherwise(F.col("user_id")).alias("visitor"), "event_id",
        F.date_trunc("minute", F.col("ts").cast("timestamp")).alias("at"),
    )


def sessions_of_users(spark: SparkSession, folder: str) -> DataFrame:
    numbered = timelines.with_sessions(visits(spark, folder), ["visitor"], "at", 3600)
    return timelines.session_rows(numbered, ["visitor"], "at")


def late_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Steps come in four deliveries; a quarter of them one delivery late, and a tenth once more."""
    steps = derived.steps(spark, folder)
    clock = F.unix_timestamp(F.try_to_timestamp("started_at"))
    first, last = steps.agg(F.min(clock), F.max(clock)).first()
    length = (last - first) // 4 + 1 if first is not None else 1
    part = F.floor((clock - F.lit(first)) / length)
    number = F.col("step_position")
    delivery = part + F.when(number % 4 == 0, 1).otherwise(0)
    source, out, checkpoint = (fresh_path(spark, name) for name in ("late-steps", "late-runs", "late-checkpoint"))
    steps.limit(0).write.parquet(source)
    # An hour more, because a delivery ends with its last step; the last delivery is only a time.
    delay = f"{2 * length + 3600} seconds"
    runs = late.final_runs(late.read_steps(spark, source, steps.schema), delay)
    end = F.date_format(F.timestamp_seconds(F.lit((last or 0) + 3 * length + 10 * 86400)), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    tick = spark.range(1).select(*[end.alias(c) if c == "started_at" else F.lit(None).cast(t).alias(c) for c, t in steps.dtypes])
    deliveries = [steps.where((delivery == i) | ((number % 10 == 0) & (delivery == i - 1))) for i in range(6)]
    for rows in [*deliveries, tick]:
        rows.write.mode("append").parquet(source)
        late.take_in(runs, out, checkpoint).awaitTermination()
    return spark.read.schema(runs.schema).parquet(out)  # with the log of the stream: only what it has committed


def sketches_over_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Sketches are stored by day and merged by type of event; their errors are held against the exact figures."""
    events = derived.read(spark, folder, "events")
    by_day = sketches.sketches_of(events.withColumn("day", F.to_date("ts")), ["event_type", "day"], "user_id", "value")
    stored = write_and_read(by_day, fresh_path(spark, "sketches"))
    found = sketches.estimates(sketches.merged(stored, ["event_type"]), [0.5, 0.9])
    exact = events.groupBy("event_type").agg(F.count_distinct("user_id").alias("users"))
    ranks = events.join(found, "event_type").groupBy("event_type").agg(
        *[(F.count_if(F.col("value") <= F.col(q)) / F.count(F.lit(1))).alias(f"rank_{q}") for q in ("q50", "q90")]
    )
    both = found.join(exact, "event_type").join(ranks, "event_type")
    return both.select(
        "event_type", "rows", "users",
        (F.abs(F.col("distinct_estimate") - F.col("users")) <= F.greatest(F.lit(1), F.col("users") * 0.08)).alias("users_close"),
        *[(F.abs(F.col(f"rank_q{p}") - p / 100) <= 0.03).alias(f"q{p}_close") for p in (50, 90)],
    )


# Two versions of a table of orders: some rows gone, some new, some cells changed, some rows repeated.
def _version(name: str) -> dict[str, str]:
    new = name == "new"
    return {
        "o_orderkey": "o_orderkey",
        "status": "CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END" if new else "o_orderstatus",
        "price": "CASE WHEN o_orderkey % 11 = 0 THEN CAST(NULL AS BIGINT) ELSE CAST(floor(o_totalprice) AS BIGINT) END" if new else "CAST(floor(o_totalprice) AS BIGINT)",
    }


def versions(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    orders = derived.read(spark, folder, "orders")
    old, new = (orders.select(*[F.expr(e).alias(n) for n, e in _version(v).items()]) for v in ("old", "new"))
    key = F.col("o_orderkey")
    old = old.where(key % 13 != 0).unionByName(old.where(key % 17 == 0))
    new = new.where(key % 19 != 0).unionByName(new.where(key % 17 == 0)).unionByName(new.where(key % 34 == 0))
    return old, new


def table_changes(spark: SparkSession, folder: str) -> DataFrame:
    return changes.row_changes(*versions(spark, folder))


def table_cell_changes(spark: SparkSession, folder: str) -> DataFrame:
    return changes.cell_changes(changes.row_changes(*versions(spark, folder)), ["o_orderkey"])


def table_changes_applied(spark: SparkSession, folder: str) -> DataFrame:
    old, new = versions(spark, folder)
    stored = write_and_read(changes.row_changes(old, new), fresh_path(spark, "changes"))
    return changes.apply_changes(old, stored)


def newest_of_senders(spark: SparkSession, folder: str) -> DataFrame:
    """The three newest orders of each customer, a third of all orders being of one."""
    orders = derived.read(spark, folder, "orders").select(
        F.when(F.col("o_orderkey") % 3 == 0, 0).otherwise(F.col("o_custkey")).alias("sender"), "o_orderdate", "o_orderkey"
    )
    return changes.newest_of_each(orders, ["sender"], [F.col("o_orderdate").desc(), F.col("o_orderkey")], 3)


SUBTOTAL_SETS = [("flag", "line_status", "mode"), ("flag", "mode"), ("line_status",), ("mode",), ()]


def line_subtotals(spark: SparkSession, folder: str) -> DataFrame:
    """Lines by several sets of keys, some of them blank, with the distinct parts of each group."""
    lines = derived.read(spark, folder, "lineitem").select(
        F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("line_status"),
        F.when(F.col("l_linenumber") != 7, F.col("l_linenumber")).alias("mode"),
        F.when(F.col("l_suppkey") % 5 != 0, F.col("l_partkey")).alias("part"), F.floor("l_quantity").cast("long").alias("n"),
    )
    return subtotals.subtotals(lines, SUBTOTAL_SETS, "part", {"quantity": F.col("n")})


QUERIES = {
    f.__name__: f
    for f in (
        as_of_rules, overlapping_runs, sessions_of_users, late_runs, sketches_over_runs, table_changes,
        table_cell_changes, table_changes_applied, newest_of_senders, line_subtotals,
    )
}

# ---- SQL ---------------------------------------------------------------------------------------

from checks.runs import RUNS_SQL  # noqa: E402

_OLD = derived.select_sql(_version("old"), "orders")
_NEW = derived.select_sql(_version("new"), "orders")
_VERSIONS_SQL = f"""old_all AS ({_OLD}), new_all AS ({_NEW}),
old_rows AS (SELECT * FROM old_all WHERE o_orderkey % 13 <> 0 UNION ALL SELECT * FROM old_all WHERE o_orderkey % 17 = 0),
new_rows AS (SELECT * FROM new_all WHERE o_orderkey % 19 <> 0 UNION ALL SELECT * FROM new_all WHERE o_orderkey % 17 = 0
             UNION ALL SELECT * FROM new_all WHERE o_orderkey % 34 = 0)"""
_GONE = "(SELECT * FROM old_rows EXCEPT ALL SELECT * FROM new_rows)"
_CAME = "(SELECT * FROM new_rows EXCEPT ALL SELECT * FROM old_rows)"

ORACLES = {
    "line_subtotals": """SELECT flag, line_status, mode, CAST(grouping(flag, line_status, mode) AS INTEGER) AS grouping_id,
          count(*) AS rows, count(DISTINCT part) AS distinct_values, CAST(sum(n) AS BIGINT) AS quantity
        FROM (SELECT l_returnflag AS flag, l_linestatus AS line_status, CASE WHEN l_linenumber <> 7 THEN l_linenumber END AS mode,
                CASE WHEN l_suppkey % 5 <> 0 THEN l_partkey END AS part, CAST(floor(l_quantity) AS BIGINT) AS n FROM lineitem)
        GROUP BY GROUPING SETS ((flag, line_status, mode), (flag, mode), (line_status), (mode), ())""",
    "as_of_rules": f"""WITH lines AS ({derived.select_sql(LINES, "lineitem")}),
        versions AS (SELECT rule, since, max(struct_pack(least := least, version := version)) AS v
                     FROM ({derived.select_sql(VERSIONS, "orders")}) GROUP BY rule, since)
        SELECT line, l.rule, shipped, v.version, v.least, since
        FROM lines l ASOF LEFT JOIN versions v ON l.rule = v.rule AND l.shipped >= v.since""",
    "overlapping_runs": f"""WITH e AS (SELECT *, {SPANS} AS ms FROM events),
        a AS (SELECT user_id, CAST(floor(ms / 86400000) AS BIGINT) AS day, min(ms) AS s, max(ms) AS t FROM e GROUP BY ALL
              UNION ALL SELECT user_id, -1, min(ms), max(ms) FROM e GROUP BY user_id),
        b AS (SELECT user_id, event_id, ms AS s, ms + CAST(floor(value) AS BIGINT) * 60000 AS t FROM e)
        SELECT a.user_id, day, count(*) AS steps, min(event_id) AS first_step, max(event_id) AS last_step
        FROM a JOIN b ON a.user_id = b.user_id AND a.s <= b.t AND b.s <= a.t GROUP BY a.user_id, day""",
    "sessions_of_users": """WITH v AS (SELECT CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id END AS visitor, date_trunc('minute', ts) AS minute FROM events),
        g AS (SELECT *, coalesce(epoch(minute) - epoch(lag(minute) OVER (PARTITION BY visitor ORDER BY minute)) > 3600, TRUE) AS begins FROM v),
        s AS (SELECT *, sum(begins::INT) OVER (PARTITION BY visitor ORDER BY minute RANGE UNBOUNDED PRECEDING) AS session FROM g)
        SELECT visitor, CAST(session AS BIGINT) AS session, count(*) AS events, min(minute) AS started_at, max(minute) AS finished_at FROM s GROUP BY ALL""",
    "late_runs": f"WITH {RUNS_SQL} SELECT * FROM runs",
    "sketches_over_runs": """SELECT event_type, count(*) AS rows, count(DISTINCT user_id) AS users,
        TRUE AS users_close, TRUE AS q50_close, TRUE AS q90_close FROM events GROUP BY event_type""",
    "table_changes": f"""WITH {_VERSIONS_SQL}
        SELECT *, 'removed' AS change, count(*) AS copies FROM {_GONE} GROUP BY ALL
        UNION ALL SELECT *, 'added', count(*) FROM {_CAME} GROUP BY ALL""",
    "table_cell_changes": f"""WITH {_VERSIONS_SQL}, gone AS {_GONE}, came AS {_CAME},
        single AS (SELECT o_orderkey FROM (SELECT o_orderkey, 1 AS o, 0 AS n FROM gone UNION ALL SELECT o_orderkey, 0, 1 FROM came)
                   GROUP BY o_orderkey HAVING sum(o) = 1 AND sum(n) = 1),
        both_rows AS (SELECT g.*, c.status AS new_status, c.price AS new_price FROM gone g JOIN came c USING (o_orderkey) JOIN single USING (o_orderkey))
        SELECT o_orderkey, 'status' AS "column", status AS old, new_status AS new FROM both_rows WHERE status IS DISTINCT FROM new_status
        UNION ALL SELECT o_orderkey, 'price', CAST(price AS VARCHAR), CAST(new_price AS VARCHAR) FROM both_rows WHERE price IS DISTINCT FROM new_price""",
    "table_changes_applied": f"WITH {_VERSIONS_SQL} SELECT * FROM new_rows",
    "newest_of_senders": """WITH o AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_custkey END AS sender, o_orderdate, o_orderkey FROM orders)
        SELECT *, CAST(row_number() OVER (PARTITION BY sender ORDER BY o_orderdate DESC, o_orderkey) AS INTEGER) AS rank
        FROM o QUALIFY row_number() OVER (PARTITION BY sender ORDER BY o_orderdate DESC, o_orderkey) <= 3""",
}
