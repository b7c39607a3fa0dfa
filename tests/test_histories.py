"""Versions in force, overlaps, sessions, changes, sketches and late streams against plain Python."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import audit, changes, overlaps, sketches, timelines
from ledgerline.streaming import runs as late


@pytest.fixture
def many_parts(spark):
    """Sort partitions of a few rows, so that keys go on over several of them."""
    conf = {"spark.sql.shuffle.partitions": "7", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def test_as_of_with_a_hot_key_ties_and_blanks(many_parts):
    rng = random.Random(1)
    key = lambda: rng.choice(["hot", "hot", "a", "b", None])
    time = lambda: rng.choice([None, *range(60)])
    left = [(i, key(), time()) for i in range(300)]
    right = [(key(), time(), rng.randrange(5)) for _ in range(90)]
    found = timelines.as_of(
        many_parts.createDataFrame(left, "id int, k string, at int"),
        many_parts.createDataFrame(right, "k string, since int, v int"), ["k"], "at", "since",
    )
    expected = {}
    for i, k, at in left:
        fitting = [(s, v) for other, s, v in right if k is not None and other == k and at is not None and s is not None and s <= at]
        expected[i] = max(fitting) if fitting else None
    assert {r["id"]: r["found"] and (r["found"]["since"], r["found"]["v"]) for r in found.collect()} == expected
    assert found.columns == ["id", "k", "at", "found"]


def test_as_of_without_versions(spark):
    left = spark.createDataFrame([(1, "a", 3)], "id int, k string, at int")
    right = spark.createDataFrame([], "k string, since int")
    assert timelines.as_of(left, right, ["k"], "at", "since").first()["found"] is None
    assert timelines.as_of(left.limit(0), right, ["k"], "at", "since").count() == 0


def test_sessions_go_on_over_partitions(many_parts):
    rng = random.Random(2)
    rows = [(rng.choice(["hot", "hot", "x", None]), rng.choice([None, *range(0, 4000, 7)])) for _ in range(400)]
    df = many_parts.createDataFrame(rows, "who string, s long").select("who", F.timestamp_seconds("s").alias("at"))
    found = timelines.with_sessions(df, ["who"], "at", 30)
    per = defaultdict(list)
    for who, s in rows:
        per[who].append(s)
    expected = Counter()
    for who, times in per.items():
        session, last = 0, "none yet"
        for s in sorted(times, key=lambda s: (s is not None, s)):
            begins = last == "none yet" or (s is not None and (last is None or s - last > 30))
            session, last = session + begins, s
            expected[who, s, session] += 1
    got = Counter((r["who"], r["s"], r["session"]) for r in found.select("who", F.unix_timestamp("at").alias("s"), "session").collect())
    assert got == expected


def test_no_window_sees_a_whole_key(many_parts):
    df = many_parts.range(1000).select(F.lit("hot").alias("k"), F.col("id").alias("at"), F.when(F.col("id") % 50 == 0, F.col("id")).alias("v"))
    ordered = timelines.in_order(df, ["k", "at"])
    parts = ordered.groupBy(F.shiftright("pos", timelines.PART_BITS).alias("part")).count()
    assert parts.count() == 7 and parts.agg(F.max("count")).first()[0] < 500
    found = timelines.with_last(ordered, ["k"], F.col("v"), "last", with_own=True)
    assert found.where("last != at - at % 50").count() == 0


def test_overlaps_of_short_and_long_intervals(spark):
    rng = random.Random(3)

    def intervals(n):
        out = []
        for i in range(n):
            start = rng.randrange(-2000, 2000)
            length = rng.choice([0, 1, 3, 50, 500, 10**7, 10**12, -4])
            out.append((i, rng.choice(["hot", "x", None]), None if rng.random() < 0.05 else start, start + length))
        return out

    left, right = intervals(120), intervals(90)
    schema = "id int, k string, start long, end long"
    pairs = overlaps.overlap_join(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["k"])
    ok = lambda r: r[1] is not None and r[2] is not None and r[2] <= r[3]
    expected = sorted((a[0], b[0]) for a in left for b in right if ok(a) and ok(b) and a[1] == b[1] and a[2] <= b[3] and b[2] <= a[3])
    assert sorted((r["a"]["id"], r["b"]["id"]) for r in pairs.collect()) == expected
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_long_intervals_take_two_bins_of_a_level(spark):
    one = spark.createDataFrame([(1, "k", 5, 5 + 10**12)], "id int, k string, start long, end long")
    assert overlaps._in_bins(one, ["k"], "start", "end", "a", [], True).count() <= 2
    assert overlaps.overlap_join(one, one.limit(0), ["k"]).count() == 0


def test_changes_lead_from_one_version_to_the_next(spark):
    rng = random.Random(4)
    rows = lambda n: [(rng.randrange(30), rng.choice(["a", "b", None])) for _ in range(n)]
    old, new = rows(200), rows(180)
    one, two = (spark.createDataFrame(r, "id int, v string") for r in (old, new))
    delta = changes.row_changes(one, two)
    assert Counter(tuple(r) for r in changes.apply_changes(one, delta).collect()) == Counter(new)
    gone, came = Counter(old) - Counter(new), Counter(new) - Counter(old)
    assert {(*r[:3], r[3]) for r in delta.collect()} == {(*k, "removed", n) for k, n in gone.items()} | {(*k, "added", n) for k, n in came.items()}
    cells = changes.cell_changes(delta, ["id"]).collect()
    single = [i for i in range(30) if sum(n for k, n in gone.items() if k[0] == i) == 1 == sum(n for k, n in came.items() if k[0] == i)]
    assert sorted(r["id"] for r in cells) == single and all(r["column"] == "v" and r["old"] != r["new"] for r in cells)
    assert changes.row_changes(one, one).count() == 0


def test_newest_rows_are_cut_before_and_after_the_shuffle(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("who"), (F.col("id") % 7).alias("at"), "id")
    top = changes.newest_of_each(df, ["who"], [F.col("at").desc(), F.col("id")], 2)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "Partial" in plan and plan.count("WindowGroupLimit") >= 2
    assert [(r["id"], r["rank"]) for r in top.where("who = 0").orderBy("rank").collect()] == [(6, 1), (27, 2)]


def test_merged_sketches_are_those_of_all_rows(spark):
    df = spark.range(20_000).select((F.col("id") % 10).alias("run"), (F.col("id") % 700).alias("user"), F.col("id").cast("double").alias("x"))
    by_run = sketches.sketches_of(df, ["run"], "user", "x")
    row = sketches.estimates(sketches.merged(by_run), [0.5, 0.9]).first()
    assert row["rows"] == 20_000 and abs(row["distinct_estimate"] - 700) < 0.08 * 700
    assert abs(row["q50"] - 10_000) < 0.03 * 20_000 and abs(row["q90"] - 18_000) < 0.03 * 20_000


STEP = "run_id string, step_position long, step_name string, status string, started_at string, finished_at string, duration_ms long, error_summary string, metrics string"


def steps_of(days, per_day):
    rng = random.Random(5)
    out = []
    for n in range(days * per_day):
        day = n // per_day
        at = f"2026-01-{day + 1:02d}T{rng.randrange(24):02d}:00:00Z"
        failed = rng.random() < 0.1
        out.append((f"run-{day}-{rng.randrange(3)}", n, "s", "FAILED" if failed else "OK", at, at, 1, f"at {n}" if failed else None, None))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_late_and_repeated_steps_give_the_rows_of_all_at_once(spark, tmp_path, seed):
    rng = random.Random(seed)
    steps = steps_of(8, 12)
    # Each step arrives up to two days late, some twice.
    arrivals = [(int(s[4][8:10]) + rng.randrange(3), s) for s in steps] + [(int(s[4][8:10]) + 2, s) for s in steps if rng.random() < 0.2]
    tick = (None, None, None, None, "2026-03-01T00:00:00Z", None, None, None, None)
    source, out, checkpoint = (str(tmp_path / name) for name in ("in", "out", "checkpoint"))
    schema = spark.createDataFrame([], STEP).schema
    spark.createDataFrame([], STEP).write.parquet(source)
    runs = late.final_runs(late.read_steps(spark, source, schema), "4 days")
    for day in sorted({day for day, _ in arrivals}) + ["end"]:
        rows = [tick] if day == "end" else [s for d, s in arrivals if d == day]
        rng.shuffle(rows)
        spark.createDataFrame(rows, STEP).repartition(3).write.mode("append").parquet(source)
        query = late.take_in(runs, out, checkpoint)
        query.awaitTermination()
    found = spark.read.schema(runs.schema).parquet(out)
    expected = audit.run_status(spark.createDataFrame(steps, STEP))
    assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, expected.collect()), key=str)
    # Only what belongs to the last sign of time is left, nothing of the steps.
    assert all(state.numRowsTotal <= 1 for state in query.lastProgress.stateOperators)
