"""Subtotals over sets of keys, and the files of long runs."""

from collections import defaultdict
from itertools import product

from pyspark.sql import functions as F

from ledgerline.operators import audit, subtotals
from ledgerline.sources import readers, writers


def test_subtotals_equal_plain_counting(spark):
    rows = [(a, b, v, n) for n, (a, b, v) in enumerate(product(["x", None], [1, 2, None], [7, 8, None]))] * 3
    sets = [("a", "b"), ("b",), ("a",), (), ("b",)]
    found = subtotals.subtotals(spark.createDataFrame(rows, "a string, b int, v int, n int"), sets, "v", {"total": F.col("n")})
    plain = defaultdict(list)
    for a, b, v, n in rows:
        for one in set(sets):
            plain["a" in one and a, "b" in one and b, 2 * ("a" not in one) + ("b" not in one)].append((v, n))
    want = {
        (a or None, b or None, g): (len(held), len({v for v, _ in held} - {None}), sum(n for _, n in held))
        for (a, b, g), held in plain.items()
    }
    assert {(r.a, r.b, r.grouping_id): (r["rows"], r.distinct_values, r.total) for r in found.collect()} == want
    assert found.count() == len(want)


def test_a_group_of_all_rows_is_dealt_by_value(spark):
    lines = spark.range(1000).selectExpr("'all' AS k", "id AS v")
    plan = subtotals.subtotals(lines, [("k",), ()], "v", {})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("partial_count") >= 1 and "hashpartitioning(k#" in plan and "_value" in plan.split("hashpartitioning(k#")[1]


def test_subtotals_of_nothing(spark):
    assert subtotals.subtotals(spark.createDataFrame([], "k string, v int"), [("k",), ()], "v", {}).count() == 0


RUN = "run_id string, workflow string, status string, started_at string, finished_at string, duration_ms long, error_summary string"
STEP = "run_id string, step_position int, step_name string, status string, started_at string, finished_at string, duration_ms long, error_summary string, metrics string"


def test_long_runs_are_in_several_files_and_reruns_replace_them(spark, tmp_path):
    def write(lengths, steps_per_file):
        runs = spark.createDataFrame([(r, "w", "OK", "a", "b", 1, None) for r in lengths], RUN)
        steps = spark.createDataFrame([(r, 10 * i, f"s{i}", "OK", "a", "b", i, None, '{"n":%d}' % i) for r, n in lengths.items() for i in range(n)], STEP)
        writers.write_run_summaries(audit.run_files(runs, steps, steps_per_file), f"file://{tmp_path}").collect()

    def read():
        runs, steps = readers.read_run_summaries(spark, str(tmp_path))
        rows = audit.run_step_rows(runs, steps).orderBy("run_id", "step_position").collect()
        assert all(r.step_name == f"s{r.step_position}" and r.step_metrics == '{"n": %d}' % r.step_position for r in rows)
        return {r["run_id"]: r["n"] for r in steps.groupBy("run_id").agg(F.count("*").alias("n")).collect()}

    write({"long": 23, "short": 2}, 5)
    names = sorted(f.name for f in (tmp_path / "long").iterdir() if f.suffix == ".json" and not f.name.startswith("."))
    assert names == ["run.json", "steps-10.json", "steps-15.json", "steps-20.json", "steps-5.json", "steps.json"]
    assert read() == {"long": 23, "short": 2}
    write({"long": 9, "short": 0}, 4)
    assert sorted(f.name for f in (tmp_path / "long").glob("*.json")) == ["run.json", "steps-4.json", "steps-8.json", "steps.json"]
    assert read() == {"long": 9}
