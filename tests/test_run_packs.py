"""Files of many short runs in shared files."""

import datetime
import os

from pyspark.sql import functions as F

from checks import runs as run_checks
from ledgerline.operators import audit
from ledgerline.sources import readers, writers

RUN = "run_id string, workflow string, status string, started_at string, finished_at string, duration_ms long, error_summary string"
STEP = "run_id string, step_position int, step_name string, status string, started_at string, finished_at string, duration_ms long, error_summary string, metrics string"


def test_reruns_replace_their_packed_files_and_no_others(spark, tmp_path):
    def write(lengths, steps_per_file):
        runs = spark.createDataFrame([(r, "w", "OK", "a", "b", 1, None) for r in lengths], RUN)
        steps = spark.createDataFrame([(r, 10 * i, f"s{i}", "OK", "a", "b", i, None, '{"n":%d}' % i) for r, n in lengths.items() for i in range(n)], STEP)
        written = writers.write_run_summaries(audit.run_files(runs, steps, steps_per_file), f"file://{tmp_path}/runs", packed=True)
        assert written.count() == sum(max(1, -(-n // steps_per_file)) for n in lengths.values())

    def read():
        runs, steps = readers.read_run_summaries(spark, f"{tmp_path}/runs", packed=True)
        rows = audit.run_step_rows(runs, steps).orderBy("run_id", "step_position").collect()
        assert all(r.step_name == f"s{r.step_position}" and r.step_metrics == '{"n": %d}' % r.step_position for r in rows)
        assert all((r.workflow, r.run_status, r.run_duration_ms) == ("w", "OK", 1) for r in rows)
        assert runs.count() == runs.select("run_id").distinct().count()
        return {r["run_id"]: r["n"] for r in steps.groupBy("run_id").agg(F.count("*").alias("n")).collect()}

    short = {f"s{i}": 1 + i % 3 for i in range(150)}
    write({"long": 23} | short, 5)
    names = {r.name for r in spark.read.schema(readers.PACKED_FILES).parquet(f"{tmp_path}/runs").where("run_id = 'long'").collect()}
    assert names == {"run.json", "steps.json", "steps-5.json", "steps-10.json", "steps-15.json", "steps-20.json"}
    assert read() == {"long": 23} | short
    write({"long": 9, "s7": 0, "new": 2}, 4)
    names = {r.name for r in spark.read.schema(readers.PACKED_FILES).parquet(f"{tmp_path}/runs").where("run_id = 'long'").collect()}
    assert names == {"run.json", "steps.json", "steps-4.json", "steps-8.json"}
    assert read() == {k: v for k, v in short.items() if k != "s7"} | {"long": 9, "new": 2}


def test_runs_without_id_and_runs_given_twice(spark, tmp_path):
    runs = spark.createDataFrame([(r, "w", "OK", "a", "b", 1, None) for r in (None, "a", "a")], RUN)
    steps = spark.createDataFrame([(r, i, f"s{i}", "OK", "a", "b", i, None, None) for r in (None, "a") for i in range(3)], STEP)
    files = audit.run_files(runs, steps, 2)
    found = []
    for packed in (False, True, True):
        path = f"{tmp_path}/{packed}"
        assert writers.write_run_summaries(files, f"file://{path}", packed=packed).distinct().count() == 3
        read = readers.read_run_summaries(spark, path, packed=packed)
        found.append((sorted(read[0].collect()), sorted(audit.run_step_rows(*read).collect())))
    assert found[0] == found[1] == found[2] and len(found[0][0]) == 2 and len(found[0][1]) == 3


def test_files_do_not_grow_with_the_number_of_runs(spark, tmp_path, monkeypatch):
    def written(n):
        folder = tmp_path / str(n)
        times = [(i, i, datetime.datetime(2024, 5, 1, 0, 0, i % 60), "click", 5.0, '{"a":1}') for i in range(n)]
        spark.createDataFrame(times, "event_id long, user_id long, ts timestamp, event_type string, value double, props string").coalesce(1).write.parquet(f"{folder}/events.parquet")
        monkeypatch.setattr(run_checks, "fresh_path", lambda _, name: f"{folder}/{name}")
        assert run_checks.runs_through_files(spark, str(folder)).count() == n
        return sum(len(files) for _, _, files in os.walk(folder / "runs"))

    few, many = written(300), written(900)
    assert many < 900 and many <= 1.3 * few
