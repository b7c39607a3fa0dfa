"""Audit of runs and their steps.

runs:  run_id, workflow, status, started_at, finished_at, duration_ms, error_summary
steps: run_id, step_position, step_name, status, started_at, finished_at, duration_ms,
       error_summary, metrics (JSON text or NULL)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.positions import with_rank

STEP_COLUMNS = (
    "step_name", "status", "started_at", "finished_at", "duration_ms", "error_summary", "metrics",
)
DEALS = 16  # tasks that share the steps of one run


def sorted_json(text: Column) -> Column:
    """JSON with sorted keys and a space after each comma and colon. Empty for NULL."""
    compact = F.to_json(F.try_parse_json(text))
    # A separator, after anything that is not one; quoted texts are passed over as a whole. Each match
    # starts where the last one ended, and so never inside a quoted text.
    unit = r'\G((?:[^",:]++|"(?:[^"\\]++|\\.)*+")*+)([,:])'
    return F.coalesce(F.regexp_replace(compact, unit, "$1$2 "), F.lit(""))


def run_step_rows(runs: DataFrame, steps: DataFrame) -> DataFrame:
    """One row per step, with the fields of its run."""
    run = runs.select(
        "run_id",
        "workflow",
        F.col("status").alias("run_status"),
        F.col("started_at").alias("run_started_at"),
        F.col("finished_at").alias("run_finished_at"),
        F.col("duration_ms").alias("run_duration_ms"),
    )
    step = steps.select(
        "run_id",
        "step_position",
        "step_name",
        F.col("status").alias("step_status"),
        F.col("started_at").alias("step_started_at"),
        F.col("finished_at").alias("step_finished_at"),
        F.col("duration_ms").alias("step_duration_ms"),
        F.col("error_summary").alias("step_error_summary"),
        sorted_json(F.col("metrics")).alias("step_metrics"),
    )
    # A run may hold a large share of all steps: its row is repeated, and its steps are dealt.
    dealt = step.withColumn("deal", F.pmod(F.xxhash64("step_position"), F.lit(DEALS)))
    repeated = run.withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(DEALS - 1).cast("long"))))
    return repeated.join(dealt, ["run_id", "deal"]).select(
        *run.columns, *[c for c in step.columns if c != "run_id"]
    )


def run_bundles(runs: DataFrame, steps: DataFrame, steps_per_row: int = 10_000) -> DataFrame:
    """Each run with its steps in order, nested. A run takes a row for each ``steps_per_row`` of its
    steps, counted within the run and numbered by ``chunk``, so that no group is collected without
    a bound. Runs meet their steps by run and chunk, which is unique on both sides. ``steps`` is read twice."""
    ranked = with_rank(steps, "step_position", "step_rank", ["run_id"])
    entry = F.struct("step_position", *STEP_COLUMNS)
    chunks = ranked.groupBy(
        "run_id", F.floor(F.col("step_rank") / steps_per_row).alias("chunk")
    ).agg(F.array_sort(F.collect_list(entry)).alias("steps"))
    run = runs.select("run_id", F.struct(*runs.columns).alias("run"))
    counted = steps.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_steps"))
    last = F.greatest(F.lit(0), F.ceil(F.coalesce("n_steps", F.lit(0)) / steps_per_row) - 1).cast("long")
    wanted = run.join(counted, "run_id", "left").select(
        "run_id", "run", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("chunk")
    )
    return wanted.join(chunks, ["run_id", "chunk"], "left").select(
        "run_id",
        "chunk",
        "run",
        F.coalesce("steps", F.array().cast(chunks.schema["steps"].dataType)).alias("steps"),
    )


def run_files(runs: DataFrame, steps: DataFrame, steps_per_file: int = 10_000) -> DataFrame:
    """What `writers.write_run_summaries` writes: ``run_id``, ``first`` (the place in the run of the first step),
    ``n_steps`` (of the whole run), ``steps_per_file``, and ``run`` and ``steps`` as JSON texts, a row for each file of steps."""
    counted = steps.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_steps"))
    known = runs.join(counted, "run_id", "left")
    entry = F.transform("steps", lambda s: s.dropFields("step_position").withField("metrics", F.try_parse_json(s["metrics"])))
    return run_bundles(known, steps, steps_per_file).select(
        "run_id",
        (F.col("chunk") * steps_per_file).alias("first"),
        F.coalesce("run.n_steps", F.lit(0).cast("long")).alias("n_steps"),
        F.lit(steps_per_file).cast("long").alias("steps_per_file"),
        F.to_json(F.col("run").dropFields("n_steps")).alias("run"),
        F.to_json(entry).alias("steps"),
    )


def run_status_columns() -> list[Column]:
    """The aggregates that make a run of its steps."""
    failed = F.col("status") == "FAILED"
    start, finish = F.try_to_timestamp(F.min("started_at")), F.try_to_timestamp(F.max("finished_at"))
    return [
        F.when(F.max(failed), "FAILED").otherwise("OK").alias("status"),
        F.min("started_at").alias("started_at"),
        F.max("finished_at").alias("finished_at"),
        F.greatest(F.lit(0), F.unix_millis(finish) - F.unix_millis(start)).alias("duration_ms"),
        F.min_by(
            F.when(failed, F.col("error_summary")), F.when(failed, F.col("step_position"))
        ).alias("error_summary"),
    ]


def run_status(steps: DataFrame) -> DataFrame:
    """Runs from their steps: FAILED if a step failed, from the first start to the last finish."""
    return steps.groupBy("run_id").agg(*run_status_columns())


def unmatched_runs(runs: DataFrame, steps: DataFrame) -> DataFrame:
    """Run ids of which either the run summary or the step summaries are missing."""
    run_ids = runs.select("run_id").distinct()
    step_ids = steps.select("run_id").distinct()
    no_steps = run_ids.join(step_ids, "run_id", "left_anti").select(
        "run_id", F.lit("steps").alias("missing")
    )
    no_run = step_ids.join(run_ids, "run_id", "left_anti").select(
        "run_id", F.lit("run").alias("missing")
    )
    return no_steps.unionByName(no_run)
