"""Export the audit of all runs below a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators.audit import run_bundles, run_step_rows
from ledgerline.sources.readers import read_run_summaries
from ledgerline.sources.writers import write_csv, write_jsonl


def export(
    spark: SparkSession, runs_dir: str, out: str, fmt: str = "csv", run_id: str | None = None
) -> DataFrame:
    """Write one row per step as csv, or nested runs as json. ``run_id`` picks one run."""
    if fmt not in ("csv", "json"):
        raise ValueError(f"unsupported format: {fmt}")
    runs, steps = read_run_summaries(spark, runs_dir)
    if run_id is not None:
        runs, steps = (df.where(F.col("run_id") == run_id) for df in (runs, steps))
    if fmt == "csv":
        rows = run_step_rows(runs, steps)
        write_csv(rows.orderBy("run_id", "step_position").drop("step_position"), out)
        return rows
    bundles = run_bundles(runs, steps)
    write_jsonl(bundles, out, order=("run_id", "chunk"))
    return bundles
