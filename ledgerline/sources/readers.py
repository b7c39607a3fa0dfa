"""Readers: sheets, messages and run summaries, each with the position of its rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ledgerline.operators.audit import unmatched_runs
from ledgerline.operators.positions import with_file_position


class MissingSummary(RuntimeError):
    """A run has no run summary or no step summaries."""


def read_sheet(
    spark: SparkSession, path: str | list[str], columns: Sequence[str] | None = None,
    multiline: bool = False,
) -> DataFrame:
    """A CSV sheet with a header row: all cells as text, short rows filled up with NULL, and
    ``row_idx``. Set ``multiline`` only for files whose cells hold line breaks, because such a
    file is read by one task."""
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", multiline)
    if columns is None:
        columns = reader.csv(path).columns
    schema = StructType([StructField(c, StringType()) for c in columns])
    scan = reader.option("enforceSchema", True).schema(schema).csv(path)
    return with_file_position(scan, "row_idx")


def rectangular(df: DataFrame, cells: str = "cells", width: int | None = None) -> DataFrame:
    """Ragged rows given as arrays: all as wide as the widest, NULL as empty text."""
    widest = F.lit(width) if width is not None else df.agg(F.max(F.size(cells))).scalar()
    padded = F.transform(
        F.sequence(F.lit(0), F.col("widest") - 1),
        lambda i: F.coalesce(F.get(F.col(cells), i).cast("string"), F.lit("")),
    )
    filled = F.when(F.col("widest") > 0, padded).otherwise(F.col(cells))
    return df.withColumn("widest", widest).withColumn(cells, filled).drop("widest")


def read_messages(spark: SparkSession, path: str | list[str], one_per_file: bool = False) -> DataFrame:
    """Messages as JSON texts, one per line or one per file: ``row_idx`` and ``json``."""
    scan = spark.read.text(path, wholetext=one_per_file).withColumnRenamed("value", "json")
    return with_file_position(scan, "row_idx", broadcast=not one_per_file)


def newest(messages: DataFrame, predicate: Column, recency: str, max_messages: int = 50) -> DataFrame:
    """The most recent messages that match, at least one and at most ``max_messages``."""
    wanted = messages.where(predicate)
    return wanted.orderBy(F.desc(recency)).limit(max(1, max_messages))


_RUN = (
    "run_id string, workflow string, status string, started_at string, finished_at string, "
    "duration_ms long, error_summary string"
)
_STEPS = (
    "array<struct<step_name:string,status:string,started_at:string,finished_at:string,"
    "duration_ms:bigint,error_summary:string,metrics:variant>>"
)


PACKED_FILES = "run_id string, name string, text string, pack int"


def read_run_summaries(spark: SparkSession, runs_dir: str, check: bool = True, packed: bool = False) -> tuple[DataFrame, DataFrame]:
    """All runs below a folder: ``<run>/run.json`` and ``<run>/steps.json`` (a list of steps);
    a long run has its later steps, from place N on, in ``<run>/steps-N.json``. With ``packed`` they are the rows of
    shared files, as `writers.write_run_summaries` writes them."""
    if packed:
        files = spark.read.schema(PACKED_FILES).parquet(runs_dir)
        runs = files.where("name = 'run.json'").select("run_id", F.from_json("text", _RUN).alias("run"))
        runs = runs.select(F.coalesce("run.run_id", "run_id").alias("run_id"), F.col("run").dropFields("run_id").alias("run")).select("run_id", "run.*")
        texts = files.where("name != 'run.json'").withColumn("file", F.concat(F.lit("/"), "name"))
    else:
        run_of_file = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)
        runs = spark.read.schema(_RUN).json(f"{runs_dir}/*/run.json", multiLine=True)
        runs = runs.withColumn("run_id", F.coalesce("run_id", run_of_file))
        # Read as text, because the position of a step is its place in the list of its file.
        texts = spark.read.text(f"{runs_dir}/*/steps{{,-*}}.json", wholetext=True)
        texts = texts.select(run_of_file.alias("run_id"), F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    first = F.coalesce(F.regexp_extract("file", r"/steps-(\d+)\.json$", 1).try_cast("int"), F.lit(0))
    listed = texts.select("run_id", first.alias("first"), F.from_json("text", _STEPS).alias("steps"))
    steps = listed.select("run_id", "first", F.posexplode("steps").alias("place", "step")).select(
        "run_id", (F.col("first") + F.col("place")).alias("step_position"), "step.*"
    )
    steps = steps.withColumn("metrics", F.to_json("metrics"))
    if check:
        lost = unmatched_runs(runs, listed).orderBy("run_id").limit(5).collect()
        if lost:
            shown = ", ".join(f"{r['run_id']} has no {r['missing']}.json" for r in lost)
            raise MissingSummary(f"missing summaries: {shown}")
    return runs, steps
