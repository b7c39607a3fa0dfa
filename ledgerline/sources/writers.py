"""Writers. All go through Spark's commit protocol; reruns replace, and never mix with, old rows."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

import pyarrow as pa
import pyarrow.fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ledgerline.session import fresh_path, write_and_read
from ledgerline.sources.readers import PACKED_FILES


def write_table(df: DataFrame, path: str) -> None:
    """Replace a whole table."""
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Replace a set of CSV files with a header each; cells are written as they are."""
    df.write.mode("overwrite").options(
        header=True, escape='"', emptyValue="", ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    ).csv(path)


def _sorted_keys(df: DataFrame) -> DataFrame:
    return df.select(*sorted(df.columns))


def write_jsonl(df: DataFrame, path: str, order: Sequence[str] = ()) -> None:
    """Replace a file set of JSON lines, keys sorted, NULL written out."""
    rows = df.orderBy(*order) if order else df
    _sorted_keys(rows).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_back(df: DataFrame, kind: str, path: str) -> DataFrame:
    """What was written for ``df`` as csv, jsonl or parquet, with its columns and types."""
    reader = df.sparkSession.read.schema(df.schema)
    if kind == "csv":
        return reader.options(header=True, escape='"', enforceSchema=False, emptyValue="").csv(path)
    if kind == "jsonl":
        return reader.json(path)
    return reader.parquet(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("ignoreNullFields", False).json(path)


def write_run_partition(df: DataFrame, path: str, run_id: str) -> None:
    """Store the rows of one run. A rerun replaces its own rows; other runs stay."""
    (
        df.withColumn("run_id", F.lit(run_id))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_id")
        .parquet(path)
    )


PACKS = 64


def write_run_summaries(files: DataFrame, path: str, packed: bool = False) -> DataFrame:
    """Write each run as ``<run_id>/run.json`` and ``<run_id>/steps.json`` below ``path``, a URI that
    all tasks reach, and return the files of steps written (``run_id``, ``first``).

    ``files`` is what `audit.run_files` gives. The steps of a long run are in several files, written by
    several tasks: those from place N on in ``steps-N.json``. The files of a run are replaced by a rerun,
    and those that it no longer has are removed. To be written by the caller's action, once.

    A folder with two files takes three blocks of disk, however short its run is. ``packed`` writes the same files
    as rows of shared ones, at once, for many short runs.
    """
    if packed:
        return _write_packed(files, path)

    def write(batches):
        store, place = pyarrow.fs.FileSystem.from_uri(path)
        for batch in batches:
            for run_id, first, n_steps, size, run, steps in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                folder = f"{place}/{run_id}"
                store.create_dir(folder, recursive=True)
                texts = {f"steps-{first}" if first else "steps": steps}
                if not first:
                    texts["run"] = run
                    for old in store.get_file_info(pyarrow.fs.FileSelector(folder)):
                        number = re.fullmatch(r"steps-(\d+)\.json", old.base_name)
                        if number and (int(number[1]) >= n_steps or int(number[1]) % size):
                            store.delete_file(old.path)
                for name, text in texts.items():
                    with store.open_output_stream(f"{folder}/{name}.json") as out:
                        out.write(text.encode())
            yield pa.RecordBatch.from_pydict({"run_id": batch.column(0), "first": batch.column(1)})

    return files.select("run_id", "first", "n_steps", "steps_per_file", "run", "steps").mapInArrow(write, "run_id string, first long")


def _write_packed(files: DataFrame, path: str) -> DataFrame:
    """The files of runs as rows (``run_id``, ``name``, ``text``) of Parquet files, dealt to folders by the hash of the
    run. The folders of the runs written are replaced, with the other runs that are in them."""
    spark = files.sparkSession
    number = F.when(F.col("first") > 0, F.concat(F.lit("-"), F.col("first").cast("string"))).otherwise("")
    of_steps = F.struct(F.concat(F.lit("steps"), number, F.lit(".json")).alias("name"), F.col("steps").alias("text"))
    of_run = F.struct(F.lit("run.json").alias("name"), F.col("run").alias("text"))
    pack = F.pmod(F.xxhash64("run_id"), F.lit(PACKS)).cast("int").alias("pack")
    new = write_and_read(files, fresh_path(spark, "run-files"))  # all columns: Spark's pruning of the nested run fails
    named = F.inline(F.when(F.col("first") > 0, F.array(of_steps)).otherwise(F.array(of_run, of_steps)))
    # As among folders, a run without id is called None, and of runs with one id the files of one are kept.
    rows = new.withColumn("run_id", F.coalesce("run_id", F.lit("None"))).select("run_id", pack, named)
    rows = rows.select("run_id", "name", "text", "pack").dropDuplicates(["run_id", "name"])
    try:
        old = spark.read.schema(PACKED_FILES).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
    else:
        others = old.join(rows.select("pack").distinct(), "pack", "left_semi").join(rows.select("run_id").distinct(), "run_id", "left_anti")
        kept = others.select("run_id", "name", "text", "pack")
        rows = rows.unionByName(write_and_read(kept, fresh_path(spark, "run-files")))
    # A pack is one task's, but for the later files of long runs, which may be most of it.
    dealt = rows.repartition("pack", F.when(F.col("name").rlike(r"-\d+\.json$"), F.pmod(F.xxhash64("name"), F.lit(PACKS))))
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("pack").parquet(path)
    return new.select("run_id", "first")


CATALOG_SCHEMA = (
    "run_id string, name string, type string, path string, created_at string, metadata string"
)


class OutputCatalog:
    """The list of what a run has written. Row counts come from the write itself."""

    def __init__(self, path: str, run_id: str, created_at: str) -> None:
        self.path, self.run_id, self.created_at = path, run_id, created_at

    def write(self, df: DataFrame, name: str, kind: str, path: str, **metadata: object) -> int:
        """Write ``df`` as csv, jsonl or parquet, and register it with its number of rows."""
        seen = Observation()
        observed = df.observe(seen, F.count(F.lit(1)).alias("rows"))
        {"csv": write_csv, "jsonl": write_jsonl, "parquet": write_table}[kind](observed, path)
        rows = seen.get["rows"]
        self.register(df, name, kind, path, rows=rows, **metadata)
        return rows

    def register(self, df: DataFrame, name: str, kind: str, path: str, **metadata: object) -> None:
        record = (
            self.run_id, name, kind, path, self.created_at, json.dumps(metadata, sort_keys=True)
        )
        entry = df.sparkSession.createDataFrame([record], CATALOG_SCHEMA).coalesce(1)
        # An entry has a partition of its own, which a rerun replaces.
        entry.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            "run_id", "name"
        ).parquet(self.path)
