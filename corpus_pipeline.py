"""The training-data pipeline over ``documents``: stages that each write what they keep for the next one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerline.llm.stages import STAGES
from ledgerline.session import fresh_path, write_and_read

ORACLE_SQL = None  # the first stage is a trained classifier


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; every stage before it is stored in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *earlier, (_, last) = STAGES
    for name, stage in earlier:
        docs = write_and_read(stage(spark, docs, sf_dir), fresh_path(spark, f"pipeline-{name}"))
    return last(spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
