"""Message files that keep arriving are parsed once each and merged into the triage table.

A micro-batch is stored under its own number (``log/batch_id=N``), so that a repeated batch replaces
itself. When ``merge_every`` batches are open they are merged into a new version of the table
(``triage/version=N``, N being the last batch in it); in between, readers merge the few open batches
when they read. The wide table is thus not rewritten for each batch, and no path is read and written
at the same time. What is stored is found by listing the folders.

Which cells of a message are the latest is a matter of the messages, not of their arrival: those with
the latest date by the mail server count, and of equal ones those with the larger hash. So files may
come in any order and in any batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerline.operators.decode import decode_bodies, with_headers, with_parts
from ledgerline.operators.extract import intake_items
from ledgerline.operators.positions import number_rows, read_order
from ledgerline.operators.triage import MANAGED, TRIAGE_COLUMNS, triage_cells, upsert
from ledgerline.session import shuffles_removed


ORDER = ("sent_at", "cells_hash")
STORED = (*MANAGED, *ORDER)
BATCH_BITS = 40  # positions of a batch begin at its number times 2**40


class TriageStore:
    """``keep_versions`` older versions stay, for readers that have begun with them, and so do the
    batches after the oldest of them. Both settings may change from one start to the next."""

    def __init__(
        self, spark: SparkSession, root: str, merge_every: int = 16, keep_versions: int = 2
    ) -> None:
        self.spark, self.root = spark, root
        self.merge_every, self.keep_versions = max(1, merge_every), max(1, keep_versions)

    def batch_path(self, batch_id: int) -> str:
        return f"{self.root}/log/batch_id={batch_id}"

    def version_path(self, version: int) -> str:
        return f"{self.root}/triage/version={version}"

    def _files(self, path: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _numbers(self, folder: str) -> list[int]:
        """What is stored in a folder and complete, in order."""
        files, path = self._files(f"{self.root}/{folder}")
        found = [f.getPath() for f in files.listStatus(path)] if files.exists(path) else []
        done = [p for p in found if files.exists(self._files(f"{p}/_SUCCESS")[1])]
        return sorted(int(p.getName().rpartition("=")[2]) for p in done)

    def batches(self) -> list[int]:
        return self._numbers("log")

    def versions(self) -> list[int]:
        return self._numbers("triage")

    def _remove(self, path: str) -> None:
        files, target = self._files(path)
        files.delete(target, True)

    def _log(self, batches: list[int]) -> DataFrame:
        return self.spark.read.parquet(*[self.batch_path(b) for b in batches])

    def _table(self, version: int | None) -> DataFrame:
        if version is None:
            columns = ", ".join(f"`{c}` string" for c in (*TRIAGE_COLUMNS, *ORDER))
            return self.spark.createDataFrame([], f"row_idx long, {columns}")
        return self.spark.read.parquet(self.version_path(version))

    def _merged(self, version: int | None, batches: list[int]) -> DataFrame:
        """A version with later batches. Its own cells compete too, so late news of old mail lose."""
        table, news = self._table(version), self._log(batches)
        return upsert(table, news, order=ORDER, managed=STORED, own_positions=True, rivals=F.col("sent_at") != "")

    def add(self, cells: DataFrame, batch_id: int) -> None:
        """Store the cells of a batch, with ORDER and positions of its own; it may be empty."""
        cells.write.mode("overwrite").option("compression", "zstd").parquet(self.batch_path(batch_id))
        earlier = [v for v in self.versions() if v < batch_id]
        base = earlier[-1] if earlier else None
        news = [b for b in self.batches() if b <= batch_id and (base is None or b > base)]
        if len(news) < self.merge_every:
            return
        merged = self._merged(base, news)
        with shuffles_removed(self.spark):
            merged.write.mode("overwrite").option("compression", "zstd").parquet(self.version_path(batch_id))
        for version in earlier[: -self.keep_versions]:
            self._remove(self.version_path(version))
        if len(earlier) >= self.keep_versions:
            for batch in self.batches():
                if batch <= earlier[-self.keep_versions]:
                    self._remove(self.batch_path(batch))

    def current(self) -> DataFrame:
        """The table as of the last stored batch."""
        versions = self.versions()
        version = versions[-1] if versions else None
        news = [b for b in self.batches() if version is None or b > version]
        table = self._merged(version, news) if news else self._table(version)
        return table.drop(*ORDER)


def start_intake(
    spark: SparkSession,
    source: str,
    store: TriageStore,
    checkpoint: str,
    run_id: str,
    updated_at: str,
    files_per_batch: int | None = None,
) -> StreamingQuery:
    """Take in all message files (one JSON text per line) that have not been taken in yet.

    Batches run one after the other and each is stored under its own id, so a batch that is
    repeated after a failure gives the same result.
    """
    reader = spark.readStream
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    lines = read_order(reader.text(source).withColumnRenamed("value", "json"))

    def take_in(batch: DataFrame, batch_id: int) -> None:
        messages = number_rows(batch, start=F.lit(batch_id << BATCH_BITS))
        parsed = with_headers(decode_bodies(with_parts(messages)))
        items = intake_items(parsed, keep=("row_idx",))
        cells = triage_cells(items, run_id, updated_at, keep=("internal_date",))
        facts = [c for c in MANAGED if c not in ("last_run_id", "updated_at")]
        sent_at = F.coalesce(F.col("internal_date").try_cast("long"), F.lit(0))
        order = [sent_at.alias("sent_at"), F.xxhash64(*facts).alias("cells_hash")]
        store.add(cells.select("row_idx", *MANAGED, *order), batch_id)

    return (
        lines.writeStream.foreachBatch(take_in)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
