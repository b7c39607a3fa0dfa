"""Arrow batches in slices of bounded size, and the texts in them."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE_BYTES = 8 << 20

_KEPT: dict[str, Callable[[], None]] = {}


def keeps(module: str, give_up: Callable[[], None]) -> None:
    """Says how to give up what an operator keeps in a Python worker from task to task."""
    _KEPT[module] = give_up


def begin_task(module: str) -> None:
    """Gives up what other operators keep in this worker. Workers outlive tasks and stages, and would hold it all at once."""
    for other, give_up in _KEPT.items():
        if other != module:
            give_up()


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns that a text operator reads, as ``id`` and ``body`` (bytes), whatever else ``df`` holds."""
    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("body"))


def slices(batch: pa.RecordBatch, column: str = "body", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with about ``limit`` bytes of ``column`` each, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(sizes) - sizes) // limit
    starts = np.flatnonzero(np.diff(part, prepend=-1))
    for start, end in zip(starts, [*starts[1:], batch.num_rows], strict=True):
        yield batch.slice(int(start), int(end - start))


def bodies(batch: pa.RecordBatch, column: str = "body") -> list[bytes]:
    """The bytes of each row, empty for null."""
    return [body or b"" for body in batch.column(column).to_pylist()]


def texts(batch: pa.RecordBatch, column: str = "body") -> list[str]:
    """The text of each row, empty for null; bytes that are not UTF-8 become replacement characters."""
    return [body.decode("utf-8", "replace") for body in bodies(batch, column)]


def map_slices(df: DataFrame, function: Callable[[pa.RecordBatch], dict], schema: str, column: str = "body", limit: int = SLICE_BYTES) -> DataFrame:
    """``function`` over slices of the Arrow batches; it returns the columns of ``schema`` by name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task(function.__module__)
        for batch in batches:
            for part in slices(batch, column, limit):
                yield pa.RecordBatch.from_pydict(function(part))

    return df.mapInArrow(run, schema)


def groups(batches: Iterable[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """The rows of each group in one table. ``keys`` are longs without nulls, and the rows of a group come together."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = [batch.column(key).to_numpy() for key in keys]
        changes = np.zeros(batch.num_rows, bool)
        for column in values:
            changes[1:] |= column[1:] != column[:-1]
        starts = [0, *np.flatnonzero(changes).tolist(), batch.num_rows]
        for start, end in zip(starts, starts[1:], strict=False):
            own = tuple(column[start] for column in values)
            if held and own != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, end - start))
            last = own
    if held:
        yield pa.Table.from_batches(held)
