"""Mailbox files: messages one after another as plain text, each behind a line that begins with "From ".

A message is a record of Spark's text source that ends where a line break and "From " follow. Files are
therefore cut anywhere into splits, a message that crosses a border is read by the task of the split it begins in,
and the same reader serves streams. Lines of a message that begin with "From " carry a ">" in front, and one more
if they already do, so that reading gives them back as they were.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators.positions import with_file_position

# Fixed value: what stands between two messages of a mailbox file.
SEPARATOR = "\nFrom "


def _parsed(record: Column) -> dict[str, Column]:
    text = F.regexp_replace(F.regexp_replace(record, "\\r(\\n|\\z)", "\n"), "^From ", "")
    head = F.substring_index(text, "\n\n", 1)
    content = F.rtrim(F.substr(text, F.length(head) + 3), F.lit("\n"))
    envelope = F.substring_index(head, "\n", 1)
    lines = F.regexp_replace(F.substr(head, F.length(envelope) + 2), "\n[ \\t]+", " ")
    headers = F.transform(
        F.filter(F.split(lines, "\n"), lambda line: F.contains(line, F.lit(":"))),
        lambda line: F.struct(
            F.trim(F.substring_index(line, ":", 1)).alias("name"),
            F.trim(F.substr(line, F.instr(line, ":") + 1)).alias("value"),
        ),
    )
    return {
        "envelope": envelope,
        "headers": headers,
        "content": F.regexp_replace(content, "(?<![^\\n])>(>*From )", "$1"),
    }


def _with_messages(records: DataFrame) -> DataFrame:
    kept = [F.col(c) for c in records.columns if c != "value"]
    return records.select(*kept, *[column.alias(name) for name, column in _parsed(F.col("value")).items()])


def read_mailbox(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The messages of mailbox files, in file order: ``row_idx``, ``envelope`` (sender and date of the
    separating line), ``headers`` (name and value, in their order, folded lines joined) and ``content``.

    Files begin with their first message; empty files have none. Line ends become a line feed, and those at
    the end of a message are left out. Header lines without a colon are skipped. A message without an empty line is
    all headers. A single message is one value and has to fit into one (2 GB).
    """
    scan = spark.read.text(path, lineSep=SEPARATOR)
    return _with_messages(with_file_position(scan, "row_idx"))


def stream_mailbox(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """The messages of mailbox files as they come into a folder: ``in_file`` and the columns of ``read_mailbox``
    but for the position, which a stream has no use for."""
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_batch)
    scan = reader.text(path, lineSep=SEPARATOR)
    return _with_messages(scan.select("value", F.col("_metadata.file_path").alias("in_file")))


def header(name: str, headers: str = "headers") -> Column:
    """The first header of that name, in either case; NULL where there is none."""
    return F.get(F.filter(F.col(headers), lambda h: F.lower(h["name"]) == name.lower()), 0)["value"]


def write_mailbox(messages: DataFrame, path: str) -> None:
    """Replace a folder of mailbox files by ``messages`` with the columns of ``read_mailbox``; others are left out.

    Line breaks within envelopes and headers become blanks. What is NULL counts as empty, and a message
    without an envelope gets "-" there.
    """
    def one_line(c: Column) -> Column:
        return F.regexp_replace(F.coalesce(c, F.lit("")), "[\\r\\n]+", " ")

    envelope = one_line(F.col("envelope"))
    listed = F.transform(
        F.coalesce("headers", F.array().cast(messages.schema["headers"].dataType)),
        lambda h: F.concat(one_line(h["name"]), F.lit(": "), one_line(h["value"]), F.lit("\n")),
    )
    quoted = F.regexp_replace(F.coalesce("content", F.lit("")), "(?<![^\\n])(>*From )", ">$1")
    record = F.concat(
        F.lit("From "), F.when(envelope == "", "-").otherwise(envelope), F.lit("\n"),
        F.array_join(listed, ""), F.lit("\n"), quoted, F.lit("\n"),
    )
    messages.select(record.alias("value")).write.mode("overwrite").text(path)
