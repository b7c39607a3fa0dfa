"""Mailbox files against the standard library's reader, cut into splits of any size, and as a stream."""

import mailbox as standard
import os

import pytest
from ledgerline.sources import mailbox
from pyspark.sql import types as T

MESSAGES = T.StructType([
    T.StructField("n", T.LongType()),
    T.StructField("envelope", T.StringType()),
    T.StructField("headers", T.ArrayType(T.StructType([
        T.StructField("name", T.StringType()), T.StructField("value", T.StringType()),
    ]))),
    T.StructField("content", T.StringType()),
])

TRICKY = [
    "", "one line", "From the start\nFrom here\n>From there\n>>From everywhere", "a\n\nFrom b\n\n\nFrom c", "\nFrom", "Fro\nFrom \nm",
    "Größe: 12 ü\n\nsecond", "x" * 5000 + "\nFrom " + "y" * 5000, "\n\n\nlate", "From: not a separator\n\tFrom neither",
]


def plain(rows):
    return [(r["envelope"], [tuple(h) for h in r["headers"]], r["content"]) for r in rows]


def made(n=60):
    return [(f"u{i}@x.example Mon Jan  1 00:00:00 2026", [("Subject", f"no {i}"), ("X-Note", "a: b")], TRICKY[i % len(TRICKY)]) for i in range(n)]


@pytest.mark.parametrize("split", [150, 7777, 1 << 20])
def test_the_same_messages_for_any_split(spark, tmp_path, split):
    path = str(tmp_path / "box")
    wanted = made()
    df = spark.createDataFrame([(i, *m) for i, m in enumerate(wanted)], MESSAGES).coalesce(1).sortWithinPartitions("n")
    mailbox.write_mailbox(df.withColumnRenamed("n", "extra"), path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        found = mailbox.read_mailbox(spark, path).orderBy("row_idx").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["row_idx"] for r in found] == list(range(len(wanted)))
    assert plain(found) == [(e, h, c.rstrip("\n")) for e, h, c in wanted]


def test_as_the_standard_reader_finds_them(spark, tmp_path):
    text = (
        "From a@x.example Mon\nSubject: one\n two\n\tthree\nTo: d\n\nbody\n>From me\n\n"
        "From b@x.example Tue\nno colon here\nsubject: \n\n\n\nFrom c@x.example Wed\nSubject: all headers\n\n\n"
        "From d@x.example Thu\n\nlast, without a line end"
    )
    (tmp_path / "a.mbox").write_text(text)
    (tmp_path / "b.mbox").write_bytes(text.replace("\n", "\r\n").encode())
    (tmp_path / "c.mbox").write_text("")
    read = mailbox.read_mailbox(spark, str(tmp_path)).withColumn("subject", mailbox.header("SUBJECT")).orderBy("row_idx").collect()
    assert [r["row_idx"] for r in read] == list(range(8))
    for at in (0, 4):
        a, b, c, d = read[at:at + 4]
        assert (a["envelope"], a["subject"], a["content"]) == ("a@x.example Mon", "one two three", "body\nFrom me")
        assert [h["name"] for h in a["headers"]] == ["Subject", "To"]
        assert (b["subject"], b["content"], len(b["headers"])) == ("", "", 1)
        assert (c["subject"], c["content"], d["subject"], d["content"]) == ("all headers", "", None, "last, without a line end")
    assert len(standard.mbox(os.fspath(tmp_path / "a.mbox"), create=False)) == 4


def test_missing_parts_and_an_empty_table(spark, tmp_path):
    path = str(tmp_path / "box")
    mailbox.write_mailbox(spark.createDataFrame([(0, None, None, None), (1, "a\nb", [(None, None), ("H", "x\r\n y")], None)], MESSAGES).coalesce(1), path)
    found = plain(mailbox.read_mailbox(spark, path).orderBy("row_idx").collect())
    assert found == [("-", [], ""), ("a b", [("", ""), ("H", "x  y")], "")]
    mailbox.write_mailbox(spark.createDataFrame([], MESSAGES), path)
    assert mailbox.read_mailbox(spark, path).count() == 0


def test_files_that_come_in_as_a_stream(spark, tmp_path):
    path, wanted = tmp_path / "box", made(30)
    for i in range(3):
        df = spark.createDataFrame([(k, *m) for k, m in enumerate(wanted[i * 10:i * 10 + 10])], MESSAGES).coalesce(1)
        mailbox.write_mailbox(df, str(path / f"day={i}"))
    out = str(tmp_path / "out")
    for _ in range(2):  # a second start finds nothing new
        stream = mailbox.stream_mailbox(spark, str(path / "day=*"), files_per_batch=1).drop("in_file")
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start(out).awaitTermination()
    found = plain(spark.read.parquet(out).collect())
    assert sorted(found) == sorted((e, h, c.rstrip("\n")) for e, h, c in wanted)
