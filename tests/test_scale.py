"""How work is dealt: tasks grow with the rows, and decoding runs once for each message."""

import datetime
from pathlib import Path

import pytest

from checks import files, mail, triage
from ledgerline import derived
from ledgerline.session import shuffles_removed
from ledgerline.sources import readers

N = 60


@pytest.fixture
def folder(spark, tmp_path):
    day = datetime.datetime(2024, 5, 1)
    orders = [(i, i % 7, "F", 10.5 + i, day, "1-URGENT") for i in range(1, N + 1)]
    names = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"
    customers = [(i, f"Customer {i}", 1, 5.0, "BUILDING") for i in range(7)]
    spark.createDataFrame(orders, names).coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(customers, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("broadcast", ["10m", "-1"])
def test_tasks_on_mail_grow_with_its_rows(spark, folder, monkeypatch, broadcast):
    monkeypatch.setattr(derived, "ROWS_PER_TASK", 5)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        sizes = derived.mail(spark, folder).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sum(sizes) == N and len(sizes) >= N // 5 and max(sizes) < N // 3


@pytest.mark.parametrize("query", [mail.message_index, mail.message_index_counts])
def test_the_index_decodes_each_message_once(spark, folder, query):
    plan = query(spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1


def test_incoming_files_grow_with_the_mail(spark, folder, monkeypatch):
    monkeypatch.setattr(derived, "ROWS_PER_TASK", 5)
    written = []
    monkeypatch.setattr(files, "start_intake", lambda _, source, *args, files_per_batch, **kw: written.append((source, files_per_batch)) or _Done())
    files.stream_intake(spark, folder)
    (source, each), _ = written
    sizes = spark.read.text(source).selectExpr("_metadata.file_path AS file").groupBy("file").count().collect()
    assert each == 4 and len(sizes) > 6 and max(r["count"] for r in sizes) < N // 3
    assert sum(r["count"] for r in sizes) == N


def test_incoming_files_are_compressed_and_of_few_rows(spark, folder, monkeypatch):
    monkeypatch.setattr(derived, "ROWS_PER_TASK", 5)
    sources = []
    monkeypatch.setattr(files, "start_intake", lambda _, source, *args, **kw: sources.append(source) or _Done())
    files.stream_intake(spark, folder)
    sizes = spark.read.text(sources[0]).selectExpr("_metadata.file_path AS file").groupBy("file").count().collect()
    assert all(r["file"].endswith(".gz") and r["count"] <= 10 for r in sizes)
    assert sum(r["count"] for r in sizes) == N


def test_lines_of_messages_are_compressed_and_keep_their_order(spark, folder, monkeypatch):
    monkeypatch.setattr(derived, "ROWS_PER_TASK", 3)
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    orders.union(orders.where("o_orderkey = 7")).union(orders.selectExpr("11L", *orders.columns[1:]).limit(20)).coalesce(1).write.parquet(f"{folder}/more/orders.parquet")
    spark.read.parquet(f"{folder}/customer.parquet").write.parquet(f"{folder}/more/customer.parquet")
    read = files.messages_through_lines(spark, f"{folder}/more")
    found = [(r["row_idx"], r["subject"]) for r in read.orderBy("row_idx").collect()]
    keys = sorted([*range(1, N + 1), 7, *[11] * 20])
    shapes = [(i, 5 if k % 41 == 0 else 0, k) for i, k in enumerate(keys)]
    assert found == [(i, "" if shape == 5 else f"Request {k}") for i, shape, k in shapes]
    sizes = spark.read.text(sorted(read.inputFiles())).selectExpr("_metadata.file_path AS file").groupBy("file").count().collect()
    assert all(r["file"].endswith(".gz") and r["count"] <= 6 for r in sizes)


def test_rows_are_numbered_without_a_shuffle_of_their_texts(spark, tmp_path):
    (tmp_path / "a.txt").write_text("{}\n")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for a table estimated to be large
    try:
        plan = readers.read_messages(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_stored_attachments_are_cut_into_files_of_few_rows(spark, folder, monkeypatch):
    whole = sorted(triage.attachment_rows(spark, folder).collect())
    monkeypatch.setattr(triage, "SHORT_ROWS_PER_FILE", 5, raising=False)
    stored = triage.attachment_rows(spark, folder)
    sizes = stored.selectExpr("_metadata.file_path AS file").groupBy("file").count().collect()
    assert len(whole) > 20 and max(r["count"] for r in sizes) <= 5
    assert sorted(stored.collect()) == whole


def test_the_second_upsert_reads_what_was_parsed_for_the_first(spark, folder):
    again = triage.triage_upsert_again(spark, folder)
    assert not [f for f in again.inputFiles() if "orders" in f or "customer" in f]
    assert sorted(again.collect()) == sorted(triage.triage_upsert(spark, folder).select(again.columns).collect())


@pytest.mark.parametrize("before", [None, "false"])
def test_shuffle_files_of_a_write_do_not_stay(spark, tmp_path, before):
    def shuffle_files():
        local = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
        return {f for folder in local for f in Path(str(folder)).rglob("shuffle_*")}

    name, there = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", shuffle_files()
    if before is not None:
        spark.conf.set(name, before)
    usual = spark.conf.get(name, None)
    with shuffles_removed(spark):
        spark.range(1000).repartition(3, "id").write.parquet(f"{tmp_path}/dealt")
    assert spark.conf.get(name, None) == usual
    assert not shuffle_files() - there
    assert spark.read.parquet(f"{tmp_path}/dealt").count() == 1000
    spark.conf.unset(name)


class _Done:
    def awaitTermination(self):
        pass
