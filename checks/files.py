"""Queries that go through files and streams, in the shared folder of the session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import mail as mail_checks
from checks import sheets, triage
from ledgerline import derived
from ledgerline.operators import decode, positions
from ledgerline.session import fresh_path, shuffles_removed
from ledgerline.sources import mailbox, readers, writers
from ledgerline.streaming.intake import TriageStore, start_intake


def sheet_through_csv(spark: SparkSession, folder: str) -> DataFrame:
    """A sheet is written as CSV twice, the second time in its place, and read with positions."""
    path = fresh_path(spark, "sheet")
    sheet = derived.messy_sheet(spark, folder).orderBy("row_idx").drop("row_idx")
    writers.write_csv(sheet, path)
    writers.write_csv(sheet, path)
    return readers.read_sheet(spark, path).select(
        "row_idx", *[F.coalesce(c, F.lit("")).alias(c) for c in sheet.columns]
    )


def ragged_rows(spark: SparkSession, folder: str) -> DataFrame:
    orders = derived.read(spark, folder, "orders")
    cells = F.slice(
        F.array(F.col("o_orderkey").cast("string"), "o_orderstatus",
                F.when(F.col("o_custkey") % 2 == 0, F.col("o_orderpriority")), F.lit("x")),
        1, (F.col("o_orderkey") % 5).cast("int"),
    )
    table = readers.rectangular(orders.select("o_orderkey", cells.alias("cells")))
    return table.select("o_orderkey", F.array_join("cells", "|").alias("cells"))


def write_lines(messages: DataFrame, path: str) -> None:
    """JSON messages as compressed lines. Such a file is read by one task, so it holds a bounded number of them."""
    lines = messages.select("json").write.option("compression", "gzip")
    with shuffles_removed(messages.sparkSession):
        lines.option("maxRecordsPerFile", 2 * derived.ROWS_PER_TASK).text(path)


def messages_through_lines(spark: SparkSession, folder: str) -> DataFrame:
    path = fresh_path(spark, "messages")
    # Put in order while the rows are short.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), derived.tasks_by_rows(spark, folder))
    write_lines(derived.messages(derived.mail(spark, folder, ranges=tasks)), path)
    read = decode.with_headers(decode.with_parts(readers.read_messages(spark, path)))
    return read.select("row_idx", "message_id", "thread_id", "subject")


def mail_through_mailbox(spark: SparkSession, folder: str) -> DataFrame:
    """The mail is written as mailbox files and read with its headers; some bodies hold lines that look like separators."""
    path = fresh_path(spark, "mailbox")
    mail = derived.mail(spark, folder)
    headers = [F.struct(F.lit(n).alias("name"), F.col(c).cast("string").alias("value")) for n, c in (
        ("Message-ID", "message_id"), ("From", "from"), ("To", "to"), ("Subject", "subject"), ("X-Row", "row_idx"))]
    content = F.when(F.col("row_idx") % 3 == 0, F.concat(F.lit("From the desk\n\n>From Monday on\n"), F.col("body"))).otherwise(F.col("body"))
    mailbox.write_mailbox(mail.select(F.concat_ws(" ", "thread_id", "date").alias("envelope"), F.array(*headers).alias("headers"), content.alias("content")), path)
    return mailbox.read_mailbox(spark, path).select(
        mailbox.header("x-row").cast("long").alias("key"), "envelope", mailbox.header("message-id").alias("message_id"),
        mailbox.header("from").alias("sender"), mailbox.header("subject").alias("subject"), "content",
    )


def items_through_jsonl(spark: SparkSession, folder: str) -> DataFrame:
    path = fresh_path(spark, "items")
    writers.write_jsonl(mail_checks.items_without_bodies(spark, folder), path)
    return spark.read.schema(
        "message_id string, subject string, reference_id string, parser_confidence double"
    ).json(path)


def table_overwritten(spark: SparkSession, folder: str) -> DataFrame:
    """A table is written twice; the second time replaces the first."""
    path = fresh_path(spark, "table")
    orders = derived.read(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    writers.write_table(orders.unionByName(orders), path)
    writers.write_table(orders, path)
    return spark.read.parquet(path)


def manifest_appended(spark: SparkSession, folder: str) -> DataFrame:
    """Two runs add to one manifest."""
    path = fresh_path(spark, "manifest")
    for _ in range(2):
        writers.append_jsonl(triage.attachment_manifest(spark, folder), path)
    rows = spark.read.schema("filename string, status string, size long").json(path)
    return rows.groupBy("filename", "status").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes")
    )


def runs_kept_apart(spark: SparkSession, folder: str) -> DataFrame:
    """Two runs, of which the first is repeated: it replaces its own rows only."""
    path = fresh_path(spark, "runs")
    orders = derived.read(spark, folder, "orders")
    by_status = orders.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("rows"))
    by_priority = orders.groupBy(F.col("o_orderpriority").alias("o_orderstatus")).agg(
        F.count(F.lit(1)).alias("rows")
    )
    writers.write_run_partition(by_priority, path, "run-a")
    writers.write_run_partition(by_priority, path, "run-b")
    writers.write_run_partition(by_status, path, "run-a")
    return spark.read.parquet(path).select("run_id", "o_orderstatus", "rows")


def output_catalog(spark: SparkSession, folder: str) -> DataFrame:
    base = fresh_path(spark, "catalog")
    catalog = writers.OutputCatalog(f"{base}/outputs", sheets.RUN_ID, sheets.NOW)
    orders = derived.read(spark, folder, "orders")
    catalog.write(orders, "orders_jsonl", "jsonl", f"{base}/orders", tab="raw")
    catalog.write(orders.where("o_orderstatus = 'F'"), "finished_csv", "csv", f"{base}/finished")
    found = spark.read.parquet(f"{base}/outputs")
    return found.select(
        F.col("run_id").cast("string").alias("run_id"), "name", "type", "created_at", "metadata"
    )


def dense_positions(spark: SparkSession, folder: str) -> DataFrame:
    """Dense ranks of sparse positions, over the whole table and per group."""
    lines = derived.read(spark, folder, "lineitem").select(
        (F.col("l_orderkey") * 3_000_000 + F.col("l_linenumber")).alias("position"), "l_returnflag"
    ).distinct()
    lines = lines.groupBy("position").agg(F.max("l_returnflag").alias("l_returnflag"))
    ranked = positions.with_rank(lines, "position", "rank")
    return positions.with_rank(ranked, "position", "flag_rank", ["l_returnflag"])


def stream_intake(spark: SparkSession, folder: str) -> DataFrame:
    """The mail arrives as files, is taken in batch by batch, and ends up in the triage table."""
    base = fresh_path(spark, "stream")
    # Three batches, of as many files as tasks of a bounded size write.
    files = max(1, -(-derived.tasks_by_rows(spark, folder) // 3))
    messages = derived.messages(derived.mail(spark, folder, ranges=3 * files))
    write_lines(messages, f"{base}/incoming")
    store = TriageStore(spark, f"{base}/store", merge_every=2)
    for _ in range(2):  # a second start finds nothing new
        start_intake(
            spark, f"{base}/incoming", store, f"{base}/checkpoint", "run-1", sheets.NOW,
            files_per_batch=files,
        ).awaitTermination()
    return store.current().select(
        "message_id", "thread_id", "subject", "name", "invoice_or_order_id",
        "confidence", "status",
    )


QUERIES = {
    f.__name__: f
    for f in (
        sheet_through_csv, ragged_rows, messages_through_lines, mail_through_mailbox, items_through_jsonl,
        table_overwritten, manifest_appended, runs_kept_apart, output_catalog, dense_positions, stream_intake,
    )
}

_SHEET_CELLS = ", ".join(
    f"coalesce({c}, '') AS {c}" for c in ('id', '"date"', 'description', 'amount', 'category', 'paid')
)
ORACLES = {
    "sheet_through_csv": f"""WITH {sheets.CELLS_SQL} SELECT row_idx, {_SHEET_CELLS} FROM sheet""",
    "ragged_rows": """SELECT o_orderkey,
          CASE WHEN o_orderkey % 5 > 0 THEN CAST(o_orderkey AS VARCHAR) ELSE '' END || '|' ||
          CASE WHEN o_orderkey % 5 > 1 THEN o_orderstatus ELSE '' END || '|' ||
          CASE WHEN o_orderkey % 5 > 2 AND o_custkey % 2 = 0 THEN o_orderpriority ELSE '' END || '|' ||
          CASE WHEN o_orderkey % 5 > 3 THEN 'x' ELSE '' END AS cells FROM orders""",
    "messages_through_lines": f"""WITH {mail_checks.DECODED_SQL}
        SELECT row_idx, message_id, thread_id, subject FROM decoded""",
    "mail_through_mailbox": f"""WITH {mail_checks.MAIL_SQL}
        SELECT CAST(row_idx AS BIGINT) AS key, thread_id || ' ' || "date" AS envelope, message_id, "from" AS sender, subject,
          CASE WHEN row_idx % 3 = 0 THEN 'From the desk' || chr(10) || chr(10) || '>From Monday on' || chr(10) ELSE '' END || body AS content
        FROM mail""",
    "items_through_jsonl": f"""WITH {mail_checks.PARSED_ITEMS_SQL}
        SELECT message_id, subject, reference_id, confidence AS parser_confidence FROM parsed""",
    "table_overwritten": "SELECT o_orderkey, o_orderstatus FROM orders",
    "manifest_appended": f"""WITH {triage.CONTENT_SQL}
        SELECT filename, status, 2 * count(*) AS rows, CAST(2 * sum(size) AS BIGINT) AS bytes
        FROM routed WHERE status <> 'ERROR' GROUP BY ALL""",
    "runs_kept_apart": """SELECT 'run-a' AS run_id, o_orderstatus, count(*) AS rows FROM orders GROUP BY ALL
        UNION ALL SELECT 'run-b', o_orderpriority, count(*) FROM orders GROUP BY ALL""",
    "output_catalog": f"""SELECT '{sheets.RUN_ID}' AS run_id, 'orders_jsonl' AS name, 'jsonl' AS type, '{sheets.NOW}' AS created_at,
          '{{"rows": ' || count(*) || ', "tab": "raw"}}' AS metadata FROM orders
        UNION ALL SELECT '{sheets.RUN_ID}', 'finished_csv', 'csv', '{sheets.NOW}', '{{"rows": ' || count(*) || '}}'
        FROM orders WHERE o_orderstatus = 'F'""",
    "dense_positions": """WITH lines AS (
          SELECT l_orderkey * 3000000 + l_linenumber AS position, max(l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1)
        SELECT position, l_returnflag, row_number() OVER (ORDER BY position) - 1 AS rank,
               row_number() OVER (PARTITION BY l_returnflag ORDER BY position) - 1 AS flag_rank FROM lines""",
    "stream_intake": f"""WITH {mail_checks.PARSED_ITEMS_SQL},
        latest AS (SELECT arg_max(p, CAST(internal_date AS BIGINT)) AS n FROM parsed p WHERE message_id <> '' GROUP BY message_id)
        SELECT n.message_id AS message_id, n.thread_id AS thread_id, n.subject AS subject,
          coalesce(n.customer_name, '') AS name, coalesce(n.reference_id, '') AS invoice_or_order_id,
          CASE WHEN n.confidence = 0 THEN '' ELSE CAST(n.confidence AS VARCHAR) END AS confidence, 'NEW' AS status
        FROM latest""",
}
