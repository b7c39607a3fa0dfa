"""Sheets, mail and run records derived from the given tables, for the registered queries, the
tests and the bench.

The expressions are plain SQL that Spark and an ANSI engine evaluate alike, so that a check can
start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_CENTS = "CAST(round(o_totalprice * 100) AS BIGINT)"
_WHOLE = f"CAST(floor({_CENTS} / 100) AS BIGINT)"
_FRACTION = f"lpad(CAST({_CENTS} % 100 AS STRING), 2, '0')"
PLAIN_AMOUNT = f"concat(CAST({_WHOLE} AS STRING), '.', {_FRACTION})"
COMMA_AMOUNT = (
    f"CASE WHEN {_WHOLE} >= 1000 THEN concat(CAST(CAST(floor({_WHOLE} / 1000) AS BIGINT) AS STRING), ',', "
    f"lpad(CAST({_WHOLE} % 1000 AS STRING), 3, '0'), '.', {_FRACTION}) ELSE {PLAIN_AMOUNT} END"
)
_Y = "CAST(year(o_orderdate) AS STRING)"
_M = "lpad(CAST(month(o_orderdate) AS STRING), 2, '0')"
_D = "lpad(CAST(day(o_orderdate) AS STRING), 2, '0')"

# A sheet with blanks, repeated ids, three date formats and numbers that are none.
MESSY_SHEET = {
    "row_idx": "o_orderkey",
    "id": "CASE WHEN o_orderkey % 11 = 0 THEN '' WHEN o_orderkey % 13 = 0 THEN '  ' "
    "WHEN o_orderkey % 7 = 0 THEN concat('A-', CAST(o_orderkey - 1 AS STRING)) "
    "ELSE concat(' A-', CAST(o_orderkey AS STRING)) END",
    "date": "CASE WHEN o_orderkey % 17 = 0 THEN '2026-02-30' WHEN o_orderkey % 19 = 0 THEN '' "
    f"WHEN o_orderkey % 3 = 0 THEN concat_ws('-', {_Y}, {_M}, {_D}) "
    f"WHEN o_orderkey % 3 = 1 THEN concat_ws('/', {_D}, {_M}, {_Y}) "
    f"ELSE concat(' ', concat_ws('/', {_M}, {_D}, {_Y})) END",
    "description": "CASE WHEN o_orderkey % 23 = 0 THEN '   ' "
    "ELSE concat('  ', o_orderpriority, '   it', chr(39), 's  a-b', chr(9), 'ROW ') END",
    "amount": "CASE WHEN o_orderkey % 29 = 0 THEN 'abc' WHEN o_orderkey % 31 = 0 THEN ' ' "
    "WHEN o_orderkey % 37 = 0 THEN '1d' "
    f"WHEN o_orderkey % 2 = 0 THEN concat(' ', {COMMA_AMOUNT}) ELSE {PLAIN_AMOUNT} END",
    "category": "CASE WHEN o_orderkey % 5 = 0 THEN CAST(NULL AS STRING) ELSE o_orderstatus END",
    "paid": "CASE o_orderkey % 6 WHEN 0 THEN 'Yes' WHEN 1 THEN 'no ' WHEN 2 THEN 'TRUE' "
    "WHEN 3 THEN '0' WHEN 4 THEN 'maybe' ELSE CAST(NULL AS STRING) END",
}

_K = "CAST(o_orderkey AS STRING)"

# Mail with labelled lines, of which some are missing, repeated or malformed.
MAIL_LINES = {
    "name": f"CASE WHEN o_orderkey % 5 = 0 THEN CAST(NULL AS STRING) "
    "WHEN o_orderkey % 3 = 0 THEN concat('Customer Name :  ', c_name) "
    "ELSE concat('Name: ', c_name) END",
    "company": "CASE WHEN o_orderkey % 7 = 0 THEN CAST(NULL AS STRING) "
    "WHEN o_orderkey % 2 = 0 THEN concat('Company - ', c_mktsegment, ' Ltd') "
    "ELSE concat('org:', c_mktsegment) END",
    "email": "CASE WHEN o_orderkey % 11 = 0 THEN 'Email: not an address' "
    "WHEN o_orderkey % 13 = 0 THEN concat('Email:', chr(10), '   C', CAST(o_custkey AS STRING), '@Example.com') "
    "WHEN o_orderkey % 6 = 0 THEN concat('write to Buyer', CAST(o_custkey AS STRING), '@shop.example.org please') "
    "ELSE concat('Contact Email: c', CAST(o_custkey AS STRING), '@example.com') END",
    "phone": "CASE WHEN o_orderkey % 19 = 0 THEN 'Phone: 12-34' "
    "WHEN o_orderkey % 4 = 0 THEN CAST(NULL AS STRING) "
    "ELSE concat('Tel: +1 (415) 555-', lpad(CAST(o_orderkey % 10000 AS STRING), 4, '0')) END",
    "amount": f"CASE WHEN o_orderkey % 29 = 0 THEN 'Amount: tbd' "
    f"WHEN o_orderkey % 23 = 0 THEN concat('Total: USD ', {COMMA_AMOUNT}, chr(10), 'Total: 5.00 EUR') "
    f"WHEN o_orderkey % 9 = 0 THEN CAST(NULL AS STRING) "
    f"ELSE concat('Amount: ', {COMMA_AMOUNT}, CASE WHEN o_orderkey % 2 = 0 THEN ' gbp' ELSE '' END) END",
    "reference": f"CASE WHEN o_orderkey % 31 = 0 THEN CAST(NULL AS STRING) "
    f"WHEN o_orderkey % 8 = 0 THEN concat('see invoice no. INV-', {_K}, ' for details') "
    f"ELSE concat('Order ID: ORD-', {_K}) END",
}
MAIL = {
    "row_idx": "o_orderkey",
    "message_id": "CASE WHEN o_orderkey % 97 = 0 THEN '' "
    f"WHEN o_orderkey % 17 = 0 THEN concat('msg-', CAST(o_orderkey - 1 AS STRING)) ELSE concat('msg-', {_K}) END",
    "thread_id": "concat('thr-', CAST(o_custkey AS STRING))",
    "internal_date": f"concat({_Y}, {_M}, {_D}, lpad(CAST(o_orderkey % 100000 AS STRING), 5, '0'))",
    "from": "CASE WHEN o_orderkey % 2 = 0 THEN concat(chr(34), c_name, chr(34), ' <c', CAST(o_custkey AS STRING), '@mail.example>') "
    "ELSE concat('c', CAST(o_custkey AS STRING), '@mail.example') END",
    "to": "'desk@example.org'",
    "subject": f"concat('Request ', {_K})",
    "date": f"concat_ws('-', {_Y}, {_M}, {_D})",
    "body": "concat_ws(chr(10), 'Hello team,', "
    + ", ".join(MAIL_LINES.values())
    + ", 'Thanks', concat('Caf', chr(233)), 'The desk')",
}


def select_sql(columns: dict[str, str], source: str) -> str:
    """The same rows as a SQL text for another engine."""
    listed = ", ".join(f'{expression} AS "{name}"' for name, expression in columns.items())
    return f"SELECT {listed} FROM {source}"


ORDERS_WITH_CUSTOMER = "orders JOIN customer ON o_custkey = c_custkey"


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


ROWS_PER_TASK = 50_000  # orders are short rows, but what is derived from one costs up to a millisecond


def tasks_by_rows(spark: SparkSession, folder: str) -> int:
    """How many tasks of a bounded size hold the orders. Their number comes from the file footers."""
    return -(-read(spark, folder, "orders").count() // ROWS_PER_TASK)


def deal_orders(spark: SparkSession, folder: str, orders: DataFrame) -> DataFrame:
    """Rows of orders dealt while they are short: what is derived from them is long, and the file is one split."""
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), tasks_by_rows(spark, folder))
    return orders.repartition(n, "o_orderkey", "o_custkey", "o_totalprice")


def messy_sheet(spark: SparkSession, folder: str) -> DataFrame:
    orders = deal_orders(spark, folder, read(spark, folder, "orders"))
    return orders.select(*[F.expr(e).alias(n) for n, e in MESSY_SHEET.items()])


def mail(spark: SparkSession, folder: str, ranges: int | None = None) -> DataFrame:
    """The mail, in no order; with ``ranges``, dealt into so many partitions by ranges of ``row_idx``, each in order
    (rows of one ``row_idx`` may lie in several).

    Rows are dealt after the join, whose own partitions are counted by the bytes of the short rows."""
    orders, customer = read(spark, folder, "orders"), read(spark, folder, "customer")
    both = orders.join(customer, orders["o_custkey"] == customer["c_custkey"])
    both = both.select(*[c for c in both.columns if c.startswith(("o_", "c_name", "c_mktsegment"))])
    if ranges is None:
        both = deal_orders(spark, folder, both)
    else:
        both = both.repartitionByRange(ranges, "o_orderkey", "o_custkey", "o_totalprice").sortWithinPartitions("o_orderkey")
    return both.select(*[F.expr(e).alias(n) for n, e in MAIL.items()])


def _base64url(c: Column) -> Column:
    text = F.replace(F.base64(F.encode(c, "utf-8")), F.lit("\r\n"), F.lit(""))  # lines, in some sessions
    return F.rtrim(F.replace(F.replace(text, F.lit("+"), F.lit("-")), F.lit("/"), F.lit("_")), F.lit("="))


def _part(mime: str, text: Column) -> Column:
    return F.concat(F.lit(f'{{"mimeType":"{mime}","body":{{"data":"'), _base64url(text), F.lit('"}}'))


def html_of(body: Column) -> Column:
    return F.concat(F.lit("<pre>"), body, F.lit("</pre>"))


def shape() -> Column:
    """Which kind of message a row becomes, 0 to 6 (see ``messages``)."""
    key = F.col("row_idx")
    return F.when(key % 41 == 0, 5).when(key % 43 == 0, 6).otherwise((key % 5).cast("int"))


def attachment_facts() -> list[dict[str, Column]]:
    """The attachments of a message of shape 3."""
    key = F.col("row_idx")
    return [
        {
            "attachment_id": F.concat(F.lit("att-"), key.cast("string"), F.lit("-a")),
            "filename": F.lit("invoice.pdf"),
            "mime": F.lit("application/pdf"),
            "content": F.concat(F.lit("invoice "), (key % 100).cast("string")),
        },
        {
            "attachment_id": F.concat(F.lit("att-"), key.cast("string"), F.lit("-b")),
            "filename": F.concat(F.lit("scan: "), (key % 50).cast("string"), F.lit("?.png")),
            "mime": F.lit("image/png"),
            "content": F.repeat(F.lit("png "), (key % 30).cast("int")),
        },
        {
            "attachment_id": F.concat(F.lit("att-"), key.cast("string"), F.lit("-c")),
            "filename": F.concat(F.lit("setup"), (key % 7).cast("string"), F.lit(".exe")),
            "mime": F.lit("application/octet-stream"),
            "content": F.lit("binary"),
        },
    ]


def messages(mail_rows: DataFrame) -> DataFrame:
    """The mail as JSON messages: ``row_idx`` and ``json``.

    Shapes: 0 one plain part, 1 plain and html, 2 html only, 3 nested with three attachments,
    4 blank plain and html, 5 no payload, 6 data that is not base64.
    """
    body = F.col("body")
    plain, html = _part("text/plain", body), _part("text/html", html_of(body))
    first, second, third = (
        F.concat(
            F.lit('{"partId":"1.'), F.lit(str(i)), F.lit('","body":{"size":'),
            F.length(a["content"]).cast("string"), F.lit(',"attachmentId":"'), a["attachment_id"],
            F.lit('"},'),
            *(
                [F.lit('"mimeType":"'), a["mime"], F.lit('","filename":"'), a["filename"], F.lit('"}')]
                if i != 1
                else [
                    F.lit('"headers":[{"name":"Content-Type","value":"'), a["mime"],
                    F.lit('; charset=x"},{"name":"Content-Disposition","value":"attachment; filename=\\"'),
                    a["filename"], F.lit('\\""}]}'),
                ]
            ),
        )
        for i, a in enumerate(attachment_facts())
    )

    def multipart(kind: str, *parts: Column) -> Column:
        return F.concat(
            F.lit(f'"mimeType":"multipart/{kind}","parts":['), F.concat_ws(",", *parts), F.lit("]")
        )

    alternative = F.concat(F.lit("{"), multipart("alternative", plain, html), F.lit("}"))

    def inside(part: Column) -> Column:
        return F.substring(part, 2, F.length(part) - 2)

    content = (
        F.when(shape() == 0, inside(plain))
        .when(shape() == 1, multipart("alternative", plain, html))
        .when(shape() == 2, inside(html))
        .when(shape() == 3, multipart("mixed", alternative, F.concat(F.lit("{"), multipart("related", first, second), F.lit("}")), third))
        .when(shape() == 4, multipart("alternative", _part("text/plain", F.lit("  ")), html))
        .when(shape() == 6, F.lit('"mimeType":"text/plain","body":{"data":"A"}'))
    )
    headers = F.to_json(
        F.array(
            *[
                F.struct(F.lit(h).alias("name"), F.col(c).alias("value"))
                for h, c in (("From", "from"), ("to", "to"), (" SUBJECT", "subject"), ("Date", "date"))
            ]
        )
    )
    payload = F.concat(F.lit(',"payload":{"headers":'), headers, F.lit(","), content, F.lit("}"))
    json = F.concat(
        F.lit('{"id":"'), F.col("message_id"), F.lit('","threadId":"'), F.col("thread_id"),
        F.lit('","internalDate":"'), F.col("internal_date"), F.lit('"'),
        F.coalesce(payload, F.lit("")), F.lit("}"),
    )
    return mail_rows.select("row_idx", json.alias("json"))


def blobs(mail_rows: DataFrame) -> DataFrame:
    """The bytes of the attachments, apart from the messages as a mail server gives them. Some are
    missing and some are not base64."""
    entries = F.array(
        *[
            F.struct(a["attachment_id"].alias("attachment_id"), _base64url(a["content"]).alias("data"))
            for a in attachment_facts()
        ]
    )
    rows = mail_rows.where(shape() == 3).select("row_idx", "message_id", F.inline(entries))
    return rows.where(F.col("row_idx") % 33 != 0).select(
        "message_id", "attachment_id",
        F.when(F.col("row_idx") % 27 == 0, "B").otherwise(F.col("data")).alias("data"),
    )


# Runs and steps: a run is one user's day of events, a step is one event.
_STAMP = "concat_ws('-', CAST(year(ts) AS STRING), lpad(CAST(month(ts) AS STRING), 2, '0'), lpad(CAST(day(ts) AS STRING), 2, '0'))"
_CLOCK = "concat_ws(':', lpad(CAST(hour(ts) AS STRING), 2, '0'), lpad(CAST(minute(ts) AS STRING), 2, '0'), lpad(CAST(CAST(floor(second(ts)) AS INT) AS STRING), 2, '0'))"
STEPS = {
    "run_id": f"concat('run-', CAST(user_id AS STRING), '-', {_STAMP})",
    "step_position": "event_id",
    "step_name": "event_type",
    "status": "CASE WHEN event_type = 'error' THEN 'FAILED' ELSE 'OK' END",
    "started_at": f"concat({_STAMP}, 'T', {_CLOCK}, 'Z')",
    "finished_at": f"concat({_STAMP}, 'T', {_CLOCK}, 'Z')",
    "duration_ms": "CAST(floor(value) AS BIGINT)",
    "error_summary": "CASE WHEN event_type = 'error' THEN concat('failed at ', CAST(event_id AS STRING)) "
    "ELSE CAST(NULL AS STRING) END",
    "metrics": "CASE WHEN event_id % 4 = 0 THEN CAST(NULL AS STRING) ELSE props END",
}


def steps(spark: SparkSession, folder: str) -> DataFrame:
    events = read(spark, folder, "events")
    return events.select(*[F.expr(e).alias(n) for n, e in STEPS.items()])
