"""Queries on the triage table, the attachments and the actions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import mail as mail_checks
from ledgerline import AttachmentPolicy, Labels, derived
from ledgerline.operators import actions, attachments, decode, triage
from ledgerline.session import SHORT_ROWS_PER_FILE, fresh_path, shuffles_removed, write_and_read

RUN_ID, NOW = "run-1", "2026-03-01T00:00:00Z"
LABELS = Labels("Done", "Review", "Broken")
POLICY = AttachmentPolicy(80, ("Application/PDF",), (".png",))

# A triage table that is already there: other columns, repeated and blank ids, some messages that
# are not in the mail.
EXISTING = {
    "row_idx": "o_orderkey",
    "message_id": "CASE WHEN o_orderkey % 13 = 0 THEN '' "
    "WHEN o_orderkey % 10 = 9 THEN concat(' msg-', CAST(2 * (o_orderkey - 1) AS STRING), ' ') "
    "ELSE concat('msg-', CAST(2 * o_orderkey AS STRING)) END",
    "status": "CASE o_orderkey % 4 WHEN 0 THEN 'IN_PROGRESS' WHEN 1 THEN 'DONE' WHEN 2 THEN '' ELSE '  ' END",
    "subject": "'old subject'",
    "owner": "CASE WHEN o_orderkey % 5 = 0 THEN CAST(NULL AS STRING) ELSE concat('u', CAST(o_orderkey % 5 AS STRING)) END",
}
FAILURES = {"message_id": "concat('msg-', CAST(o_orderkey AS STRING))", "error": "'quota exceeded'"}


def existing(spark: SparkSession, folder: str) -> DataFrame:
    orders = derived.read(spark, folder, "orders")
    return orders.select(*[F.expr(e).alias(n) for n, e in EXISTING.items()])


def items(spark: SparkSession, folder: str) -> DataFrame:
    """The mail as intake items, without the way through messages."""
    parsed = mail_checks.parsed_mail(spark, folder)
    return parsed.withColumnsRenamed(
        {"confidence": "parser_confidence", "parse_errors": "parser_errors"}
    )


def triage_upsert(spark: SparkSession, folder: str) -> DataFrame:
    cells = triage.triage_cells(items(spark, folder), RUN_ID, NOW)
    return triage.upsert(existing(spark, folder), cells)


def triage_upsert_again(spark: SparkSession, folder: str) -> DataFrame:
    """The same cells once more change nothing. The mail is parsed once for both times."""
    with shuffles_removed(spark):
        parsed = write_and_read(items(spark, folder).drop("to", "body", "parser_errors"), fresh_path(spark, "triage-items"))
        cells = triage.triage_cells(parsed, RUN_ID, NOW)
        once = write_and_read(triage.upsert(existing(spark, folder), cells), fresh_path(spark, "triage"))
    cells = triage.triage_cells(parsed, RUN_ID, NOW)
    return triage.upsert(once, cells)


def triage_cells_mail(spark: SparkSession, folder: str) -> DataFrame:
    return triage.triage_cells(items(spark, folder), RUN_ID, NOW, mailbox_index=1, anchor="all")


def triage_columns_added(spark: SparkSession, folder: str) -> DataFrame:
    return triage.ensure_columns(existing(spark, folder))


def triage_sheet_rows(spark: SparkSession, folder: str) -> DataFrame:
    return triage.sheet_rows(existing(spark, folder))


def permalinks(spark: SparkSession, folder: str) -> DataFrame:
    return existing(spark, folder).select(
        "row_idx", triage.permalink(F.col("message_id")).alias("link")
    )


# ---- attachments -------------------------------------------------------------------------------


POSITION_BITS = 30  # a block of names has the attachments of 2**20 messages


def attachment_rows(spark: SparkSession, folder: str) -> DataFrame:
    """All listed attachments with their order of arrival, and the size and hash of their content,
    stored, because names are given out in several passes."""
    mail = derived.mail(spark, folder)
    facts = attachments.with_facts(listed_attachments(mail), derived.blobs(mail))
    return write_and_read(facts, fresh_path(spark, "attachment-facts"), SHORT_ROWS_PER_FILE)


def listed_attachments(mail: DataFrame) -> DataFrame:
    listed = decode.list_attachments(
        decode.with_parts(derived.messages(mail)), keep=("row_idx", "message_id")
    )
    return listed.withColumn("position", F.col("row_idx") * 1024 + F.col("attachment_position"))


def attachment_contents(spark: SparkSession, folder: str) -> DataFrame:
    mail = derived.mail(spark, folder)
    rows = attachments.with_content(listed_attachments(mail), derived.blobs(mail))
    return rows.select("position", "attachment_id", F.decode("content", "utf-8").alias("content"))


def attachment_stored(spark: SparkSession, folder: str) -> DataFrame:
    """The bytes are stored where they are, and found again for each path of the manifest."""
    mail = derived.mail(spark, folder)
    stored = write_and_read(attachments.contents(derived.blobs(mail)), fresh_path(spark, "contents"))
    routed = attachments.route(attachment_rows(spark, folder), POLICY, POSITION_BITS)
    rows = routed.where("saved_path != ''").join(stored.drop("size"), ["message_id", "attachment_id", "sha256"])
    return rows.select("saved_path", "sha256", F.length("content").cast("long").alias("bytes"))


def attachment_policy(spark: SparkSession, folder: str) -> DataFrame:
    mail = derived.mail(spark, folder)
    listed = decode.list_attachments(
        decode.with_parts(derived.messages(mail)), keep=("row_idx", "message_id")
    )
    return listed.select(
        "row_idx", "attachment_position",
        attachments.policy_reason(
            POLICY, F.col("filename"), F.col("mime_type"), F.col("size_estimate")
        ).alias("reason"),
    )


def attachment_names(spark: SparkSession, folder: str) -> DataFrame:
    """File names for one attachment per part: some are common, some need cleaning."""
    lines = derived.read(spark, folder, "lineitem")
    rows = lines.select(
        (F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("message_id"), "l_shipdate",
        F.lit("7").alias("part_id"),
        F.when(F.col("l_returnflag") == "N", "statement.pdf")
        .when(F.col("l_returnflag") == "A", F.concat(F.lit(" ..dir/\"a\":"), F.col("l_suppkey").cast("string"), F.lit(" ?\t.tar.gz. ")))
        .otherwise(" . ")
        .alias("filename"),
    ).groupBy("message_id").agg(F.max("part_id").alias("part_id"), F.max("filename").alias("filename"))
    named = attachments.with_safe_names(
        rows.select(F.col("message_id").alias("position"),
                    F.concat(F.lit("m"), F.col("message_id").cast("string")).alias("message_id"),
                    "part_id", "filename", F.lit("routed").alias("folder"))
    )
    return attachments.allocate_names(named).select("position", "safe_name", "stored_name")


def attachment_names_contested(spark: SparkSession, folder: str) -> DataFrame:
    """Copies of doc.pdf become doc-1.pdf and so on, which are names of other attachments too."""
    orders = derived.read(spark, folder, "orders")
    rows = orders.select(
        F.col("o_orderkey").alias("position"), F.lit("routed").alias("folder"),
        F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("doc-"), (F.col("o_custkey") % 40 + 1).cast("string"), F.lit(".pdf")))
        .when(F.col("o_orderstatus") == "F", F.concat(F.lit("doc"), (F.col("o_custkey") % 100).cast("string"), F.lit(".pdf")))
        .otherwise("doc.pdf").alias("safe_name"),
    )
    return attachments.allocate_names(rows).select("position", "safe_name", "stored_name")


def attachment_routing(spark: SparkSession, folder: str) -> DataFrame:
    return attachments.route(attachment_rows(spark, folder), POLICY, POSITION_BITS).select(
        "position", "attachment_id", "filename", "status", "reason", "saved_path"
    )


def attachment_routing_drive(spark: SparkSession, folder: str) -> DataFrame:
    policy = AttachmentPolicy(80, ("application/pdf",), (".png",), "drive", "folder-1", True)
    routed = attachments.route(attachment_rows(spark, folder), policy, POSITION_BITS)
    return routed.groupBy("status", "reason").agg(F.count(F.lit(1)).alias("attachments"))


def attachment_manifest(spark: SparkSession, folder: str) -> DataFrame:
    routed = attachments.route(attachment_rows(spark, folder), POLICY, POSITION_BITS)
    return attachments.manifest(routed).select("filename", "mime", "size", "sha256", "status")


def attachment_summary(spark: SparkSession, folder: str) -> DataFrame:
    routed = attachments.route(attachment_rows(spark, folder), POLICY, POSITION_BITS)
    return attachments.attachment_summary(routed, list_failures(spark, folder)).select(
        "message_id", "filename", "status", "reason"
    )


def attachment_totals(spark: SparkSession, folder: str) -> DataFrame:
    mail = derived.mail(spark, folder)
    facts = attachments.with_facts(listed_attachments(mail), derived.blobs(mail))
    return attachments.attachment_totals(attachments.decide(facts, POLICY), list_failures(spark, folder))


def list_failures(spark: SparkSession, folder: str) -> DataFrame:
    customers = derived.read(spark, folder, "customer").where("c_acctbal < 0")
    return customers.select(
        F.concat(F.lit("cust-"), F.col("c_custkey").cast("string")).alias("message_id"),
        F.lit("timeout").alias("error"),
    )


def attachment_raw_paths(spark: SparkSession, folder: str) -> DataFrame:
    return attachments.raw_paths(attachment_rows(spark, folder), POSITION_BITS).select("position", "raw_path")


# ---- actions -----------------------------------------------------------------------------------


def action_items(spark: SparkSession, folder: str) -> DataFrame:
    return actions.action_items(items(spark, folder))


def stored_items(spark: SparkSession, folder: str) -> DataFrame:
    """The action items, parsed once for operators that read them several times."""
    return write_and_read(action_items(spark, folder), fresh_path(spark, "action-items"))


def distinct_messages(spark: SparkSession, folder: str) -> DataFrame:
    first = actions.first_items(stored_items(spark, folder))
    return first.select(
        "row_idx", "message_id", "parse_ok", "error_count", "confidence",
        F.array_join("error_codes", ",").alias("error_codes"),
    )


def plan(spark: SparkSession, folder: str) -> DataFrame:
    return actions.action_plan(stored_items(spark, folder), 0.6)


def classify_actions(spark: SparkSession, folder: str) -> DataFrame:
    return plan(spark, folder)


def plan_counts(spark: SparkSession, folder: str) -> DataFrame:
    return actions.plan_counts(plan(spark, folder))


def failures(spark: SparkSession, folder: str) -> DataFrame:
    orders = derived.read(spark, folder, "orders").where("o_totalprice > 400000")
    return orders.select(*[F.expr(e).alias(n) for n, e in FAILURES.items()])


def audit(spark: SparkSession, folder: str) -> DataFrame:
    return actions.action_audit(
        stored_items(spark, folder), LABELS, RUN_ID, NOW, min_confidence=0.6,
        archive_on_success=True, failures=failures(spark, folder),
        sheet_rows=triage.sheet_rows(existing(spark, folder)),
    )


def audit_rows(spark: SparkSession, folder: str) -> DataFrame:
    return audit(spark, folder).withColumn("gmail_actions", F.array_join("gmail_actions", ","))


def audit_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    return actions.outcome_counts(audit(spark, folder))


def applied_totals(spark: SparkSession, folder: str) -> DataFrame:
    return actions.applied_totals(plan(spark, folder), archive_on_success=True)


def needs_review_alert(spark: SparkSession, folder: str) -> DataFrame:
    acting = stored_items(spark, folder)
    labelled = acting.where("error_count > 1")
    return actions.needs_review_alert(actions.action_plan(acting, 0.6), "mail_intake", "S1", "triage", labelled)


QUERIES = {
    f.__name__: f
    for f in (
        triage_upsert, triage_upsert_again, triage_cells_mail, triage_columns_added, triage_sheet_rows, permalinks,
        attachment_contents, attachment_stored, attachment_policy, attachment_names, attachment_names_contested,
        attachment_routing, attachment_routing_drive, attachment_manifest, attachment_summary,
        attachment_totals, attachment_raw_paths, distinct_messages, classify_actions, plan_counts,
        audit_rows, audit_outcomes, applied_totals, needs_review_alert,
    )
}

# ---- SQL ---------------------------------------------------------------------------------------

EXISTING_SQL = f"existing AS ({derived.select_sql(EXISTING, 'orders')})"


def link_sql(key: str, mailbox: int = 0, anchor: str = "inbox") -> str:
    return (
        f"CASE WHEN {key} = '' THEN '' ELSE 'https://mail.google.com/mail/u/{mailbox}/#{anchor}/' || {key} END"
    )


_AMOUNT_JSON = """CASE WHEN amount_raw IS NULL THEN '' ELSE '{"amount":' || CAST(amount_value AS VARCHAR)
  || ',"currency":' || coalesce('"' || amount_currency || '"', 'null') || ',"raw":"' || amount_raw || '"}' END"""


def cells_sql(mailbox: int = 0, anchor: str = "inbox") -> str:
    return f"""{mail_checks.PARSED_MAIL_SQL},
cells AS (SELECT row_idx, message_id, thread_id, "date", "from", subject, coalesce(customer_name, '') AS name,
  coalesce(company_name, '') AS company, coalesce(customer_email, '') AS email, coalesce(customer_phone, '') AS phone,
  {_AMOUNT_JSON} AS amount, coalesce(reference_id, '') AS invoice_or_order_id,
  CASE WHEN confidence = 0 THEN '' ELSE CAST(confidence AS VARCHAR) END AS confidence,
  {link_sql('message_id', mailbox, anchor)} AS gmail_link, '{RUN_ID}' AS last_run_id, '{NOW}' AS updated_at FROM parsed)"""


_MANAGED = ", ".join(
    f'coalesce(n."{c}", e."{c}", \'\') AS "{c}"' if c in ("message_id", "subject")
    else f'coalesce(n."{c}", \'\') AS "{c}"'
    for c in triage.MANAGED
)

ITEMS_SQL = f"""{mail_checks.PARSED_MAIL_SQL},
action_items AS (SELECT row_idx, message_id, len(error_list) = 0 AS parse_ok, CAST(len(error_list) AS INTEGER) AS error_count,
  confidence, array_to_string(list_transform(error_list, lambda e: split_part(e, ':', 1)), ',') AS error_codes FROM parsed),
distinct_items AS (SELECT min(row_idx) AS row_idx, message_id, arg_min(parse_ok, row_idx) AS parse_ok,
  arg_min(error_count, row_idx) AS error_count, arg_min(confidence, row_idx) AS confidence,
  arg_max(error_codes, row_idx) AS error_codes FROM action_items GROUP BY message_id),
plan AS (SELECT row_idx, message_id, CASE WHEN parse_ok AND confidence >= 0.6 THEN 'success' ELSE 'needs_review' END AS action
  FROM distinct_items WHERE message_id <> '')"""

SHEET_ROWS_SQL = """numbered AS (SELECT trim(message_id) AS message_id, row_number() OVER (ORDER BY row_idx) + 1 AS sheet_row_id FROM existing),
sheet_rows AS (SELECT message_id, max(sheet_row_id) AS sheet_row_id FROM numbered WHERE message_id <> '' GROUP BY message_id)"""

AUDIT_SQL = f"""{ITEMS_SQL}, {EXISTING_SQL}, {SHEET_ROWS_SQL},
failures AS (SELECT DISTINCT 'msg-' || o_orderkey AS message_id, 'quota exceeded' AS error FROM orders WHERE o_totalprice > 400000),
audit AS (SELECT '{RUN_ID}' AS run_id, d.message_id,
  CASE WHEN d.message_id = '' THEN 'skipped' WHEN f.error IS NOT NULL THEN 'error'
       WHEN parse_ok AND confidence >= 0.6 THEN 'processed' ELSE 'needs_review' END AS outcome,
  CASE WHEN d.message_id = '' THEN 'missing_message_id' WHEN f.error IS NOT NULL THEN 'action_failed:' || f.error
       WHEN parse_ok AND confidence >= 0.6 THEN NULL
       WHEN error_codes <> '' THEN 'needs_review:' || error_codes
       WHEN parse_ok THEN 'confidence_below_min:' || confidence || '<0.6'
       ELSE 'parse_errors:' || error_count END AS reason,
  sheet_row_id,
  CASE WHEN d.message_id = '' OR f.error IS NOT NULL THEN ''
       WHEN parse_ok AND confidence >= 0.6 THEN 'label:Done,archive_inbox' ELSE 'label:Review' END AS gmail_actions,
  '{NOW}' AS "timestamp"
  FROM distinct_items d LEFT JOIN failures f USING (message_id) LEFT JOIN sheet_rows s USING (message_id))"""



def names_sql(rows: str, folder: str = "folder") -> str:
    """``rows`` with ``stored_name``: copies take the numbers whose names nobody asks for."""
    return f"""WITH turned AS (SELECT *, {folder} AS place, row_number() OVER (PARTITION BY {folder}, safe_name ORDER BY position) - 1 AS turn FROM {rows}),
    own AS (SELECT DISTINCT place, safe_name, regexp_extract(safe_name, '^(.+?)(\\.[^.]+)?$', ['stem', 'suffix']) AS s FROM turned),
    asked AS (SELECT place, regexp_replace(s.stem, '-[1-9][0-9]*$', '') || s.suffix AS safe_name,
      CAST(regexp_extract(s.stem, '-([1-9][0-9]*)$', 1) AS BIGINT) AS number FROM own WHERE regexp_matches(s.stem, '-[1-9][0-9]*$')),
    free AS (SELECT place, safe_name, number - row_number() OVER (PARTITION BY place, safe_name ORDER BY number) AS free FROM asked),
    skips AS (SELECT t.place, t.safe_name, turn, count(*) AS n FROM (SELECT DISTINCT place, safe_name, turn FROM turned) t
      JOIN free f ON f.place = t.place AND f.safe_name = t.safe_name AND f.free < turn GROUP BY ALL)
    SELECT t.*, CASE WHEN turn = 0 THEN t.safe_name
      ELSE o.s.stem || '-' || (turn + coalesce(n, 0)) || o.s.suffix END AS stored_name
    FROM turned t LEFT JOIN own o USING (place, safe_name) LEFT JOIN skips USING (place, safe_name, turn)"""


CONTENT_SQL = f"""{mail_checks.ATTACHMENTS_SQL},
contents AS (SELECT *, row_idx * 1024 + attachment_position AS position,
  CASE WHEN row_idx % 33 = 0 OR row_idx % 27 = 0 THEN NULL ELSE content END AS bytes FROM attachments),
verdicts AS (SELECT *, length(bytes) AS size,
  CASE WHEN bytes IS NULL THEN 'download_failed' WHEN length(bytes) > 80 THEN 'size_exceeds_limit:' || length(bytes) || '>80'
       WHEN filename LIKE '%.exe' THEN 'policy_blocked:mime=application/octet-stream|ext=.exe' ELSE 'ok' END AS verdict
  FROM contents),
foldered AS (SELECT *, CASE WHEN bytes IS NULL THEN NULL WHEN verdict = 'ok' THEN 'routed' ELSE 'quarantine' END AS folder,
  replace(replace(filename, ':', '_'), '?', '_') AS safe_name FROM verdicts),
routed AS (SELECT *,
  CASE WHEN bytes IS NULL THEN 'ERROR' WHEN verdict = 'ok' THEN 'routed_artifacts' ELSE 'quarantined' END AS status, verdict AS reason,
  CASE WHEN bytes IS NULL THEN '' ELSE 'attachments/' || folder || '/' || stored_name END AS saved_path
  FROM ({names_sql("foldered")}))"""

_LIST_FAILURES = "SELECT 'cust-' || c_custkey AS message_id FROM customer WHERE c_acctbal < 0"

ORACLES = {
    "triage_upsert": f"""WITH {cells_sql()}, {EXISTING_SQL},
        latest AS (SELECT arg_max(c, row_idx) AS n, min(row_idx) AS came_at, message_id FROM cells c
                   WHERE message_id <> '' GROUP BY message_id),
        known AS (SELECT trim(message_id) AS id, min(row_idx) AS place FROM existing WHERE trim(message_id) <> '' GROUP BY ALL),
        placed AS (SELECT n.*, came_at, place FROM latest LEFT JOIN known ON message_id = id)
        SELECT coalesce(e.row_idx, (SELECT max(row_idx) + 1 FROM existing) + n.came_at) AS row_idx, {_MANAGED},
          CASE WHEN n.came_at IS NULL THEN e.status WHEN trim(e.status) <> '' THEN e.status ELSE 'NEW' END AS status,
          coalesce(e.owner, '') AS owner
        FROM existing e FULL JOIN placed n ON e.row_idx = n.place""",
    "triage_cells_mail": f"WITH {cells_sql(1, 'all')} SELECT * FROM cells",
    "triage_columns_added": f"""WITH {EXISTING_SQL}
        SELECT row_idx, message_id, status, subject, coalesce(owner, '') AS owner,
          {', '.join(f"'' AS {chr(34)}{c}{chr(34)}" for c in triage.TRIAGE_COLUMNS if c not in EXISTING)} FROM existing""",
    "triage_sheet_rows": f"WITH {EXISTING_SQL}, {SHEET_ROWS_SQL} SELECT message_id, sheet_row_id FROM sheet_rows",
    "permalinks": f"WITH {EXISTING_SQL} SELECT row_idx, {link_sql('trim(message_id)')} AS link FROM existing",
    "attachment_contents": f"WITH {CONTENT_SQL} SELECT position, attachment_id, bytes AS content FROM contents",
    "attachment_stored": f"""WITH {CONTENT_SQL}
        SELECT saved_path, sha256(bytes) AS sha256, strlen(bytes) AS bytes FROM routed WHERE saved_path <> ''""",
    "attachment_policy": f"""WITH {CONTENT_SQL}
        SELECT row_idx, attachment_position, CASE WHEN size_estimate > 80 THEN 'size_exceeds_limit:' || size_estimate || '>80'
          WHEN filename LIKE '%.exe' THEN 'policy_blocked:mime=application/octet-stream|ext=.exe' ELSE 'ok' END AS reason FROM contents""",
    "attachment_names": f"""WITH flags AS (
          SELECT l_orderkey * 16 + l_linenumber AS position,
            max(CASE l_returnflag WHEN 'N' THEN 'statement.pdf'
                WHEN 'A' THEN ' ..dir/"a":' || l_suppkey || chr(160) || '?' || chr(9) || '.tar.gz. ' ELSE ' . ' END) AS filename
          FROM lineitem GROUP BY ALL),
        safe AS (SELECT position, CASE WHEN filename LIKE 'statement%' THEN filename
            WHEN filename = ' . ' THEN 'm' || position || '_7.bin'
            ELSE replace(replace(replace(replace(replace(replace(regexp_replace(filename, '^ \\.\\.|\\. $', '', 'g'),
                 '/', '_'), '"', '_'), ':', '_'), '?', '_'), chr(9), ''), chr(160), '') END AS safe_name FROM flags),
        placed AS (SELECT *, 'raw' AS folder FROM safe)
        SELECT position, safe_name, stored_name FROM ({names_sql("placed")})""",
    "attachment_names_contested": f"""WITH asked_for AS (SELECT o_orderkey AS position, 'routed' AS folder,
          CASE o_orderstatus WHEN 'P' THEN 'doc-' || (o_custkey % 40 + 1) || '.pdf'
               WHEN 'F' THEN 'doc' || (o_custkey % 100) || '.pdf' ELSE 'doc.pdf' END AS safe_name FROM orders)
        SELECT position, safe_name, stored_name FROM ({names_sql("asked_for")})""",
    "attachment_routing": f"""WITH {CONTENT_SQL}
        SELECT position, attachment_id, filename, status, reason, saved_path FROM routed""",
    "attachment_routing_drive": f"""WITH {CONTENT_SQL}, drive AS (
          SELECT CASE WHEN status = 'routed_artifacts' THEN 'routed_drive' ELSE status END AS status,
                 CASE WHEN verdict = 'ok' THEN 'ok' ELSE reason END AS reason FROM routed)
        SELECT status, reason, count(*) AS attachments FROM drive GROUP BY ALL""",
    "attachment_manifest": f"""WITH {CONTENT_SQL}
        SELECT filename, mime_type AS mime, size, sha256(bytes) AS sha256, status FROM routed WHERE status <> 'ERROR'""",
    "attachment_summary": f"""WITH {CONTENT_SQL}
        SELECT message_id, filename, status, reason FROM routed
        UNION ALL SELECT message_id, NULL, 'ERROR', 'list_attachments_failed:timeout' FROM ({_LIST_FAILURES})""",
    "attachment_totals": f"""WITH {CONTENT_SQL}
        SELECT count(*) AS attachments_total, count(*) FILTER (status = 'routed_artifacts') AS attachments_routed,
          count(*) FILTER (status = 'quarantined') AS attachments_quarantined,
          count(*) FILTER (status IN ('error', 'ERROR')) + (SELECT count(*) FROM ({_LIST_FAILURES})) AS attachments_errors FROM routed""",
    "attachment_raw_paths": f"""WITH {CONTENT_SQL}
        SELECT position, 'attachments/raw/' || stored_name AS raw_path FROM ({names_sql("foldered", "'raw'")})""",
    "distinct_messages": f"WITH {ITEMS_SQL} SELECT * FROM distinct_items",
    "classify_actions": f"WITH {ITEMS_SQL} SELECT * FROM plan",
    "plan_counts": f"""WITH {ITEMS_SQL}
        SELECT count(*) FILTER (action = 'success') AS success_count,
               count(*) FILTER (action = 'needs_review') AS needs_review_count FROM plan""",
    "audit_rows": f"WITH {AUDIT_SQL} SELECT * FROM audit",
    "audit_outcomes": f"""WITH {AUDIT_SQL}
        SELECT count(*) AS count, count(*) FILTER (outcome = 'processed') AS processed_count,
          count(*) FILTER (outcome = 'needs_review') AS needs_review_count,
          count(*) FILTER (outcome = 'skipped') AS skipped_count, count(*) FILTER (outcome = 'error') AS error_count FROM audit""",
    "applied_totals": f"""WITH {ITEMS_SQL}
        SELECT count(*) FILTER (action = 'success') AS actions_success_count,
          count(*) FILTER (action = 'needs_review') AS actions_needs_review_count,
          count(*) FILTER (action = 'success') AS archived_success_count, CAST(0 AS BIGINT) AS archived_failure_count FROM plan""",
    "needs_review_alert": f"""WITH {ITEMS_SQL}
        SELECT 'mail_intake' AS workflow, 'S1' AS sheet_id, 'triage' AS triage_tab,
          'https://docs.google.com/spreadsheets/d/S1/edit#gid=triage' AS triage_sheet_url,
          count(*) FILTER (action = 'needs_review') AS new_needs_review_count,
          (SELECT count(*) FROM action_items WHERE error_count > 1) AS total_needs_review_count
        FROM plan HAVING count(*) FILTER (action = 'needs_review') > 0""",
}
ORACLES["triage_upsert_again"] = ORACLES["triage_upsert"]
