"""Take in mail: decode, extract, update the triage table, route attachments, plan the actions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators import actions, attachments, decode, extract, triage
from ledgerline.rules import AttachmentPolicy, Labels
from ledgerline.session import SHORT_ROWS_PER_FILE, write_and_read
from ledgerline.sources.writers import OutputCatalog, read_back

POSITION_BITS = 36  # a block of attachment positions has 2**20 messages


@dataclass(frozen=True)
class IntakeOptions:
    labels: Labels
    run_id: str
    now: str
    min_confidence: float = 0.6
    archive_on_success: bool = False
    archive_on_failure: bool = False
    default_status: str = "NEW"
    policy: AttachmentPolicy | None = None
    sheet_id: str = ""
    triage_tab: str = "triage"
    alerts: bool = False


def collect(messages: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Decode and parse (``row_idx``, ``json``) once, and keep the items and the attachment list."""
    with_parts = write_and_read(decode.with_parts(messages), f"{path}/parts")
    decoded = decode.decode_bodies(decode.with_headers(with_parts))
    items = write_and_read(extract.intake_items(decoded, keep=("row_idx",)), f"{path}/items")
    listed = decode.list_attachments(with_parts, keep=("row_idx", "message_id"))
    return items, listed


def run(
    messages: DataFrame, existing: DataFrame, options: IntakeOptions, out: str,
    blobs: DataFrame | None = None, failures: DataFrame | None = None,
    labelled: DataFrame | None = None, list_failures: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Write all outputs below ``out/<run_id>`` and return them as read back. A rerun of a
    ``run_id`` replaces its outputs.

    ``list_failures`` (``message_id``, ``error``) are messages whose attachments could not be listed.
    The bytes of attachments are stored once, where they are, with their hash, by which the
    manifest finds them.
    ``existing`` is the triage table as it is; the new version goes to a path of its own.
    """
    base = f"{out}/{options.run_id}"
    catalog = OutputCatalog(f"{out}/outputs", options.run_id, options.now)
    items, listed = collect(messages, base)
    written: dict[str, DataFrame] = {"items": items}

    def keep(name: str, kind: str, df: DataFrame) -> DataFrame:
        catalog.write(df, f"{name}_{kind}", kind, f"{base}/{name}")
        written[name] = read_back(df, kind, f"{base}/{name}")
        return written[name]

    keep("parsed_emails", "jsonl", extract.without_bodies(items))
    counts = items.withColumnRenamed("body_chosen", "chosen")
    keep("intake_summary", "jsonl", decode.decode_counts(counts))
    keep("intake_preview", "jsonl", extract.body_previews(items))

    cells = triage.triage_cells(items, options.run_id, options.now)
    table = write_and_read(
        triage.upsert(existing, cells, options.default_status), f"{base}/triage"
    )
    written["triage"] = table
    keep("triage_export", "csv", table.orderBy("row_idx").drop("row_idx"))

    if options.policy is not None and blobs is not None:
        placed = listed.withColumn(
            "position", F.shiftleft("row_idx", 16) + F.col("attachment_position")
        )
        contents = write_and_read(attachments.contents(blobs), f"{base}/attachment_contents")
        facts = write_and_read(
            attachments.with_facts(placed, contents), f"{base}/attachment_facts", SHORT_ROWS_PER_FILE
        )
        routed = write_and_read(
            attachments.route(facts, options.policy, POSITION_BITS), f"{base}/attachments"
        )
        written |= {"attachment_contents": contents, "attachments": routed}
        keep("attachment_manifest", "jsonl", attachments.manifest(routed))
        keep("attachment_summary", "jsonl", attachments.attachment_summary(routed, list_failures))
        keep("attachment_totals", "jsonl", attachments.attachment_totals(routed, list_failures))

    acting = actions.action_items(items)
    plan = write_and_read(
        actions.action_plan(acting, options.min_confidence), f"{base}/plan"
    )
    written["plan"] = plan
    audit = write_and_read(
        actions.action_audit(
            acting, options.labels, options.run_id, options.now, options.min_confidence,
            options.archive_on_success, options.archive_on_failure, failures,
            triage.sheet_rows(table),
        ),
        f"{base}/audit",
    )
    keep("triage_audit", "jsonl", audit)
    keep("audit_outcomes", "jsonl", actions.outcome_counts(audit))
    keep(
        "actions_applied", "jsonl",
        actions.applied_totals(plan, options.archive_on_success, options.archive_on_failure),
    )
    if options.alerts:
        keep(
            "needs_review_alert", "jsonl",
            actions.needs_review_alert(
                plan, "mail_intake", options.sheet_id, options.triage_tab, labelled
            ),
        )
    return written
