"""What happens to each message after parsing: classification, plan, audit trail and alert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.text import float_text, strip
from ledgerline.rules import Labels


def action_items(items: DataFrame, row: str = "row_idx") -> DataFrame:
    """Intake items as action items, with the error codes of the parser."""
    errors = F.col("parser_errors")
    return items.select(
        row,
        "message_id",
        (F.size(errors) == 0).alias("parse_ok"),
        F.size(errors).alias("error_count"),
        F.col("parser_confidence").alias("confidence"),
        F.transform(errors, lambda e: e["code"]).alias("error_codes"),
    )


def first_items(items: DataFrame, row: str = "row_idx") -> DataFrame:
    """One item per message id, the first one; its error codes are those of the last one.

    ``items`` are read three times: store them, unless they cost no more than a scan.
    """
    codes = F.col("error_codes") if "error_codes" in items.columns else F.lit(None).cast("array<string>")
    key = F.coalesce("message_id", F.lit(""))
    ends = items.groupBy(key.alias("message_id")).agg(F.min(row).alias("at"), F.max(row).alias("end"))
    first = items.select(F.col(row).alias("at"), "parse_ok", "error_count", "confidence")
    last = items.select(F.col(row).alias("end"), codes.alias("error_codes"))
    # Positions are unique, so a message id that comes very often makes no task larger.
    return ends.join(first, "at").join(last, "end").select(
        F.col("at").alias(row), "message_id", "parse_ok", "error_count", "confidence", "error_codes"
    )


def action(min_confidence: float) -> Column:
    is_good = F.col("parse_ok") & (F.col("confidence") >= min_confidence)
    return F.when(is_good, "success").otherwise("needs_review")


def action_plan(items: DataFrame, min_confidence: float, row: str = "row_idx") -> DataFrame:
    """One row per message with its action; messages without an id are left out."""
    first = first_items(items, row).where(F.col("message_id") != "")
    return first.select(row, "message_id", action(min_confidence).alias("action"))


def plan_counts(plan: DataFrame) -> DataFrame:
    return plan.agg(
        F.count_if(F.col("action") == "success").alias("success_count"),
        F.count_if(F.col("action") == "needs_review").alias("needs_review_count"),
    )


def action_audit(
    items: DataFrame,
    labels: Labels,
    run_id: str,
    timestamp: str,
    min_confidence: float = 0.6,
    archive_on_success: bool = False,
    archive_on_failure: bool = False,
    failures: DataFrame | None = None,
    sheet_rows: DataFrame | None = None,
    row: str = "row_idx",
) -> DataFrame:
    """One audit row per message id: what became of it, and why.

    ``failures`` (message_id, error) lists actions that did not work; ``sheet_rows`` (message_id,
    sheet_row_id) tells where a message is in the triage table. All inputs are brought to one row
    per id first, and the joins keep the partitioning of that aggregation.
    """
    df = first_items(items, row)
    if failures is None:
        df = df.withColumn("failure", F.lit(None).cast("string"))
    else:
        failed = failures.groupBy("message_id").agg(F.max("error").alias("failure"))
        df = df.join(failed, "message_id", "left")
    if sheet_rows is None:
        df = df.withColumn("sheet_row_id", F.lit(None).cast("long"))
    else:
        placed = sheet_rows.groupBy("message_id").agg(F.max("sheet_row_id").alias("sheet_row_id"))
        df = df.join(placed, "message_id", "left")

    key = F.col("message_id")
    is_planned = (key != "") & (key == strip(key))
    df = df.select(
        "*",
        F.when(is_planned & F.col("failure").isNotNull(), "error")
        .when(~is_planned, "skipped")
        .when(action(min_confidence) == "success", "processed")
        .otherwise("needs_review")
        .alias("outcome"),
    )
    codes = F.filter("error_codes", lambda c: strip(c) != "")
    why = (
        F.when(F.size(codes) > 0, F.concat(F.lit("needs_review:"), F.array_join(codes, ",")))
        .when(
            F.col("parse_ok"),
            F.concat(
                F.lit("confidence_below_min:"), float_text(F.col("confidence")),
                F.lit(f"<{float(min_confidence)}"),
            ),
        )
        .otherwise(F.concat(F.lit("parse_errors:"), F.col("error_count").cast("string")))
    )
    outcome = F.col("outcome")
    reason = (
        F.when(outcome == "error", F.concat(F.lit("action_failed:"), F.col("failure")))
        .when(key == "", "missing_message_id")
        .when(outcome == "skipped", "not_in_action_plan")
        .when(outcome == "needs_review", why)
    )

    def done(label: str, archive: bool) -> Column:
        return F.array(*[F.lit(a) for a in [f"label:{label}"] + ["archive_inbox"] * archive])

    actions = (
        F.when(outcome == "processed", done(labels.success, archive_on_success))
        .when(outcome == "needs_review", done(labels.needs_review, archive_on_failure))
        .otherwise(F.array().cast("array<string>"))
    )
    return df.select(
        F.lit(run_id).alias("run_id"), "message_id", "outcome", reason.alias("reason"),
        "sheet_row_id", actions.alias("gmail_actions"), F.lit(timestamp).alias("timestamp"),
    )


def outcome_counts(audit: DataFrame) -> DataFrame:
    """One row of counts; an outcome that did not occur counts zero."""
    return audit.agg(
        F.count(F.lit(1)).alias("count"),
        *[
            F.count_if(F.col("outcome") == o).alias(f"{o}_count")
            for o in ("processed", "needs_review", "skipped", "error")
        ],
    )


def applied_totals(
    plan: DataFrame, archive_on_success: bool = False, archive_on_failure: bool = False
) -> DataFrame:
    def archived(kind: str, wanted: bool) -> Column:
        to_archive = (F.col("action") == kind) & (strip(F.col("message_id")) != "")
        return F.count_if(to_archive) if wanted else F.lit(0).cast("long")

    return plan.agg(
        F.count_if(F.col("action") == "success").alias("actions_success_count"),
        F.count_if(F.col("action") == "needs_review").alias("actions_needs_review_count"),
        archived("success", archive_on_success).alias("archived_success_count"),
        archived("needs_review", archive_on_failure).alias("archived_failure_count"),
    )


def sheet_link(sheet_id: str, tab: str) -> str:
    # Fixed value: the address of a sheet in the web client.
    base = f"https://docs.google.com/spreadsheets/d/{sheet_id}/edit"
    return f"{base}#gid={tab.strip()}" if tab.strip() else base


def needs_review_alert(
    plan: DataFrame,
    workflow: str,
    sheet_id: str,
    triage_tab: str,
    labelled: DataFrame | None = None,
) -> DataFrame:
    """One row if there is something new to review, else none. ``labelled`` holds all messages
    under the needs-review label; their number is shown too.

    Both are counted in one aggregate. Each is read once, so a plan and labels that come from the
    same parsed mail should come from stored items.
    """
    new = F.when(F.col("action") == "needs_review", 1).alias("is_new")
    counted = plan.select(new, F.lit(None).cast("int").alias("is_labelled"))
    if labelled is not None:
        one = F.lit(1).alias("is_labelled")
        counted = counted.unionByName(labelled.select(F.lit(None).cast("int").alias("is_new"), one))
    total = F.lit(None).cast("long") if labelled is None else F.col("labelled")
    counts = counted.agg(
        F.count("is_new").alias("new_needs_review_count"), F.count("is_labelled").alias("labelled")
    )
    return counts.where(F.col("new_needs_review_count") > 0).select(
        F.lit(workflow).alias("workflow"), F.lit(sheet_id).alias("sheet_id"),
        F.lit(triage_tab).alias("triage_tab"),
        F.lit(sheet_link(sheet_id, triage_tab)).alias("triage_sheet_url"),
        "new_needs_review_count", total.alias("total_needs_review_count"),
    )
