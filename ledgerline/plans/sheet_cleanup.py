"""Clean a sheet, and report on it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ledgerline.operators import cleaning, dedupe, report
from ledgerline.rules import ColumnRule, Dedupe, Transforms
from ledgerline.session import write_and_read
from ledgerline.sources.writers import OutputCatalog


@dataclass(frozen=True)
class CleanupOutputs:
    annotated: DataFrame
    cleaned: DataFrame
    marked: DataFrame
    report: DataFrame
    needs_review: DataFrame
    summary: DataFrame


def plan(
    sheet: DataFrame, schema: Sequence[ColumnRule], transforms: Transforms, rule: Dedupe,
    run_id: str, generated_at: str, annotated_path: str | None = None,
) -> CleanupOutputs:
    """All outputs of one cleaned sheet.

    They all read the annotated rows. With ``annotated_path``, those are written once and read back,
    so that cells are parsed once and a lost executor costs no second parse.
    """
    rows = cleaning.validate(cleaning.apply_transforms(sheet, schema, transforms), schema)
    if annotated_path is not None:
        rows = write_and_read(rows, annotated_path)
    counts = report.cleanup_counts(rows, rule)
    return CleanupOutputs(
        annotated=rows,
        cleaned=dedupe.dedupe(cleaning.valid_rows(rows), rule),
        marked=cleaning.mark_rows(rows),
        report=report.cleanup_report(counts, run_id, generated_at),
        needs_review=report.needs_review(rows, omit_null=transforms.null_is_absent),
        summary=report.cleanup_summary(rows, rule, run_id),
    )


def run(
    sheet: DataFrame, schema: Sequence[ColumnRule], transforms: Transforms, rule: Dedupe,
    run_id: str, generated_at: str, out: str,
) -> CleanupOutputs:
    """Write all outputs below ``out/<run_id>``. A rerun of the same id replaces them."""
    if not schema:
        raise ValueError("the schema has no columns")
    base = f"{out}/{run_id}"
    outputs = plan(
        sheet, schema, transforms, rule, run_id, generated_at, f"{base}/annotated"
    )
    catalog = OutputCatalog(f"{out}/outputs", run_id, generated_at)
    catalog.write(outputs.cleaned, "cleaned", "parquet", f"{base}/cleaned")
    catalog.write(
        outputs.report.orderBy("position").select("metric", "value"), "report_csv", "csv",
        f"{base}/report",
    )
    catalog.write(
        report.in_report_order(outputs.needs_review), "needs_review_csv", "csv",
        f"{base}/needs_review",
    )
    catalog.write(outputs.summary, "cleanup_report_json", "jsonl", f"{base}/cleanup_report")
    return outputs
