"""Reports on a cleaned sheet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.text import is_blank
from ledgerline.operators.cleaning import ROW, is_valid, row_json, valid_rows
from ledgerline.operators.dedupe import dedupe, head, removed_count
from ledgerline.rules import Dedupe


def cleanup_counts(annotated: DataFrame, rule: Dedupe) -> DataFrame:
    """One row of counts, in one pass over the annotated rows.

    A row that fails in the transforms and in the validation counts twice in ``invalid_count``.
    """
    keys = [k for k in rule.keys if k in annotated.schema["clean"].dataType.names]
    flat = annotated.select(
        *[F.col("clean")[k].alias(k) for k in keys],
        is_valid().alias("is_valid_row"),
        (F.size("t_reasons") > 0).alias("has_bad_cell"),
    )
    valid = F.col("is_valid_row")
    removed = removed_count(flat, rule, where=valid)
    return (
        flat.agg(
            F.count(F.lit(1)).alias("rows_in"),
            F.count_if(valid).alias("rows_valid_pre_dedupe"),
            (F.count_if(F.col("has_bad_cell")) + F.count_if(~valid)).alias("invalid_count"),
            removed.alias("dedupe_removed"),
        )
        .withColumn("rows_out", F.col("rows_valid_pre_dedupe") - F.col("dedupe_removed"))
        .withColumn(
            "invalid_rate",
            F.coalesce(F.try_divide(F.col("invalid_count"), F.col("rows_in")), F.lit(0.0)),
        )
    )


def cleanup_report(counts: DataFrame, run_id: str, generated_at: str) -> DataFrame:
    """The counts in long form, as texts, in the order of ``position``."""
    texts = [
        ("run_id", F.lit(run_id)),
        ("generated_at_utc", F.lit(generated_at)),
        *[
            (name, F.col(name).cast("string"))
            for name in (
                "rows_in", "rows_valid_pre_dedupe", "invalid_count", "dedupe_removed", "rows_out",
            )
        ],
        ("invalid_rate", F.format_string("%.4f", "invalid_rate")),
    ]
    lines = [
        F.struct(
            F.lit(i).alias("position"), F.lit(metric).alias("metric"), value.alias("value")
        )
        for i, (metric, value) in enumerate(texts)
    ]
    return counts.select(F.inline(F.array(*lines)))


def needs_review(annotated: DataFrame, omit_null: bool = False) -> DataFrame:
    """One row per failed stage of a row: first the transforms, with the original cells, then the
    validation, with the transformed cells. Both come out of one pass over the input."""
    number = (F.col(ROW) + 1).cast("string")

    def issue(rank: int, reasons: str, json_row) -> F.Column:
        return F.when(
            F.size(reasons) > 0,
            F.struct(
                F.lit(rank).alias("section"),
                number.alias("row_number"),
                F.array_join(reasons, "; ").alias("reason"),
                json_row.alias("values_json"),
            ),
        )

    issues = F.array_compact(
        F.array(
            issue(0, "t_reasons", row_json(annotated, "raw", omit_null=omit_null)),
            issue(1, "v_reasons", row_json(annotated, "cells", "raw", omit_null=omit_null)),
        )
    )
    # A row without issues gives none; a filter on the reasons would parse every cell once more.
    return annotated.select(ROW, F.inline(issues))


def in_report_order(issues: DataFrame) -> DataFrame:
    """The three printed columns, the transform issues first, each part by position."""
    return issues.orderBy("section", ROW).select("row_number", "reason", "values_json")


def cleanup_summary(
    annotated: DataFrame,
    rule: Dedupe,
    run_id: str,
    workflow: str = "sheet_cleanup",
    examples: int = 25,
    preview: int = 10,
) -> DataFrame:
    """One row: the counts, the first failed rows of both stages, and previews of the outputs.

    The lists are short by definition (``examples`` and ``preview`` rows), so gathering them into
    one row is bounded. ``annotated`` is read once for the counts and once or twice for each list:
    store it, unless it costs no more than a scan.
    """

    def example(reasons: str, json_row) -> DataFrame:
        entry = F.struct(F.col(ROW).alias(ROW), F.col(reasons).alias("reasons"), json_row.alias("row"))
        one = F.when(F.size(reasons) > 0, F.array(F.struct(entry.alias("entry"))))
        return annotated.select(ROW, F.inline(one))

    cleaned = dedupe(valid_rows(annotated), rule)
    cells = F.struct(*[c for c in cleaned.columns if c != ROW])
    marked = F.struct(
        row_json(annotated, "cells", "raw").alias("row"), is_valid().alias("valid"),
        F.array_join("v_reasons", "|").alias("reasons"),
    )
    lists = {
        "transform_invalid_examples": (example("t_reasons", row_json(annotated, "raw")), examples),
        "validation_invalid_examples": (
            example("v_reasons", row_json(annotated, "cells", "raw")), examples,
        ),
        "cleaned_preview": (
            cleaned.select(ROW, F.to_json(cells, {"ignoreNullFields": "false"}).alias("entry")), preview,
        ),
        "marked_preview": (annotated.select(ROW, marked.alias("entry")), preview),
    }
    # The few rows of all parts come together in one aggregate, each part in a column of its own.
    parts = cleanup_counts(annotated, rule).select(F.struct("*").alias("counts"))
    for name, (rows, n) in lists.items():
        parts = parts.unionByName(
            head(rows, n).select(F.struct(ROW, "entry").alias(name)), allowMissingColumns=True
        )
    found = parts.agg(
        F.max("counts").alias("counts"),
        *[F.array_sort(F.collect_list(name)).alias(name) for name in lists],
    )
    return found.select(
        F.lit(workflow).alias("workflow"), F.lit(run_id).alias("run_id"), "counts",
        *[F.transform(name, lambda x: x["entry"]).alias(name) for name in lists],
    )


def category_totals(df: DataFrame, category: str = "category", amount: str = "amount") -> DataFrame:
    """Rows and amounts per category, and for the whole table (``is_total``)."""
    return (
        df.select(F.col(category).alias("category"), F.col(amount).alias("amount"))
        .rollup("category")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.sum("amount").alias("amount_total"),
            F.grouping("category").cast("boolean").alias("is_total"),
        )
    )


def with_row_key(
    df: DataFrame, primary: str, fallback_fields: Sequence[str], name: str = "row_key"
) -> DataFrame:
    """Add a key for reruns: the primary column, or a hash of other cells where it is blank."""
    cells = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fallback_fields]
    hashed = F.sha2(F.concat_ws("\u001f", *cells).cast("binary"), 256)
    return df.withColumn(name, F.when(is_blank(F.col(primary)), hashed).otherwise(F.col(primary)))
