"""Queries on the messy sheet that is derived from orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline import ColumnRule, Dedupe, Transforms, schema_from_config, transforms_from_config
from ledgerline import derived
from ledgerline.functions import coerce, text
from ledgerline.operators import cleaning, dedupe, report
from ledgerline.session import fresh_path, write_and_read
from pyspark.sql.types import StringType

SCHEMA = [
    ColumnRule("id", "string", required=True, allow_blank=False),
    ColumnRule("date", "date_iso", required=True, allow_blank=False),
    ColumnRule("description", "string", required=True, allow_blank=False),
    ColumnRule("amount", "number", required=True, allow_blank=False),
    ColumnRule("category", "string"),
    ColumnRule("paid", "bool", allow_blank=False),
    ColumnRule("status", "string"),
]
TRANSFORMS = Transforms(
    collapse_spaces=True,
    case={"description": "title", "category": "lower"},
    date_formats=("%Y-%m-%d", "%d/%m/%Y", "%m/%d/%Y"),
)
RUN_ID, NOW = "run-1", "2026-03-01T00:00:00Z"


def annotated(spark: SparkSession, folder: str) -> DataFrame:
    sheet = derived.messy_sheet(spark, folder)
    return cleaning.validate(cleaning.apply_transforms(sheet, SCHEMA, TRANSFORMS), SCHEMA)


def clean_validate_orders(spark: SparkSession, folder: str) -> DataFrame:
    return annotated(spark, folder).select(
        "row_idx", "clean.*",
        F.array_join("t_reasons", "; ").alias("t_reasons"),
        F.array_join("v_reasons", "; ").alias("v_reasons"),
    )


def transform_orders(spark: SparkSession, folder: str) -> DataFrame:
    sheet = derived.messy_sheet(spark, folder)
    return cleaning.apply_transforms(sheet, SCHEMA, TRANSFORMS).select(
        "row_idx", "cells.*", F.array_join("t_reasons", "; ").alias("t_reasons")
    )


def validate_plain_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Validation without transforms: only ISO dates pass, and texts keep their case."""
    plain = cleaning.validate(derived.messy_sheet(spark, folder), SCHEMA)
    return plain.select(
        "row_idx", "clean.id", "clean.date", "clean.description", "clean.amount", "clean.paid",
        F.array_join("v_reasons", "|").alias("reasons"),
    )


RULES = {"schema": {
    "id": {"type": "string", "required": True, "allow_blank": False},
    "date": {"type": "date_iso", "required": True, "allow_blank": False},
    "description": {"type": "string", "required": True, "allow_blank": False},
    "amount": {"type": "number", "required": True, "allow_blank": False},
    "category": {"type": "string"},
    "paid": {"type": "bool", "allow_blank": False},
    "status": {"type": "string"},
}}
CONFIG = {
    "strings": {"collapse_spaces": True, "case": {"description": "title", "category": "lower"}},
    "dates": {"formats": ["%Y-%m-%d", "%d/%m/%Y", "%m/%d/%Y"]},
}


def rules_from_config(spark: SparkSession, folder: str) -> DataFrame:
    """The rules of the sheet come from a mapping, as a config file has them."""
    sheet = derived.messy_sheet(spark, folder)
    rows = cleaning.apply_transforms(sheet, schema_from_config(RULES), transforms_from_config(CONFIG))
    return cleaning.validate(rows, schema_from_config(RULES)).select(
        "row_idx", "clean.*",
        F.array_join("t_reasons", "; ").alias("t_reasons"),
        F.array_join("v_reasons", "; ").alias("v_reasons"),
    )


def valid_orders(spark: SparkSession, folder: str) -> DataFrame:
    return cleaning.valid_rows(annotated(spark, folder))


def invalid_orders(spark: SparkSession, folder: str) -> DataFrame:
    return cleaning.invalid_rows(annotated(spark, folder)).select(
        "row_idx", "row.id", "row.date", "row.description", "row.amount", "row.category",
        F.array_join("reasons", "; ").alias("reasons"),
    )


def mark_rows_orders(spark: SparkSession, folder: str) -> DataFrame:
    return cleaning.mark_rows(annotated(spark, folder))


def validation_counts_orders(spark: SparkSession, folder: str) -> DataFrame:
    return cleaning.validation_counts(annotated(spark, folder))


def stored(spark: SparkSession, folder: str) -> DataFrame:
    """The annotated rows, parsed once for operators that read them several times."""
    return write_and_read(annotated(spark, folder), fresh_path(spark, "annotated"))


def dedupe_first_orders(spark: SparkSession, folder: str) -> DataFrame:
    return dedupe.dedupe(cleaning.valid_rows(stored(spark, folder)), Dedupe(["id"], "first"))


def dedupe_last_orders(spark: SparkSession, folder: str) -> DataFrame:
    return dedupe.dedupe(cleaning.valid_rows(stored(spark, folder)), Dedupe(["id"], "last"))


def dedupe_blank_keys_orders(spark: SparkSession, folder: str) -> DataFrame:
    """The raw sheet by two keys, one of which is often blank: such rows are all kept."""
    sheet = derived.messy_sheet(spark, folder).select("row_idx", "category", "paid", "amount")
    return dedupe.dedupe(sheet, Dedupe(["category", "paid"]))


def dedupe_counts_orders(spark: SparkSession, folder: str) -> DataFrame:
    return dedupe.dedupe_counts(valid_orders(spark, folder), Dedupe(["id"]))


def cleanup_report_orders(spark: SparkSession, folder: str) -> DataFrame:
    counts = report.cleanup_counts(annotated(spark, folder), Dedupe(["id"]))
    return report.cleanup_report(counts, RUN_ID, NOW)


def needs_review_orders(spark: SparkSession, folder: str) -> DataFrame:
    return report.needs_review(annotated(spark, folder)).select(
        "section", "row_number", "reason", "values_json"
    )


def cleanup_summary_orders(spark: SparkSession, folder: str) -> DataFrame:
    summary = report.cleanup_summary(stored(spark, folder), Dedupe(["id"]), RUN_ID)

    def rows(column: str):
        return F.array_join(F.transform(column, lambda e: e["row_idx"].cast("string")), ",")

    return summary.select(
        "workflow", "run_id", "counts.*",
        rows("transform_invalid_examples").alias("transform_rows"),
        rows("validation_invalid_examples").alias("validation_rows"),
        F.array_join(
            F.transform("cleaned_preview", lambda j: F.get_json_object(j, "$.id")), ","
        ).alias("cleaned_ids"),
        F.array_join(F.transform("marked_preview", lambda m: m["reasons"]), ";").alias("marked"),
    )


def first_invalid_orders(spark: SparkSession, folder: str) -> DataFrame:
    return dedupe.head(cleaning.invalid_rows(annotated(spark, folder)), 25).select(
        "row_idx", F.array_join("reasons", "; ").alias("reasons")
    )


def category_totals_orders(spark: SparkSession, folder: str) -> DataFrame:
    totals = report.category_totals(valid_orders(spark, folder))
    return totals.withColumn("amount_total", F.round("amount_total", 2))


def row_keys_orders(spark: SparkSession, folder: str) -> DataFrame:
    cells = cleaning.apply_transforms(derived.messy_sheet(spark, folder), SCHEMA, TRANSFORMS)
    keyed = report.with_row_key(
        cells.select("row_idx", "cells.*"), "id", ["date", "description", "category"]
    )
    return keyed.select("row_idx", "row_key")


def normalize_strings_part(spark: SparkSession, folder: str) -> DataFrame:
    part = derived.read(spark, folder, "part")
    raw = F.concat_ws(
        " \t ", F.lit(" "), "p_name", F.concat(F.lit("o'"), "p_type"), F.lit("3rd-x\n")
    )
    cases = {
        "trimmed": text.normalize_string(raw),
        "collapsed": text.normalize_string(raw, trim=False, collapse_spaces=True),
        "lowered": text.normalize_string(raw, collapse_spaces=True, case="lower"),
        "raised": text.normalize_string(raw, collapse_spaces=True, case="upper"),
        "titled": text.normalize_string(raw, collapse_spaces=True, case="title"),
    }
    return part.select("p_partkey", *[c.alias(n) for n, c in cases.items()])


def coerce_cells_lineitem(spark: SparkSession, folder: str) -> DataFrame:
    """Every coercion on texts made from lineitem, with good and bad values."""
    key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    lines = derived.read(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.when(key % 5 == 0, F.concat(F.lit(" "), F.col("l_quantity").cast("int").cast("string"), F.lit(",000")))
        .when(key % 5 == 1, F.concat(F.lit("+"), F.col("l_quantity").cast("int").cast("string"), F.lit("_0.5")))
        .when(key % 5 == 2, F.lit("12f")).when(key % 5 == 3, F.lit("1e2"))
        .alias("number_text"),
        F.when(key % 4 == 0, " YES").when(key % 4 == 1, "f").when(key % 4 == 2, "perhaps")
        .alias("bool_text"),
        F.when(key % 3 == 0, "1996-02-29").when(key % 3 == 1, "1997-02-29").otherwise("1997-2-01")
        .alias("date_text"),
    )
    text_type = StringType()
    return lines.select(
        "l_orderkey", "l_linenumber",
        coerce.to_number(F.col("number_text"), text_type).alias("as_number"),
        coerce.to_bool(F.col("bool_text"), text_type).alias("as_bool"),
        coerce.to_bool(F.col("l_linenumber") - 1, derived.read(spark, folder, "lineitem").schema["l_linenumber"].dataType).alias("number_as_bool"),
        coerce.to_iso_date(F.col("date_text")).alias("as_date"),
        text.is_blank(F.col("bool_text")).alias("no_bool"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        clean_validate_orders, rules_from_config, transform_orders, validate_plain_orders, valid_orders,
        invalid_orders, mark_rows_orders, validation_counts_orders, dedupe_first_orders,
        dedupe_last_orders, dedupe_blank_keys_orders, dedupe_counts_orders, cleanup_report_orders,
        needs_review_orders, cleanup_summary_orders, first_invalid_orders, category_totals_orders,
        row_keys_orders, normalize_strings_part, coerce_cells_lineitem,
    )
}

# ---- SQL ---------------------------------------------------------------------------------------


def strip_sql(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def title_sql(x: str) -> str:
    return (
        f"array_to_string(list_transform(regexp_extract_all({x}, '[A-Za-z]+|[^A-Za-z]+'), "
        "lambda w: upper(w[1]) || lower(w[2:])), '')"
    )


def collapse_sql(x: str) -> str:
    return rf"regexp_replace({strip_sql(x)}, '\s+', ' ', 'g')"


NUMBER_SQL = r"'^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$'"

CELLS_SQL = f"""
sheet AS ({derived.select_sql(derived.MESSY_SHEET, "orders")}),
trimmed AS (
  SELECT *, {collapse_sql('id')} AS s_id, {strip_sql('"date"')} AS s_date,
         {title_sql(collapse_sql('description'))} AS s_description,
         replace({strip_sql('amount')}, ',', '') AS s_amount,
         lower(coalesce({strip_sql('category')}, '')) AS s_category,
         lower({strip_sql('paid')}) AS s_paid
  FROM sheet),
parsed AS (
  SELECT *, strftime(try_strptime(s_date, ['%Y-%m-%d', '%d/%m/%Y', '%m/%d/%Y']), '%Y-%m-%d') AS p_date,
         CASE WHEN regexp_matches(s_amount, {NUMBER_SQL}) THEN try_cast(s_amount AS DOUBLE) END AS p_amount,
         CASE WHEN s_paid IN ('yes', 'true', '1', 'y', 't') THEN true
              WHEN s_paid IN ('no', 'false', '0', 'n', 'f') THEN false END AS p_paid
  FROM trimmed),
cells AS (
  SELECT *, coalesce(p_date, "date") AS c_date,
    concat_ws('; ',
      CASE WHEN s_date = '' THEN 'date: blank' WHEN p_date IS NULL THEN 'date: unparseable date' END,
      CASE WHEN s_amount = '' THEN 'amount: blank'
           WHEN p_amount IS NULL THEN 'amount: could not convert string to float: ''' || s_amount || '''' END
    ) AS t_reasons,
    concat_ws('; ',
      CASE WHEN s_id = '' THEN 'missing_required:id' END,
      CASE WHEN s_date = '' THEN 'missing_required:date' WHEN p_date IS NULL THEN 'type_error:date:date_iso' END,
      CASE WHEN s_description = '' THEN 'missing_required:description' END,
      CASE WHEN s_amount = '' THEN 'missing_required:amount' WHEN p_amount IS NULL THEN 'type_error:amount:number' END,
      CASE WHEN paid IS NULL THEN 'blank_not_allowed:paid' WHEN p_paid IS NULL THEN 'type_error:paid:bool' END
    ) AS v_reasons
  FROM parsed),
valid AS (
  SELECT row_idx, s_id AS id, p_date AS "date", s_description AS description, p_amount AS amount,
         s_category AS category, p_paid AS paid, '' AS status
  FROM cells WHERE v_reasons = '')
"""

RAW_JSON_SQL = """'{"id": ' || to_json(id) || ', "date": ' || to_json("date") || ', "description": ' || to_json(description)
  || ', "amount": ' || to_json(amount) || ', "category": ' || coalesce(to_json(category), 'null')
  || ', "paid": ' || coalesce(to_json(paid), 'null') || '}'"""
CELLS_JSON_SQL = """'{"id": ' || to_json(s_id) || ', "date": ' || to_json(c_date) || ', "description": ' || to_json(s_description)
  || ', "amount": ' || coalesce(CAST(p_amount AS VARCHAR), to_json(amount)) || ', "category": ' || to_json(s_category)
  || ', "paid": ' || coalesce(to_json(paid), 'null') || '}'"""

COUNTS_SQL = """
counts AS (
  SELECT count(*) AS rows_in, count(*) FILTER (v_reasons = '') AS rows_valid_pre_dedupe,
         count(*) FILTER (t_reasons <> '') + count(*) FILTER (v_reasons <> '') AS invalid_count,
         (SELECT count(*) - count(DISTINCT id) FROM valid) AS dedupe_removed
  FROM cells)
"""

_CLEAN_COLUMNS = """row_idx, s_id AS id, CASE WHEN v_reasons LIKE '%:date%' THEN NULL ELSE p_date END AS "date",
  s_description AS description, p_amount AS amount, s_category AS category, p_paid AS paid, '' AS status"""

ORACLES = {
    "clean_validate_orders": f"WITH {CELLS_SQL} SELECT {_CLEAN_COLUMNS}, t_reasons, v_reasons FROM cells",
    "rules_from_config": f"WITH {CELLS_SQL} SELECT {_CLEAN_COLUMNS}, t_reasons, v_reasons FROM cells",
    "transform_orders": f"""WITH {CELLS_SQL}
        SELECT row_idx, s_id AS id, c_date AS "date", s_description AS description, p_amount AS amount,
               s_category AS category, paid, t_reasons FROM cells""",
    "validate_plain_orders": f"""WITH {CELLS_SQL}, plain AS (
        SELECT *, {strip_sql('id')} AS v_id, {strip_sql('description')} AS v_description,
          CASE WHEN regexp_matches(s_date, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') AND try_strptime(s_date, '%Y-%m-%d') IS NOT NULL
               THEN s_date END AS v_date FROM cells)
        SELECT row_idx, v_id AS id, v_date AS "date", v_description AS description, p_amount AS amount, p_paid AS paid,
          concat_ws('|',
            CASE WHEN v_id = '' THEN 'missing_required:id' END,
            CASE WHEN s_date = '' THEN 'missing_required:date' WHEN v_date IS NULL THEN 'type_error:date:date_iso' END,
            CASE WHEN v_description = '' THEN 'missing_required:description' END,
            CASE WHEN s_amount = '' THEN 'missing_required:amount' WHEN p_amount IS NULL THEN 'type_error:amount:number' END,
            CASE WHEN paid IS NULL THEN 'blank_not_allowed:paid' WHEN p_paid IS NULL THEN 'type_error:paid:bool' END
          ) AS reasons FROM plain""",
    "valid_orders": f"WITH {CELLS_SQL} SELECT * FROM valid",
    "invalid_orders": f"""WITH {CELLS_SQL}
        SELECT row_idx, s_id AS id, c_date AS "date", s_description AS description,
               coalesce(CAST(p_amount AS VARCHAR), amount) AS amount, s_category AS category,
               v_reasons AS reasons FROM cells WHERE v_reasons <> ''""",
    "mark_rows_orders": f"""WITH {CELLS_SQL}
        SELECT row_idx, s_id AS id, c_date AS "date", s_description AS description,
               coalesce(CAST(p_amount AS VARCHAR), amount) AS amount, s_category AS category, paid,
               v_reasons = '' AS _valid, replace(v_reasons, '; ', '|') AS _reasons FROM cells""",
    "validation_counts_orders": f"""WITH {CELLS_SQL}
        SELECT count(*) AS rows_in, count(*) FILTER (v_reasons = '') AS rows_valid,
               count(*) FILTER (v_reasons <> '') AS rows_invalid FROM cells""",
    "dedupe_first_orders": f"""WITH {CELLS_SQL}
        SELECT * FROM valid QUALIFY row_number() OVER (PARTITION BY id ORDER BY row_idx) = 1""",
    "dedupe_last_orders": f"""WITH {CELLS_SQL}, ranked AS (
        SELECT *, row_number() OVER (PARTITION BY id ORDER BY row_idx DESC) AS rn,
               min(row_idx) OVER (PARTITION BY id) AS place FROM valid)
        SELECT place AS row_idx, id, "date", description, amount, category, paid, status FROM ranked WHERE rn = 1""",
    "dedupe_blank_keys_orders": f"""WITH {CELLS_SQL}
        SELECT row_idx, category, paid, amount FROM sheet
        QUALIFY category IS NULL OR paid IS NULL
             OR row_number() OVER (PARTITION BY category, paid ORDER BY row_idx) = 1""",
    "dedupe_counts_orders": f"""WITH {CELLS_SQL}
        SELECT count(*) AS rows_in, count(*) - count(DISTINCT id) AS dedupe_removed,
               count(DISTINCT id) AS rows_out FROM valid""",
    "cleanup_report_orders": f"""WITH {CELLS_SQL}, {COUNTS_SQL}
        SELECT CAST(0 AS INTEGER) AS position, 'run_id' AS metric, '{RUN_ID}' AS value
        UNION ALL SELECT 1, 'generated_at_utc', '{NOW}'
        UNION ALL SELECT 2, 'rows_in', CAST(rows_in AS VARCHAR) FROM counts
        UNION ALL SELECT 3, 'rows_valid_pre_dedupe', CAST(rows_valid_pre_dedupe AS VARCHAR) FROM counts
        UNION ALL SELECT 4, 'invalid_count', CAST(invalid_count AS VARCHAR) FROM counts
        UNION ALL SELECT 5, 'dedupe_removed', CAST(dedupe_removed AS VARCHAR) FROM counts
        UNION ALL SELECT 6, 'rows_out', CAST(rows_valid_pre_dedupe - dedupe_removed AS VARCHAR) FROM counts
        UNION ALL SELECT 7, 'invalid_rate', printf('%.4f', invalid_count / rows_in) FROM counts""",
    "needs_review_orders": f"""WITH {CELLS_SQL}
        SELECT CAST(0 AS INTEGER) AS section, CAST(row_idx + 1 AS VARCHAR) AS row_number, t_reasons AS reason,
               {RAW_JSON_SQL} AS values_json FROM cells WHERE t_reasons <> ''
        UNION ALL
        SELECT 1, CAST(row_idx + 1 AS VARCHAR), v_reasons, {CELLS_JSON_SQL} FROM cells WHERE v_reasons <> ''""",
    "cleanup_summary_orders": f"""WITH {CELLS_SQL}, {COUNTS_SQL},
        kept AS (SELECT * FROM valid QUALIFY row_number() OVER (PARTITION BY id ORDER BY row_idx) = 1)
        SELECT 'sheet_cleanup' AS workflow, '{RUN_ID}' AS run_id, rows_in, rows_valid_pre_dedupe, invalid_count,
          dedupe_removed, rows_valid_pre_dedupe - dedupe_removed AS rows_out, invalid_count / rows_in AS invalid_rate,
          (SELECT string_agg(CAST(row_idx AS VARCHAR), ',' ORDER BY row_idx)
             FROM (SELECT row_idx FROM cells WHERE t_reasons <> '' ORDER BY row_idx LIMIT 25)) AS transform_rows,
          (SELECT string_agg(CAST(row_idx AS VARCHAR), ',' ORDER BY row_idx)
             FROM (SELECT row_idx FROM cells WHERE v_reasons <> '' ORDER BY row_idx LIMIT 25)) AS validation_rows,
          (SELECT string_agg(id, ',' ORDER BY row_idx)
             FROM (SELECT row_idx, id FROM kept ORDER BY row_idx LIMIT 10)) AS cleaned_ids,
          (SELECT string_agg(replace(v_reasons, '; ', '|'), ';' ORDER BY row_idx)
             FROM (SELECT row_idx, v_reasons FROM cells ORDER BY row_idx LIMIT 10)) AS marked
        FROM counts""",
    "first_invalid_orders": f"""WITH {CELLS_SQL}
        SELECT row_idx, v_reasons AS reasons FROM cells WHERE v_reasons <> '' ORDER BY row_idx LIMIT 25""",
    "category_totals_orders": f"""WITH {CELLS_SQL}
        SELECT category, count(*) AS rows, round(sum(amount), 2) AS amount_total, grouping(category) = 1 AS is_total
        FROM valid GROUP BY ROLLUP (category)""",
    "row_keys_orders": f"""WITH {CELLS_SQL}
        SELECT row_idx, CASE WHEN s_id = '' THEN sha256(concat_ws(chr(31), c_date, s_description, s_category))
                             ELSE s_id END AS row_key FROM cells""",
    "normalize_strings_part": f"""WITH raw AS (
        SELECT p_partkey, concat_ws(' ' || chr(9) || ' ', ' ', p_name, 'o''' || p_type, '3rd-x' || chr(10)) AS x FROM part)
        SELECT p_partkey, {strip_sql('x')} AS trimmed, {collapse_sql('x')} AS collapsed,
               lower({collapse_sql('x')}) AS lowered, upper({collapse_sql('x')}) AS raised,
               {title_sql(collapse_sql('x'))} AS titled FROM raw""",
    "coerce_cells_lineitem": """WITH lines AS (SELECT *, l_orderkey * 10 + l_linenumber AS k FROM lineitem)
        SELECT l_orderkey, l_linenumber,
          CASE k % 5 WHEN 0 THEN CAST(CAST(l_quantity AS INTEGER) AS DOUBLE) * 1000
                     WHEN 1 THEN CAST(CAST(l_quantity AS INTEGER) AS DOUBLE) * 10 + 0.5
                     WHEN 3 THEN 100.0 END AS as_number,
          CASE k % 4 WHEN 0 THEN true WHEN 1 THEN false END AS as_bool,
          l_linenumber <> 1 AS number_as_bool,
          CASE k % 3 WHEN 0 THEN '1996-02-29' END AS as_date,
          k % 4 = 3 AS no_bool FROM lines""",
}
