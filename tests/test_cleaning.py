import random

import pytest

from ledgerline import ColumnRule, Dedupe, SchemaError, Transforms, schema_from_config
from ledgerline.operators import cleaning, dedupe, extract, report
from ledgerline.plans import sheet_cleanup

SHEET = [
    (0, "A-1", "2026-02-01", "Coffee", "3.50", "Food"),
    (1, "", "2026-02-02", "Taxi", "12.00", None),
    (2, "A-3", "02/03/2026", "Lunch", "9.20", None),
    (3, "A-4", "2026-02-04", "Book", "abc", None),
    (4, "A-1", "02/01/2026", "  coffee  ", "1,200.00", "Food"),
]
COLUMNS = "row_idx long, id string, date string, description string, amount string, category string"
MUST = {"required": True, "allow_blank": False}
RULES = {
    "id": {"type": "string", **MUST}, "date": {"type": "date_iso", **MUST},
    "description": {"type": "string", **MUST}, "amount": {"type": "number", **MUST},
    "category": {"type": "string"}, "status": {"type": "string"},
}
SCHEMA = schema_from_config({"schema": RULES})
TRANSFORMS = Transforms(
    collapse_spaces=True, case={"description": "title", "category": "lower"},
    date_formats=("%Y-%m-%d", "%d/%m/%Y", "%m/%d/%Y"), null_is_absent=True,
)


def annotated(spark, rows=SHEET, partitions=2):
    sheet = spark.createDataFrame(rows, COLUMNS).repartition(partitions)
    return cleaning.validate(cleaning.apply_transforms(sheet, SCHEMA, TRANSFORMS), SCHEMA)


def test_report_of_the_sample_sheet(spark):
    counts = report.cleanup_counts(annotated(spark), Dedupe(["id"]))
    lines = report.cleanup_report(counts, "R", "T").orderBy("position").collect()
    assert [(r["metric"], r["value"]) for r in lines] == [
        ("run_id", "R"), ("generated_at_utc", "T"), ("rows_in", "5"),
        ("rows_valid_pre_dedupe", "3"), ("invalid_count", "3"), ("dedupe_removed", "1"),
        ("rows_out", "2"), ("invalid_rate", "0.6000"),
    ]


@pytest.mark.parametrize("partitions", [1, 8])
def test_needs_review_of_the_sample_sheet(spark, partitions):
    issues = report.needs_review(annotated(spark, partitions=partitions), omit_null=True)
    book = '{"id": "A-4", "date": "2026-02-04", "description": "Book", "amount": "abc"}'
    assert [tuple(r) for r in report.in_report_order(issues).collect()] == [
        ("4", "amount: could not convert string to float: 'abc'", book),
        ("2", "missing_required:id",
         '{"id": "", "date": "2026-02-02", "description": "Taxi", "amount": 12.0}'),
        ("4", "type_error:amount:number", book),
    ]


def test_marked_rows_keep_what_could_not_be_read(spark):
    rows = {r["row_idx"]: r for r in cleaning.mark_rows(annotated(spark)).collect()}
    assert len(rows) == 5
    assert (rows[3]["amount"], rows[3]["_valid"]) == ("abc", False)
    assert rows[3]["_reasons"] == "type_error:amount:number"
    assert (rows[0]["_valid"], rows[0]["_reasons"]) == (True, "")


def test_an_empty_sheet_has_rate_zero(spark):
    counts = report.cleanup_counts(annotated(spark, rows=[]), Dedupe(["id"])).first()
    assert (counts["rows_in"], counts["invalid_rate"]) == (0, 0.0)


def test_a_failed_transform_alone_does_not_make_a_row_invalid(spark):
    sheet = spark.createDataFrame([(0, "")], "row_idx long, amount string")
    schema = [ColumnRule("amount", "number")]
    row = cleaning.validate(cleaning.apply_transforms(sheet, schema, Transforms()), schema).first()
    assert row["t_reasons"] == ["amount: blank"]
    assert row["v_reasons"] == [] and row["clean"]["amount"] is None


def test_codes_of_plain_validation(spark):
    schema = [
        ColumnRule("id", "string", required=True), ColumnRule("note", "string", allow_blank=False),
        ColumnRule("n", "number"), ColumnRule("ok", "bool"), ColumnRule("d", "date_iso"),
        ColumnRule("absent", "string", required=True),
    ]
    rows = [(0, " ", "", "x", "maybe", "02/19/2026"), (1, "a", "b", "1,234.50", "Yes", "2026-02-19")]
    sheet = spark.createDataFrame(
        rows, "row_idx long, id string, note string, n string, ok string, d string"
    )
    bad, good = cleaning.validate(sheet, schema).orderBy("row_idx").collect()
    assert bad["v_reasons"] == [
        "missing_required:id", "blank_not_allowed:note", "type_error:n:number",
        "type_error:ok:bool", "type_error:d:date_iso", "missing_required:absent",
    ]
    assert good["v_reasons"] == ["missing_required:absent"]
    assert tuple(good["clean"])[:5] == ("a", "b", 1234.5, True, "2026-02-19")


def test_schema_from_lists_and_bad_types():
    rules = {"required_columns": ["a"], "optional_columns": ["b"]}
    assert schema_from_config(rules) == [
        ColumnRule("a", "string", True, False), ColumnRule("b", "string", False, True)
    ]
    with pytest.raises(SchemaError):
        schema_from_config({"schema": {"a": {"type": "money"}}})


def brute_dedupe(rows, keep):
    kept, at = [], {}
    for position, key, value in rows:
        if not (key or "").strip():
            kept.append((position, key, value))
        elif key not in at:
            at[key] = len(kept)
            kept.append((position, key, value))
        elif keep == "last":
            kept[at[key]] = (kept[at[key]][0], key, value)
    return sorted(kept)


@pytest.mark.parametrize("keep", ["first", "last"])
@pytest.mark.parametrize("partitions", [1, 7])
def test_dedupe_with_a_hot_key(spark, keep, partitions):
    rng = random.Random(5)
    keys = ["hot"] * 300 + [""] * 150 + [None] * 50 + [f"k{i % 250}" for i in range(400)]
    rng.shuffle(keys)
    rows = [(i, k, f"v{i}") for i, k in enumerate(keys)]
    df = spark.createDataFrame(rows, "row_idx long, id string, v string").repartition(partitions)
    found = [tuple(r) for r in dedupe.dedupe(df, Dedupe(["id"], keep)).collect()]
    assert sorted(found) == brute_dedupe(rows, keep)
    counts = dedupe.dedupe_counts(df, Dedupe(["id"], keep)).first()
    assert counts["dedupe_removed"] == len(rows) - len(found)


def test_copies_collapse_before_the_shuffle(spark):
    df = spark.range(10).selectExpr("id AS row_idx", "'k' AS id")
    plan = dedupe.dedupe(df, Dedupe(["id"]))._jdf.queryExecution().executedPlan().toString()
    assert "partial_min(row_idx" in plan and "SortAggregate" not in plan


def test_plan_writes_and_replaces_outputs(spark, tmp_path):
    sheet = spark.createDataFrame(SHEET, COLUMNS)
    for _ in range(2):
        sheet_cleanup.run(sheet, SCHEMA, TRANSFORMS, Dedupe(["id"]), "r1", "T", str(tmp_path))
    cleaned = spark.read.parquet(f"{tmp_path}/r1/cleaned")
    assert sorted(r["id"] for r in cleaned.collect()) == ["A-1", "A-3"]
    review = spark.read.csv(f"{tmp_path}/r1/needs_review", header=True, escape='"')
    assert review.count() == 3
    outputs = spark.read.parquet(f"{tmp_path}/outputs").collect()
    assert len(outputs) == 4
    assert {r["metadata"] for r in outputs if r["name"] == "needs_review_csv"} == {'{"rows": 3}'}


def pushed_filters(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.split("\n") if "PushedFilters" in line]


def test_filters_reach_the_files(spark, tmp_path):
    spark.createDataFrame(SHEET, COLUMNS).write.parquet(f"{tmp_path}/sheet")
    sheet = spark.read.parquet(f"{tmp_path}/sheet")
    annotated = cleaning.validate(cleaning.apply_transforms(sheet, SCHEMA, TRANSFORMS), SCHEMA)
    assert all("LessThan(row_idx,3)" in line for line in pushed_filters(annotated.where("row_idx < 3")))
    narrow = annotated.select("row_idx")
    assert "ReadSchema: struct<row_idx:bigint>" in narrow._jdf.queryExecution().executedPlan().toString()


def test_filters_on_parsed_mail_reach_the_files(spark, tmp_path):
    rows = [(i, "Amount: 5 USD", "s", "a@b.cc") for i in range(9)]
    spark.createDataFrame(rows, "row_idx long, body string, subject string, `from` string").write.parquet(f"{tmp_path}/mail")
    parsed = extract.parse_mail(spark.read.parquet(f"{tmp_path}/mail"), body="body").where("row_idx < 3")
    assert pushed_filters(parsed) and all("LessThan(row_idx,3)" in line for line in pushed_filters(parsed))
