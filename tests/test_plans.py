"""Plans: cells are parsed once, and what is planned stays small."""

import os
import time

import pytest

from checks import sheets, triage
from ledgerline.operators import cleaning, report

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize(
    "outputs",
    [cleaning.valid_rows, cleaning.invalid_rows, report.needs_review, cleaning.mark_rows],
)
def test_outputs_parse_each_date_once(spark, outputs):
    annotated = sheets.annotated(spark, FOLDER)
    once = plan_of(annotated).count("gettimestamp")
    assert 0 < once <= 10
    assert plan_of(outputs(annotated)).count("gettimestamp") <= once


@pytest.mark.parametrize("query", [sheets.dedupe_first_orders, sheets.dedupe_last_orders])
def test_deduplication_reads_stored_rows(spark, query):
    assert "gettimestamp" not in plan_of(query(spark, FOLDER))


def test_the_alert_is_planned_quickly(spark):
    alert = triage.needs_review_alert(spark, FOLDER)
    start = time.perf_counter()
    plan = plan_of(alert)
    assert time.perf_counter() - start < 5
    assert "scalar-subquery" not in plan
