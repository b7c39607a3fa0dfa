"""Registered queries against their SQL. ALL_QUERIES=1 adds those that parse the mail once more."""

import os
import re

import compare
import pytest

from __spark_entry__ import entry, oracle_sql, queries

FOLDER = "/root/testdata/sf0.001"
# Each takes about ten seconds, nearly all of it planning, and shares its operators with one that runs.
SIBLINGS = {
    "label_values_mail", "extract_confidence_mail", "field_aliases_mail", "display_names_mail",
    "message_headers", "decode_counts", "message_index_counts", "items_without_bodies",
    "intake_previews", "intake_items", "triage_cells_mail", "attachment_contents",
    "attachment_policy", "attachment_routing_drive", "attachment_manifest", "attachment_summary",
    "attachment_raw_paths", "distinct_messages", "classify_actions", "plan_counts",
    "audit_outcomes", "applied_totals", "manifest_appended", "items_through_jsonl",
}
EVERY = sorted(name for name in oracle_sql() if not re.match(r"op\d+_", name))
NAMES = EVERY if os.environ.get("ALL_QUERIES") else [n for n in EVERY if n not in SIBLINGS]

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")


@pytest.fixture(scope="module")
def tables():
    return compare.connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query_gives_the_rows_of_its_sql(spark, tables, name):
    assert compare.differences(queries()[name](spark, FOLDER), tables, oracle_sql()[name]) == []


def test_all_sql_belongs_to_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() == 8
