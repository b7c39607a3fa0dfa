"""The stream store: any order of files, empty batches, changed settings."""

import itertools
import json

import pytest
from pyspark.sql import functions as F

from ledgerline.operators.triage import MANAGED, upsert
from ledgerline.session import fresh_path
from ledgerline.streaming.intake import ORDER, TriageStore, start_intake


def cells(spark, batch, rows):
    out = spark.createDataFrame([(batch << 40 | i, *r) for i, r in enumerate(rows)], "row_idx long, message_id string, subject string, sent_at long, cells_hash long")
    from ledgerline.operators.triage import MANAGED
    return out.select("row_idx", *[F.col(c) if c in out.columns else F.lit("").alias(c) for c in MANAGED], *ORDER)


BATCHES = [[("a", "old", 1, 5), ("b", "b", 3, 0)], [], [("a", "new", 9, 5), ("c", "tie1", 4, 1)], [("a", "mid", 5, 5), ("c", "tie2", 4, 2), ("", "none", 1, 1)]]


def table(store):
    return sorted((r["message_id"], r["subject"], r["status"]) for r in store.current().collect())


@pytest.mark.parametrize("order", [(0, 1, 2, 3), (3, 2, 1, 0), (1, 3, 0, 2)])
def test_latest_does_not_depend_on_arrival(spark, order):
    store = TriageStore(spark, fresh_path(spark, "store"), merge_every=2)
    for batch, which in enumerate(order):
        store.add(cells(spark, batch, BATCHES[which]), batch)
    assert table(store) == [("a", "new", "NEW"), ("b", "b", "NEW"), ("c", "tie2", "NEW")]


def test_settings_may_change_and_batches_may_be_repeated(spark):
    root, expected = fresh_path(spark, "store"), [("a", "new", "NEW"), ("b", "b", "NEW"), ("c", "tie2", "NEW")]
    for batch, (which, every) in enumerate(zip((1, 0, 2, 3, 1, 0), (1, 3, 2, 1, 5, 1))):
        store = TriageStore(spark, root, merge_every=every, keep_versions=1)
        store.add(cells(spark, batch, BATCHES[which]), batch)
        store.add(cells(spark, batch, BATCHES[which]), batch)
    assert table(TriageStore(spark, root, 7)) == expected
    assert len(store.versions()) <= 2 and len({r["row_idx"] for r in store.current().collect()}) == 3


def test_files_in_any_order(spark, tmp_path):
    def message(i, key, date):
        return json.dumps({"id": key, "internalDate": str(date), "payload": {"mimeType": "text/plain", "headers": [{"name": "Subject", "value": f"s{i}"}]}})

    results = set()
    for n, order in enumerate(itertools.permutations(range(3))):
        folder = tmp_path / f"in{n}"
        folder.mkdir()
        store = TriageStore(spark, f"file://{tmp_path}/store{n}", merge_every=2)
        for i in order:
            (folder / f"f{i}.txt").write_text("\n".join([message(i, "m", [500, 900, 700][i]), message(i, f"only{i}", 1)]) + "\n")
            start_intake(spark, str(folder), store, f"file://{tmp_path}/check{n}", "r", "t").awaitTermination()
        results.add(tuple((m, s) for m, s, _ in table(store)))
        if n == 3:
            break
    assert results == {(("m", "s1"), ("only0", "s0"), ("only1", "s1"), ("only2", "s2"))}


def test_cells_that_are_not_read_are_not_merged(spark):
    store = TriageStore(spark, fresh_path(spark, "store"), merge_every=2)
    for batch, which in enumerate((0, 2, 3)):
        store.add(cells(spark, batch, BATCHES[which]), batch)
    read = store.current().select("message_id", "subject")
    plan = read._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "gmail_link" in line and "Relation [" not in line]
    assert sorted(tuple(r) for r in read.collect()) == [("a", "new"), ("b", "b"), ("c", "tie2")]


def test_rows_of_the_table_compete_with_cells(spark):
    table = spark.createDataFrame(
        [(0, "a", "own", "DONE", "u1", "9", "1"), (1, "b", "own", "", "u2", "2", "1"), (2, "c", "own", "KEPT", "u3", "", "")],
        "row_idx long, message_id string, subject string, status string, owner string, sent_at string, cells_hash string",
    )
    news = cells(spark, 1, [(" a ", "late", 5, 1), ("b", "later", 30, 1), ("b", "late", 4, 1), ("c", "first", 1, 1), ("d", "d", 1, 1), ("", "none", 1, 1)])
    merged = upsert(table, news, order=ORDER, managed=(*MANAGED, *ORDER), own_positions=True, rivals=F.col("sent_at") != "")
    found = [(r["message_id"], r["subject"], r["status"], r["owner"], r["sent_at"]) for r in merged.orderBy("row_idx").collect()]
    assert found == [("a", "own", "DONE", "u1", "9"), ("b", "later", "NEW", "u2", "30"), ("c", "first", "KEPT", "u3", "1"), ("d", "d", "NEW", "", "1")]
