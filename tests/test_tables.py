import json
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from ledgerline import AttachmentPolicy, Labels, attachment_policy_from_config
from ledgerline.operators import actions, attachments, audit, positions, triage
from ledgerline.plans import run_audit
from ledgerline.sources import readers, writers


def brute_upsert(existing, news):
    table = [dict(r) for r in existing]
    at = {}
    for i, r in enumerate(table):
        key = r["message_id"].strip()
        if key:
            at.setdefault(key, i)
    for n in news:
        key = n["message_id"].strip()
        if not key:
            continue
        if key in at:
            row = table[at[key]]
            row["subject"], row["message_id"] = n["subject"], key
            row["status"] = row["status"] if row["status"].strip() else "NEW"
        else:
            at[key] = len(table)
            table.append({"message_id": key, "subject": n["subject"], "status": "NEW", "owner": ""})
    return [(r["message_id"], r["subject"], r["status"], r["owner"]) for r in table]


@pytest.mark.parametrize("partitions", [1, 6])
def test_upsert_with_hot_and_repeated_ids(spark, partitions):
    rng = random.Random(3)
    existing = [
        {"message_id": rng.choice(["hot", " hot ", "", f"m{i % 40}"]),
         "status": rng.choice(["DONE", "", " "]), "subject": "old", "owner": f"o{i}"}
        for i in range(200)
    ]
    news = [
        {"message_id": rng.choice(["hot", "", f"m{rng.randrange(80)}", "fresh"]), "subject": f"s{i}"}
        for i in range(150)
    ]
    columns = "row_idx long, message_id string, status string, subject string, owner string"
    table = spark.createDataFrame(
        [(i, r["message_id"], r["status"], r["subject"], r["owner"]) for i, r in enumerate(existing)], columns
    ).repartition(partitions)
    items = spark.createDataFrame(
        [(i, n["message_id"], n["subject"]) for i, n in enumerate(news)],
        "row_idx long, message_id string, subject string",
    ).repartition(partitions)
    cells = items.select(
        "*", *[F.lit("").alias(c) for c in triage.MANAGED if c not in ("message_id", "subject")]
    )
    merged = triage.upsert(table, cells).orderBy("row_idx")
    found = [(r["message_id"], r["subject"], r["status"], r["owner"]) for r in merged.collect()]
    assert found == brute_upsert(existing, news)
    rows = {r["message_id"]: r["sheet_row_id"] for r in triage.sheet_rows(merged).collect()}
    expected = {m.strip(): i + 2 for i, (m, *_) in enumerate(found) if m.strip()}
    assert rows == expected


def brute_names(rows):
    asked, taken, out = {(folder, name) for _, folder, name in rows}, set(), {}
    for position, folder, name in sorted(rows):
        dot = name.rfind(".")
        stem, suffix = (name[:dot], name[dot:]) if 0 < dot < len(name) - 1 else (name, "")
        stored, n = name, 0
        while (folder, stored) in taken or n and (folder, stored) in asked:
            n += 1
            stored = f"{stem}-{n}{suffix}"
        out[position] = stored
        taken.add((folder, stored))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_names_are_given_out_in_turn(spark, seed):
    rng = random.Random(seed)
    names = ["a.pdf", "a-1.pdf", "a-2.pdf", "a-1-1.pdf", "b", "b-1", "c.tar.gz", "a-01.pdf", ".x", "d-1000.txt", "d.txt"]
    rows = [(i * 7, rng.choice(["x", "y"]), rng.choice(names)) for i in range(400)]
    rows += [(5000 + i, "x", "hot.pdf") for i in range(1100)] + [(9000 + i, "x", f"u-{i}.png") for i in range(50)]
    df = spark.createDataFrame(rows, "position long, folder string, safe_name string").repartition(5)
    found = {r["position"]: r["stored_name"] for r in attachments.allocate_names(df).collect()}
    assert found == brute_names(rows)
    folders = {position: folder for position, folder, _ in rows}
    assert len({(folders[p], name) for p, name in found.items()}) == len(rows)


@pytest.mark.parametrize("bits", [0, 3, 20])
def test_sums_and_names_do_not_depend_on_blocks(spark, bits):
    rng = random.Random(bits)
    rows = [(i, "x", rng.choice(["a", "a-1", "a-3", "a-2", "b.c"])) for i in rng.sample(range(-50, 300), 200)]
    df = spark.createDataFrame(rows, "position long, folder string, safe_name string")
    assert {r[0]: r["stored_name"] for r in attachments.allocate_names(df, bits).collect()} == brute_names(rows)
    ranks = positions.with_rank(df, "position", "r", bits=bits).orderBy("position").collect()
    assert [r["r"] for r in ranks] == list(range(200))


def test_bytes_take_no_part_in_shuffles(spark):
    blobs = spark.createDataFrame([("m", "A", "YWJj", 2), ("m", "A", "eHl6", 1), ("m", "B", "B", 1)], "message_id string, attachment_id string, data string, came int")
    listed = spark.createDataFrame([("m", "A"), ("m", "B"), ("m", "C")], "message_id string, attachment_id string")
    found = attachments.with_facts(listed, blobs, "came")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "content#" in plan and plan.index("partial_min") < plan.index("content#")  # below the exchange
    assert {(r["attachment_id"], r["size"], r["sha256"]) for r in found.collect()} == {("A", 3, hashlib.sha256(b"xyz").hexdigest()), ("B", None, None), ("C", None, None)}


def test_policy(spark):
    rows = [("report.pdf", "application/octet-stream", 3), ("r.txt", " TEXT/plain ", 3),
            ("report.exe", "application/x", 3), ("big.pdf", "text/plain", 11), ("none", "", 1)]
    df = spark.createDataFrame(rows, "f string, m string, s long")
    policy = attachment_policy_from_config(
        {"max_size_bytes": "10", "allowed_mime_types": ["Text/Plain"], "allowed_extensions": [".PDF"]}
    )
    columns = (F.col("f"), F.col("m"), F.col("s"))
    found = [r[0] for r in df.select(attachments.policy_reason(policy, *columns)).collect()]
    assert found == ["ok", "ok", "policy_blocked:mime=application/x|ext=.exe",
                     "size_exceeds_limit:11>10", "policy_blocked:mime=?|ext=?"]
    one_list = AttachmentPolicy(None, ("text/plain",))
    assert {r[0] for r in df.select(attachments.policy_reason(one_list, *columns)).collect()} == {"ok"}
    with pytest.raises(ValueError):
        AttachmentPolicy(route_mode="ftp")


def test_actions_and_audit(spark):
    rows = [(0, "m1", True, 0, 0.9, []), (1, "m2", False, 2, 0.9, ["missing_field"]),
            (2, "m1", False, 1, 0.1, ["x"]), (3, "m3", True, 0, 0.2, []), (4, "", False, 1, 0.0, ["x"]),
            (5, "m4", True, 0, 0.9, []), (6, "m5", False, 3, 0.9, [])]
    items = spark.createDataFrame(
        rows, "row_idx long, message_id string, parse_ok boolean, error_count int, confidence double, error_codes array<string>"
    )
    failures = spark.createDataFrame([("m4", "quota")], "message_id string, error string")
    plan = actions.action_plan(items, 0.6)
    assert tuple(actions.plan_counts(plan).first()) == (2, 3)
    found = actions.action_audit(items, Labels("ok", "review", "bad"), "r", "t", archive_on_failure=True, failures=failures)
    seen = {r["message_id"]: (r["outcome"], r["reason"], r["gmail_actions"]) for r in found.collect()}
    assert seen == {
        "m1": ("processed", None, ["label:ok"]),
        "m2": ("needs_review", "needs_review:missing_field", ["label:review", "archive_inbox"]),
        "m3": ("needs_review", "confidence_below_min:0.2<0.6", ["label:review", "archive_inbox"]),
        "m4": ("error", "action_failed:quota", []),
        "m5": ("needs_review", "parse_errors:3", ["label:review", "archive_inbox"]),
        "": ("skipped", "missing_message_id", []),
    }
    assert tuple(actions.outcome_counts(found).first()) == (6, 1, 3, 1, 1)
    good = plan.where("action = 'success'")
    assert actions.needs_review_alert(good, "w", "s", "t").count() == 0
    alert = actions.needs_review_alert(plan, "w", "s", "t", spark.range(700)).first()
    assert (alert["new_needs_review_count"], alert["total_needs_review_count"]) == (3, 700)


@pytest.mark.parametrize("bits", [1, 3, 20])
def test_dense_ranks(spark, monkeypatch, bits):
    monkeypatch.setattr(positions, "BLOCK_BITS", bits)
    rng = random.Random(bits)
    values = rng.sample(range(5000), 300)
    df = spark.createDataFrame([(v, "a" if v % 3 else None) for v in values], "p long, g string")
    ranked = positions.with_rank(positions.with_rank(df, "p", "r"), "p", "gr", ["g"]).collect()
    assert {r["p"]: r["r"] for r in ranked} == {v: i for i, v in enumerate(sorted(values))}
    for group in ("a", None):
        inside = sorted((r["p"], r["gr"]) for r in ranked if r["g"] == group)
        assert [rank for _, rank in inside] == list(range(len(inside)))


def test_rows_of_files_are_numbered_in_file_order(spark, tmp_path):
    for i, n in enumerate((5, 400, 3)):
        (tmp_path / f"part-{i}.csv").write_text("a,b\n" + "".join(f"{i}-{k},x{k}\n" if k % 2 else f"{i}-{k}\n" for k in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        rows = readers.read_sheet(spark, str(tmp_path)).orderBy("row_idx").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["row_idx"] for r in rows] == list(range(408))
    assert [r["a"] for r in rows] == [f"{i}-{k}" for i, n in enumerate((5, 400, 3)) for k in range(n)]
    assert rows[0]["b"] is None


def write_run(folder, run_id, steps=True):
    (folder / run_id).mkdir()
    run = {"run_id": run_id, "workflow": "w", "status": "OK", "started_at": "2026-02-20T00:27:56Z",
           "finished_at": "2026-02-20T00:27:59Z", "duration_ms": 3319, "error_summary": None}
    (folder / run_id / "run.json").write_text(json.dumps(run, indent=2))
    if steps:
        step = {"status": "OK", "started_at": "s", "finished_at": "f", "duration_ms": 1, "error_summary": None}
        listed = [{"step_name": "validate", "metrics": {"b": "x, y: z", "a": 6}, **step}, {"step_name": "clean", **step}]
        (folder / run_id / "steps.json").write_text(json.dumps(listed))


def test_audit_export(spark, tmp_path):
    runs = tmp_path / "runs"
    runs.mkdir()
    write_run(runs, "r1")
    write_run(runs, "r2")
    run_audit.export(spark, str(runs), str(tmp_path / "csv"))
    rows = spark.read.csv(str(tmp_path / "csv"), header=True, escape='"').orderBy("run_id", "step_name").collect()
    assert [(r["run_id"], r["step_name"], r["step_metrics"]) for r in rows] == [
        ("r1", "clean", None), ("r1", "validate", '{"a": 6, "b": "x, y: z"}'),
        ("r2", "clean", None), ("r2", "validate", '{"a": 6, "b": "x, y: z"}'),
    ]
    bundle = run_audit.export(spark, str(runs), str(tmp_path / "json"), "json", "r1").first()
    assert [s["step_name"] for s in bundle["steps"]] == ["validate", "clean"]
    assert bundle["run"]["duration_ms"] == 3319
    write_run(runs, "r3", steps=False)
    with pytest.raises(readers.MissingSummary, match="r3"):
        run_audit.export(spark, str(runs), str(tmp_path / "csv"))


def test_run_status_and_chunks(spark):
    steps = spark.createDataFrame(
        [("a", i, "s", "FAILED" if i == 4 else "OK", "2026-01-01T00:00:00Z", f"2026-01-01T00:00:0{i}Z", 1, "boom" if i == 4 else None, None) for i in range(5)],
        "run_id string, step_position long, step_name string, status string, started_at string, finished_at string, duration_ms long, error_summary string, metrics string",
    )
    runs = audit.run_status(steps)
    row = runs.first()
    assert (row["status"], row["duration_ms"], row["error_summary"]) == ("FAILED", 4000, "boom")
    chunks = audit.run_bundles(runs, steps, steps_per_row=2).orderBy("chunk").collect()
    assert [len(c["steps"]) for c in chunks] == [2, 2, 1]


def test_one_run_is_replaced(spark, tmp_path):
    path = str(tmp_path / "t")
    for run_id, n in (("a", 3), ("b", 2), ("a", 1)):
        writers.write_run_partition(spark.range(n), path, run_id)
    rows = spark.read.parquet(path).groupBy("run_id").count().collect()
    assert {r["run_id"]: r["count"] for r in rows} == {"a": 1, "b": 2}


def test_the_shared_folder_is_the_one_the_session_names(spark, monkeypatch):
    from ledgerline import session

    named = spark.conf.get("spark.checkpoint.dir", None)
    assert session.shared_folder(spark) == (named.rstrip("/") if named else session._own_folder())

    class Unset:
        sparkContext = spark.sparkContext

        class conf:
            get = staticmethod(lambda key, default=None: default)

    assert session.shared_folder(Unset) == session.shared_folder(Unset)
