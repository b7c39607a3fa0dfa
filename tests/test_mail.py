import base64
import json

import pytest

from ledgerline import AttachmentPolicy, Labels
from ledgerline.operators import decode, extract
from ledgerline.plans import mail_intake


def b64(value):
    return base64.urlsafe_b64encode(value.encode()).decode().rstrip("=")


def part(mime, value):
    return {"mimeType": mime, "body": {"data": b64(value)}}


def decoded(spark, messages):
    rows = [(i, m if isinstance(m, str) else json.dumps(m)) for i, m in enumerate(messages)]
    df = spark.createDataFrame(rows, "row_idx long, json string")
    found = decode.decode_bodies(decode.with_headers(decode.with_parts(df)))
    return {r["row_idx"]: r for r in found.collect()}, df


def deep_message(levels):
    payload = part("text/plain", "deepest é")
    for i in range(levels):
        payload = {"mimeType": "multipart/mixed", "parts": [payload, part("text/plain", f"t{i}")]}
    return {"id": "deep", "payload": payload}


@pytest.mark.parametrize("levels", [1, 3, 4, 5, 6, 40])
def test_trees_of_any_depth(spark, levels):
    rows, _ = decoded(spark, [deep_message(levels)])
    assert rows[0]["text"].split("\n\n") == ["deepest é"] + [f"t{i}" for i in range(levels)]
    assert len(rows[0]["parts"]) == 2 * levels + 1


def test_choice_of_body(spark):
    rows, _ = decoded(spark, [
        {"id": "a", "payload": {"parts": [part("text/plain", "p"), part("text/html", "<p>")]}},
        {"id": "b", "payload": {"parts": [part("text/plain", "   "), part("text/html", "<p>")]}},
        {"id": "c"},
        {"id": "d", "payload": {"mimeType": "text/plain", "body": {"data": "A"}}},
        {"id": "e", "payload": {"body": {"data": b64("no type")}}},
        {"id": "f", "payload": {"mimeType": "text/plain", "body": {"data": "gICA"}}},
    ])
    assert [rows[i]["chosen"] for i in range(6)] == ["plain", "html", "none", "none", "plain", "plain"]
    assert rows[1]["text_plain"] == "   " and rows[1]["text"] == "<p>"
    assert rows[2]["text"] == "" and rows[2]["warnings"] == []
    assert rows[3]["warnings"] == ["invalid base64url data near 'A'"]
    assert rows[5]["text"] == "���"


def test_malformed_messages_give_warnings(spark):
    rows, _ = decoded(spark, [
        "not json", {"payload": 5}, {"payload": {"parts": "x"}}, {"payload": {"body": 7}},
        {"payload": {"parts": ["x", part("", "ok")]}}, {"payload": {"body": {"data": 5}}},
    ])
    assert [rows[i]["warnings"] for i in range(6)] == [
        ["malformed message: expected dict"],
        ["malformed message payload: expected dict"],
        ["malformed MIME structure: parts must be a list"],
        ["malformed body: expected dict"],
        ["malformed MIME structure: part entry must be a dict"],
        ["malformed body data: expected string"],
    ]
    assert rows[4]["text"] == "ok"


def test_attachments_and_headers(spark):
    message = {
        "id": "m", "payload": {
            "headers": [{"name": "X"}, {"name": " SUBJECT ", "value": "s1"}, {"name": "Subject", "value": "s2"}],
            "parts": [
                {"partId": "1", "filename": " a.pdf ", "mimeType": "application/pdf; x=1",
                 "body": {"attachmentId": "A", "size": "12"}},
                {"body": {"attachmentId": "B", "size": 2.5}, "headers": [
                    {"name": "content-type", "value": "image/png; name=\"c.png\""},
                    {"name": "Content-Disposition", "value": "attachment; filename*=UTF-8''d.png"}]},
                {"body": {"attachmentId": "  "}},
            ],
        },
    }
    rows, df = decoded(spark, [message])
    assert rows[0]["subject"] == "s1"
    found = decode.list_attachments(decode.with_parts(df)).orderBy("attachment_position").collect()
    assert [tuple(r)[2:] for r in found] == [
        ("1", "A", "a.pdf", "application/pdf", 12), (None, "B", "d.png", "image/png", None)
    ]


LABELLED = """Hello,
Name: Ann Lee
Company: North Supplies
Email:
    ann@north.example
Phone :  (213) 555 0114
Amount: USD 1,200.00
Amount: USD 1,450.00
Order # : BR-90210-A
"""


def parsed(spark, body, subject="Test", sender="sender@example.com"):
    df = spark.createDataFrame([(subject, sender, body)], "subject string, `from` string, body string")
    return extract.parse_mail(df).first()


def test_labelled_mail(spark):
    row = parsed(spark, LABELLED)
    assert tuple(row["parsed"]) == (
        "Ann Lee", "North Supplies", "ann@north.example", "2135550114", 1200.0, "USD",
        "USD 1,200.00", "BR-90210-A",
    )
    assert [(e["code"], e["field"]) for e in row["parse_errors"]] == [("ambiguous_match", "amount")]
    assert row["confidence"] == 0.88


def test_unlabelled_mail(spark):
    body = "Reach me at Av.Choi@client.example or +1 646 555 0127.\nTotal due is 780.00."
    row = parsed(spark, body)
    assert row["parsed"]["customer_email"] == "av.choi@client.example"
    assert row["parsed"]["customer_phone"] == "+16465550127"
    assert row["parsed"]["amount_value"] == 1646555.0
    assert [e["field"] for e in row["parse_errors"]] == ["name", "company", "invoice_or_order_id"]
    assert row["confidence"] == 0.26


def test_bad_labelled_values_and_senders(spark):
    body = "Email: none\nPhone: 12\nAmount: tbd"
    row = parsed(spark, body, subject="", sender='"Zoe K." <zoe@x.io>')
    assert row["parsed"]["customer_name"] == "Zoe K."
    assert row["parsed"]["customer_email"] == "zoe@x.io"
    codes = [(e["code"], e["field"]) for e in row["parse_errors"]]
    assert codes[:3] == [("invalid_format", f) for f in ("email", "phone", "amount")]
    assert row["confidence"] == pytest.approx(max(0, round(3 / 6 - 0.08 * 3 - 0.08 * 3, 3)))


def test_intake_plan_can_be_repeated(spark, tmp_path):
    messages = [
        {"id": "m1", "threadId": "t", "payload": {
            "headers": [{"name": "From", "value": "a@b.cc"}, {"name": "Subject", "value": "S"}],
            "parts": [part("text/plain", LABELLED), {"partId": "2", "filename": "a.pdf",
                      "mimeType": "application/pdf", "body": {"attachmentId": "A", "size": 3}}]}},
        {"id": "m2", "payload": part("text/plain", "nothing here")},
        {"id": "m1", "payload": part("text/plain", "later copy")},
    ]
    df = spark.createDataFrame([(i, json.dumps(m)) for i, m in enumerate(messages)], "row_idx long, json string")
    blobs = spark.createDataFrame([("m1", "A", b64("pdf"))], "message_id string, attachment_id string, data string")
    existing = spark.createDataFrame(
        [(0, "m2", "DOING", "x")], "row_idx long, message_id string, status string, owner string"
    )

    def run(run_id, table):
        options = mail_intake.IntakeOptions(
            Labels("ok", "review", "bad"), run_id, "now", policy=AttachmentPolicy(), alerts=True
        )
        return mail_intake.run(df, table, options, str(tmp_path), blobs)

    first = run("r1", existing)
    second = run("r2", first["triage"])
    volatile = ("last_run_id", "updated_at")
    tables = [
        sorted(tuple(r) for r in run_["triage"].drop(*volatile).collect()) for run_ in (first, second)
    ]
    assert tables[0] == tables[1]
    rows = {r["message_id"]: r for r in first["triage"].collect()}
    assert (rows["m2"]["status"], rows["m2"]["owner"], rows["m1"]["status"]) == ("DOING", "x", "NEW")
    audit = {r["message_id"]: r for r in first["triage_audit"].collect()}
    assert audit["m1"]["outcome"] == "needs_review" and audit["m1"]["sheet_row_id"] == 3
    assert first["attachment_totals"].first()["attachments_routed"] == 1
    assert first["needs_review_alert"].first()["new_needs_review_count"] == 2
    assert first["attachments"].first()["saved_path"] == "attachments/routed/a.pdf"

    def contents(outputs):
        return {name: sorted(map(repr, df.collect())) for name, df in outputs.items()}

    before = contents(first)
    assert contents(run("r1", existing)) == before
    assert len(before["attachment_manifest"]) == 1 and "pdf" in before["attachment_contents"][0]
    listed = spark.read.parquet(f"{tmp_path}/outputs").where("run_id = 'r1'")
    assert listed.count() == listed.select("name").distinct().count() == 11
    failed = spark.createDataFrame([("m2", "timeout")], "message_id string, error string")
    options = mail_intake.IntakeOptions(Labels("ok", "review", "bad"), "r3", "now", policy=AttachmentPolicy())
    third = mail_intake.run(df, existing, options, str(tmp_path), blobs, list_failures=failed)
    assert third["attachment_totals"].first()["attachments_errors"] == 1


def flat(spark, messages):
    df = spark.createDataFrame([(i, json.dumps(m)) for i, m in enumerate(messages)], "row_idx long, json string")
    rows = decode.with_parts(df).orderBy("row_idx").collect()
    return [[p.asDict(recursive=True) for p in r["parts"]] for r in rows]


def test_both_ways_to_read_a_message_agree(spark):
    """The same parts, once in a shallow tree and once beside one that is deeper than the schema."""
    odd = [
        part("text/plain", "x"), part("TEXT/html; charset=x", "<p>y</p>"), {}, {"partId": 7, "filename": None},
        {"mimeType": 5, "body": {"size": " 12 ", "attachmentId": "A"}}, {"body": {"size": 2.5, "data": "", "attachmentId": 3}},
        {"headers": [{"name": None, "value": "v"}, {"value": "only"}, {"name": "n"}], "filename": ""},
        {"headers": [], "parts": []}, {"parts": [{"body": {}}, {"mimeType": "a/b", "parts": [{"filename": "in"}]}]},
    ]
    deep = {"parts": [{"parts": [{"parts": [{"parts": [{"filename": "below"}]}]}]}]}
    shallow = flat(spark, [{"id": "m", "payload": {"parts": [p]}} for p in odd])
    beside = flat(spark, [{"id": "m", "payload": {"parts": [p, deep]}} for p in odd])
    for one, two in zip(shallow, beside, strict=True):
        assert [p for p in two if p["path"][:1] != [1]] == one


def test_digits_of_all_scripts(spark):
    row = parsed(spark, "Amount: \u0661\u0662\u0663 USD", subject="")
    assert row["parsed"]["amount_value"] == 123.0
