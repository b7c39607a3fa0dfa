"""Queries on mail that is derived from orders and customers, and on free text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline import derived
from ledgerline.functions import mailtext, text
from ledgerline.operators import decode, extract
from ledgerline.sources.readers import newest

from checks.sheets import strip_sql


def parsed_mail(spark: SparkSession, folder: str) -> DataFrame:
    return extract.parse_mail(derived.mail(spark, folder))


def decoded_messages(spark: SparkSession, folder: str) -> DataFrame:
    messages = derived.messages(derived.mail(spark, folder))
    return decode.decode_bodies(decode.with_headers(decode.with_parts(messages)))


def items(spark: SparkSession, folder: str) -> DataFrame:
    return extract.intake_items(decoded_messages(spark, folder), keep=("row_idx",))


def errors_text(column: str):
    return F.array_join(
        F.transform(column, lambda e: F.concat_ws(":", e["code"], e["field"])), ","
    )


def label_values_mail(spark: SparkSession, folder: str) -> DataFrame:
    mail = derived.mail(spark, folder).select("row_idx", text.normalize_text(F.col("body")).alias("body"))
    found = extract.with_label_values(mail)
    return found.select(
        "row_idx",
        *[F.array_join(F.col("labelled")[f], " | ").alias(f) for f in mailtext.LABELS],
        F.get("labelled.email", 0).alias("first_email"),
        *[
            extract.is_ambiguous(F.col("labelled")[f]).alias(f"{f}_ambiguous")
            for f in ("amount", "invoice_or_order_id")
        ],
    )


def extract_fields_mail(spark: SparkSession, folder: str) -> DataFrame:
    return parsed_mail(spark, folder).select(
        "row_idx", "parsed.*", errors_text("parse_errors").alias("errors")
    )


def extract_confidence_mail(spark: SparkSession, folder: str) -> DataFrame:
    return (
        parsed_mail(spark, folder)
        .groupBy("confidence", F.size("parse_errors").alias("error_count"))
        .agg(F.count(F.lit(1)).alias("messages"))
    )


def field_aliases_mail(spark: SparkSession, folder: str) -> DataFrame:
    parsed = parsed_mail(spark, folder).select(
        "row_idx", extract.with_aliases(F.col("parsed")).alias("f")
    )
    return parsed.select(
        "row_idx", "f.name", "f.company", "f.email", "f.phone", "f.invoice_or_order_id",
        F.col("f.amount.amount").alias("amount"), F.col("f.amount.currency").alias("currency"),
        (F.col("f.name").eqNullSafe(F.col("f.customer_name"))
         & F.col("f.email").eqNullSafe(F.col("f.customer_email"))).alias("alike"),
    )


def display_names_mail(spark: SparkSession, folder: str) -> DataFrame:
    return derived.mail(spark, folder).select(
        "row_idx", mailtext.display_name(F.col("from")).alias("display_name")
    )


def document_contacts(spark: SparkSession, folder: str) -> DataFrame:
    documents = derived.read(spark, folder, "documents")
    return documents.select(
        "doc_id",
        mailtext.first_email(F.col("text")).alias("email"),
        mailtext.first_phone(F.col("text")).alias("phone"),
    )


def document_amounts(spark: SparkSession, folder: str) -> DataFrame:
    documents = derived.read(spark, folder, "documents")
    found = documents.select("doc_id", mailtext.money_match(F.col("text")).alias("m"), "text")
    money = mailtext.money_of_match(F.col("m"))
    return found.select(
        "doc_id", money["amount"].alias("amount"), money["currency"].alias("currency"),
        mailtext.first_reference(F.col("text")).alias("reference"),
    )


def mask_document_emails(spark: SparkSession, folder: str) -> DataFrame:
    documents = derived.read(spark, folder, "documents")
    return documents.select("doc_id", text.mask_emails(F.col("text")).alias("masked"))


def mask_page_emails(spark: SparkSession, folder: str) -> DataFrame:
    pages = derived.read(spark, folder, "pages")
    return pages.select("page_id", text.mask_emails(F.col("html")).alias("masked"))


def normalize_documents(spark: SparkSession, folder: str) -> DataFrame:
    documents = derived.read(spark, folder, "documents")
    return documents.select("doc_id", text.normalize_text(F.col("text")).alias("normalized"))


# Letters and their full-width forms.
PLAIN, WIDE = "abcdefghijklmnopqrstuvwxyz0123456789", "ａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ０１２３４５６７８９"


def compatible_letters(spark: SparkSession, folder: str) -> DataFrame:
    """Texts in full-width letters, with a ligature, a superscript and a letter in two code points."""
    documents = derived.read(spark, folder, "documents")
    odd = F.concat(F.translate("text", PLAIN, WIDE), F.lit(" ﬁ² e\u0301 ①Ⅳ"))
    return documents.select("doc_id", text.nfkc(odd).alias("text"))


def decode_messages(spark: SparkSession, folder: str) -> DataFrame:
    return decoded_messages(spark, folder).select(
        "row_idx", "message_id", "thread_id", "chosen", "text", "text_plain", "text_html",
        F.array_join("warnings", "; ").alias("warnings"),
    )


def message_parts(spark: SparkSession, folder: str) -> DataFrame:
    with_parts = decode.with_parts(derived.messages(derived.mail(spark, folder)))
    parts = decode.extract_parts(with_parts, keep=("row_idx",))
    return parts.select(
        "row_idx", "part_position", "part_path", F.coalesce("mime_type", F.lit("")).alias("mime"),
        F.coalesce("part_id", F.lit("")).alias("part_id"), "size",
    )


def message_headers(spark: SparkSession, folder: str) -> DataFrame:
    with_parts = decode.with_parts(derived.messages(derived.mail(spark, folder)))
    return decode.with_headers(with_parts).select(
        "row_idx", "message_id", "from", "to", "subject", "date"
    )


def list_attachments(spark: SparkSession, folder: str) -> DataFrame:
    with_parts = decode.with_parts(derived.messages(derived.mail(spark, folder)))
    return decode.list_attachments(with_parts, keep=("row_idx", "message_id"))


def decode_counts(spark: SparkSession, folder: str) -> DataFrame:
    found = derived.read(spark, folder, "orders").select("o_orderkey")
    return decode.decode_counts(decoded_messages(spark, folder), found)


def message_index(spark: SparkSession, folder: str) -> DataFrame:
    return extract.message_index(decoded_messages(spark, folder), mask=True)


def message_index_counts(spark: SparkSession, folder: str) -> DataFrame:
    index = extract.message_index(decoded_messages(spark, folder))
    return index.groupBy("chosen").agg(F.count(F.lit(1)).alias("messages"))


def intake_items(spark: SparkSession, folder: str) -> DataFrame:
    return items(spark, folder).select(
        "row_idx", "message_id", "thread_id", "internal_date", "from", "to", "subject", "date",
        "body_text", "body_chosen", F.array_join("decode_warnings", "; ").alias("decode_warnings"),
        "parser_confidence", errors_text("parser_errors").alias("parser_errors"),
    )


def items_without_bodies(spark: SparkSession, folder: str) -> DataFrame:
    shared = extract.without_bodies(items(spark, folder))
    return shared.select(
        "message_id", "subject", "from_addr", "parser_confidence", "parsed.reference_id",
        errors_text("parser_errors").alias("parser_errors"),
    )


def intake_previews(spark: SparkSession, folder: str) -> DataFrame:
    return extract.body_previews(items(spark, folder), 10)


def newest_messages(spark: SparkSession, folder: str) -> DataFrame:
    mail = derived.mail(spark, folder)
    picked = newest(mail, F.col("subject").contains("7"), "internal_date", 40)
    return picked.select("internal_date", "subject")


QUERIES = {
    f.__name__: f
    for f in (
        label_values_mail, extract_fields_mail, extract_confidence_mail, field_aliases_mail,
        display_names_mail, document_contacts, document_amounts, mask_document_emails,
        mask_page_emails, normalize_documents, compatible_letters, decode_messages, message_parts, message_headers,
        list_attachments, decode_counts, message_index, message_index_counts, intake_items,
        items_without_bodies, intake_previews, newest_messages,
    )
}

# ---- SQL ---------------------------------------------------------------------------------------

# The patterns of addresses, phone numbers, amounts and references.
EMAIL = r"\b([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})\b"
PHONE = r"(?:^|[^\pL\pN_])(\+?\p{Nd}[\p{Nd}().\-\s]{7,}\p{Nd})(?:[^\pL\pN_]|$)"
CODES = "USD|EUR|GBP|INR|AUD|CAD"
MONEY = (
    rf"(?:({CODES})\s*)?([$€£])?\s*(\d{{1,3}}(?:[ ,]\d{{3}})*(?:\.\d+)?|\d+(?:\.\d+)?)\s*({CODES})?"
)


def q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def tidy_sql(x: str) -> str:
    x = f"regexp_replace({x}, '[ \\t]+', ' ', 'g')"
    x = f"regexp_replace({x}, '(?m)^ | $', '', 'g')"
    return rf"regexp_replace(regexp_replace({x}, '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"


def labels_sql(x: str, field: str) -> str:
    names = "|".join(mailtext.LABELS[field])
    found = f"regexp_extract_all({x}, {q(rf'(?im)^\s*(?:{names})\s*[:\-]\s*([^\n]+?)\s*$')}, 1)"
    return rf"list_transform({found}, lambda v: regexp_replace(v, '^\s+|\s+$', '', 'g'))"


def found_sql(x: str, pattern: str, group: int = 1) -> str:
    return f"nullif(regexp_extract({x}, {q(pattern)}, {group}), '')"


def phone_sql(x: str) -> str:
    raw = rf"regexp_replace({found_sql(x, PHONE)}, '^\s+|\s+$', '', 'g')"
    digits = rf"regexp_replace({raw}, '[^\p{{Nd}}]', '', 'g')"
    return (
        f"CASE WHEN length({digits}) BETWEEN 10 AND 15 "
        f"THEN CASE WHEN starts_with({raw}, '+') THEN '+' ELSE '' END || {digits} END"
    )


def amount_sql(m: str) -> str:
    return f"try_cast(replace(replace(regexp_extract({m}, {q('(?i)^' + MONEY + '$')}, 3), ' ', ''), ',', '') AS DOUBLE)"


def currency_sql(m: str) -> str:
    whole = q("(?i)^" + MONEY + "$")
    return (
        f"coalesce(nullif(upper(regexp_extract({m}, {whole}, 4)), ''), nullif(upper(regexp_extract({m}, {whole}, 1)), ''), "
        f"CASE regexp_extract({m}, {whole}, 2) WHEN '$' THEN 'USD' WHEN '€' THEN 'EUR' WHEN '£' THEN 'GBP' END)"
    )


REFERENCE = r"(?i)\b{word}(?:\s*(?:id|number|no\.?|#))?\s*[:#-]?\s*([A-Z0-9][A-Z0-9_/-]{{1,}})"


def reference_sql(x: str) -> str:
    return (
        f"coalesce({found_sql(x, REFERENCE.format(word='invoice'))}, "
        f"{found_sql(x, REFERENCE.format(word='order'))})"
    )


NAME_SQL = r"""CASE WHEN contains("from", '<')
  THEN trim(trim(trim(split_part("from", '<', 1)), chr(34)), chr(39)) END"""

MAIL_SQL = f'mail AS ({derived.select_sql(derived.MAIL, derived.ORDERS_WITH_CUSTOMER)})'


def parse_sql(source: str, body: str) -> str:
    """CTEs that end in ``parsed``, for a relation with subject, from and a body column."""
    labels = ", ".join(f"{labels_sql('t_body', f)} AS l_{f}" for f in mailtext.LABELS)

    def error(code: str, field: str, condition: str) -> str:
        return f"CASE WHEN {condition} THEN '{code}:{field}' END"

    invalid = {
        "email": "len(l_email) > 0 AND p_email IS NULL",
        "phone": "len(l_phone) > 0 AND p_phone IS NULL",
        "amount": "len(l_amount) > 0 AND p_money IS NULL",
    }
    listed = []
    for field in mailtext.LABELS:
        listed.append(error("ambiguous_match", field, f"len(list_distinct(l_{field})) > 1"))
        if field in invalid:
            listed.append(error("invalid_format", field, invalid[field]))
    for field, column in extract.FIELDS.items():
        listed.append(error("missing_field", field, f"{column} IS NULL"))

    def count(code: str) -> str:
        return f"len(list_filter(error_list, lambda e: starts_with(e, '{code}')))"

    return f"""
tidy AS (SELECT *, {tidy_sql(body)} AS t_body, {tidy_sql('subject')} AS t_subject FROM {source}),
labelled AS (SELECT *, concat_ws(chr(10), nullif(t_subject, ''), nullif(t_body, '')) AS everything, {labels} FROM tidy),
firsts AS (SELECT *,
    CASE WHEN regexp_matches(l_email[1], {q(EMAIL)}) THEN l_email[1] END AS p_email,
    {phone_sql('l_phone[1]')} AS p_phone,
    {found_sql('l_amount[1]', '(?i)' + chr(92) + 'b' + MONEY + chr(92) + 'b', 0)} AS p_money FROM labelled),
fields AS (SELECT *,
    coalesce(l_name[1], {NAME_SQL}) AS customer_name,
    l_company[1] AS company_name,
    coalesce(p_email, lower({found_sql('everything', EMAIL)}), lower({found_sql('"from"', EMAIL)})) AS customer_email,
    coalesce(p_phone, {phone_sql('everything')}) AS customer_phone,
    coalesce(p_money, {found_sql('everything', '(?i)' + chr(92) + 'b' + MONEY + chr(92) + 'b', 0)}) AS money,
    coalesce(l_invoice_or_order_id[1], {reference_sql('everything')}) AS reference_id FROM firsts),
amounts AS (SELECT *, {amount_sql('money')} AS amount_value, {currency_sql('money')} AS amount_currency,
    {strip_sql('money')} AS amount_raw FROM fields),
listed AS (SELECT *, list_filter([{', '.join(listed)}], lambda e: e IS NOT NULL) AS error_list FROM amounts),
parsed AS (SELECT *, array_to_string(error_list, ',') AS errors,
    least(1.0, greatest(0.0, round((6 - {count('missing')}) / 6.0 - 0.08 * {count('missing')}
      - 0.12 * {count('ambiguous')} - 0.08 * {count('invalid')}, 3)))::DOUBLE AS confidence FROM listed)"""


PARSED_MAIL_SQL = f"{MAIL_SQL}, {parse_sql('mail', 'body')}"

DECODED_SQL = f"""{MAIL_SQL},
shapes AS (SELECT *, CASE WHEN row_idx % 41 = 0 THEN 5 WHEN row_idx % 43 = 0 THEN 6 ELSE row_idx % 5 END AS shape FROM mail),
decoded AS (SELECT * EXCLUDE ("from", "to", subject, "date"),
    CASE WHEN shape = 5 THEN '' ELSE "from" END AS "from", CASE WHEN shape = 5 THEN '' ELSE "to" END AS "to",
    CASE WHEN shape = 5 THEN '' ELSE subject END AS subject, CASE WHEN shape = 5 THEN '' ELSE "date" END AS "date",
    CASE WHEN shape IN (0, 1, 3) THEN 'plain' WHEN shape IN (2, 4) THEN 'html' ELSE 'none' END AS chosen,
    CASE WHEN shape IN (0, 1, 3) THEN body WHEN shape IN (2, 4) THEN '<pre>' || body || '</pre>' ELSE '' END AS text,
    CASE WHEN shape IN (0, 1, 3) THEN body WHEN shape = 4 THEN '  ' END AS text_plain,
    CASE WHEN shape IN (1, 2, 3, 4) THEN '<pre>' || body || '</pre>' END AS text_html,
    CASE WHEN shape = 6 THEN 'invalid base64url data near ''A''' ELSE '' END AS warnings FROM shapes)"""
PARSED_ITEMS_SQL = f"{DECODED_SQL}, {parse_sql('decoded', 'text')}"

ATTACHMENTS_SQL = f"""{DECODED_SQL},
attachments AS (
  SELECT row_idx, message_id, CAST(0 AS INTEGER) AS attachment_position, '1.0' AS part_id,
         'att-' || row_idx || '-a' AS attachment_id, 'invoice.pdf' AS filename, 'application/pdf' AS mime_type,
         length('invoice ' || row_idx % 100) AS size_estimate, 'invoice ' || row_idx % 100 AS content
  FROM decoded WHERE shape = 3
  UNION ALL SELECT row_idx, message_id, 1, '1.1', 'att-' || row_idx || '-b', 'scan: ' || row_idx % 50 || '?.png',
         'image/png', 4 * (row_idx % 30), repeat('png ', row_idx % 30) FROM decoded WHERE shape = 3
  UNION ALL SELECT row_idx, message_id, 2, '1.2', 'att-' || row_idx || '-c', 'setup' || row_idx % 7 || '.exe',
         'application/octet-stream', 6, 'binary' FROM decoded WHERE shape = 3)"""

_MASK = r"regexp_replace({}, '([A-Za-z0-9._%+-])[A-Za-z0-9._%+-]*@([A-Za-z0-9.-]+\.[A-Za-z]{{2,}})', '\1***@\2', 'g')"


def _parts_of(shape: int, rows: list[tuple[str, str, str, str]]) -> str:
    return " UNION ALL ".join(
        f"SELECT row_idx, CAST({i} AS INTEGER) AS part_position, '{path}' AS part_path, '{mime}' AS mime, "
        f"'{part_id}' AS part_id, {size} AS size FROM shapes WHERE shape = {shape}"
        for i, (path, mime, part_id, size) in enumerate(rows)
    )


_NONE = "CAST(NULL AS BIGINT)"
_PARTS_SQL = " UNION ALL ".join(
    [
        _parts_of(0, [("", "text/plain", "", _NONE)]),
        _parts_of(1, [("", "multipart/alternative", "", _NONE), ("000", "text/plain", "", _NONE), ("001", "text/html", "", _NONE)]),
        _parts_of(2, [("", "text/html", "", _NONE)]),
        _parts_of(3, [
            ("", "multipart/mixed", "", _NONE), ("000", "multipart/alternative", "", _NONE),
            ("000.000", "text/plain", "", _NONE), ("000.001", "text/html", "", _NONE),
            ("001", "multipart/related", "", _NONE),
            ("001.000", "application/pdf", "1.0", "length('invoice ' || row_idx % 100)"),
            ("001.001", "", "1.1", "4 * (row_idx % 30)"), ("002", "application/octet-stream", "1.2", "6"),
        ]),
        _parts_of(4, [("", "multipart/alternative", "", _NONE), ("000", "text/plain", "", _NONE), ("001", "text/html", "", _NONE)]),
        _parts_of(6, [("", "text/plain", "", _NONE)]),
    ]
)

ORACLES = {
    "label_values_mail": f"""WITH {PARSED_MAIL_SQL}
        SELECT row_idx, {', '.join(f"array_to_string(l_{f}, ' | ') AS {f}" for f in mailtext.LABELS)},
               l_email[1] AS first_email, len(list_distinct(l_amount)) > 1 AS amount_ambiguous,
               len(list_distinct(l_invoice_or_order_id)) > 1 AS invoice_or_order_id_ambiguous FROM parsed""",
    "extract_fields_mail": f"""WITH {PARSED_MAIL_SQL}
        SELECT row_idx, customer_name, company_name, customer_email, customer_phone, amount_value, amount_currency,
               amount_raw, reference_id, errors FROM parsed""",
    "extract_confidence_mail": f"""WITH {PARSED_MAIL_SQL}
        SELECT confidence, CAST(len(error_list) AS INTEGER) AS error_count, count(*) AS messages FROM parsed GROUP BY ALL""",
    "field_aliases_mail": f"""WITH {PARSED_MAIL_SQL}
        SELECT row_idx, customer_name AS name, company_name AS company, customer_email AS email,
               customer_phone AS phone, reference_id AS invoice_or_order_id, amount_value AS amount,
               amount_currency AS currency, true AS alike FROM parsed""",
    "display_names_mail": f"WITH {MAIL_SQL} SELECT row_idx, {NAME_SQL} AS display_name FROM mail",
    "document_contacts": f"""SELECT doc_id, lower({found_sql('text', EMAIL)}) AS email, {phone_sql('text')} AS phone
        FROM documents""",
    "document_amounts": f"""WITH found AS (SELECT doc_id, text,
          {found_sql('text', '(?i)' + chr(92) + 'b' + MONEY + chr(92) + 'b', 0)} AS m FROM documents)
        SELECT doc_id, {amount_sql('m')} AS amount, {currency_sql('m')} AS currency,
               {reference_sql('text')} AS reference FROM found""",
    "mask_document_emails": f"SELECT doc_id, {_MASK.format('text')} AS masked FROM documents",
    # The documents have no character that compatibility normalisation and the canonical one treat
    # differently.
    "normalize_documents": f"SELECT doc_id, {tidy_sql('nfc_normalize(text)')} AS normalized FROM documents",
    "mask_page_emails": f"SELECT page_id, {_MASK.format('html')} AS masked FROM pages",
    "decode_messages": f"""WITH {DECODED_SQL}
        SELECT row_idx, message_id, thread_id, chosen, text, text_plain, text_html, warnings FROM decoded""",
    "message_parts": f"WITH {DECODED_SQL} {_PARTS_SQL}",
    "message_headers": f"""WITH {DECODED_SQL}
        SELECT row_idx, message_id, "from", "to", subject, "date" FROM decoded""",
    "list_attachments": f"""WITH {ATTACHMENTS_SQL}
        SELECT row_idx, message_id, attachment_position, part_id, attachment_id, filename, mime_type, size_estimate
        FROM attachments""",
    "decode_counts": f"""WITH {DECODED_SQL}
        SELECT (SELECT count(*) FROM orders) AS ids_found, count(*) AS fetched_count,
               count(*) FILTER (chosen = 'plain') AS decoded_plain_count,
               count(*) FILTER (chosen = 'html') AS decoded_html_count,
               count(*) FILTER (chosen = 'none') AS decoded_none_count FROM decoded""",
    "message_index": f"""WITH {DECODED_SQL}
        SELECT message_id AS id, subject, {_MASK.format('"from"')} AS "from", "date", chosen
        FROM decoded WHERE message_id <> ''""",
    "message_index_counts": f"""WITH {DECODED_SQL}
        SELECT chosen, count(*) AS messages FROM decoded WHERE message_id <> '' GROUP BY chosen""",
    "intake_items": f"""WITH {PARSED_ITEMS_SQL}
        SELECT row_idx, message_id, thread_id, internal_date, "from", "to", subject, "date", text AS body_text,
               chosen AS body_chosen, warnings AS decode_warnings, confidence AS parser_confidence,
               errors AS parser_errors FROM parsed""",
    "compatible_letters": "SELECT doc_id, text || ' fi2 é 1IV' AS text FROM documents",
    "items_without_bodies": f"""WITH {PARSED_ITEMS_SQL}
        SELECT message_id, subject, "from" AS from_addr, confidence AS parser_confidence, reference_id,
               errors AS parser_errors FROM parsed""",
    "intake_previews": f"""WITH {DECODED_SQL}
        SELECT row_idx, message_id, subject, left(text, 120) AS body_preview_120, chosen AS body_chosen
        FROM decoded ORDER BY row_idx LIMIT 10""",
    "newest_messages": f"""WITH {MAIL_SQL}
        SELECT internal_date, subject FROM mail WHERE contains(subject, '7') ORDER BY internal_date DESC LIMIT 40""",
}
