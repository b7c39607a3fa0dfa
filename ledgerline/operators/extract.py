"""Fields, errors and a confidence score from mail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import mailtext
from ledgerline.functions.text import blank_to_null, mask_emails, nfkc, tidy_lines

# The expected fields, in the order in which they are reported, with their columns.
FIELDS = {
    "name": "customer_name",
    "company": "company_name",
    "email": "customer_email",
    "phone": "customer_phone",
    "amount": "amount_raw",
    "invoice_or_order_id": "reference_id",
}
# The confidence is the share of fields found, less these for each error.
MISSING_COST, AMBIGUOUS_COST, INVALID_COST = 0.08, 0.12, 0.08

INVALID_MESSAGES = {
    "email": "Labeled email is not a valid email format",
    "phone": "Labeled phone value is not a valid phone format",
    "amount": "Labeled amount value is not a valid money format",
}


def with_label_values(df: DataFrame, body: str = "body") -> DataFrame:
    """Add ``labelled``: for each field, all values found under its labels in normalised text."""
    return df.select(
        "*",
        F.struct(
            *[
                mailtext.label_values(F.col(body), labels).alias(field)
                for field, labels in mailtext.LABELS.items()
            ]
        ).alias("labelled"),
    )


def is_ambiguous(values: Column) -> Column:
    return F.size(F.array_distinct(values)) > 1


def _error(code: str, field: str, message: str) -> Column:
    return F.struct(
        F.lit(code).alias("code"), F.lit(field).alias("field"), F.lit(message).alias("message")
    )


def parse_mail(
    df: DataFrame, subject: str = "subject", from_addr: str = "from", body: str = "body"
) -> DataFrame:
    """Add ``parsed`` (struct), ``parse_errors`` (array) and ``confidence``.

    A labelled value wins over one found anywhere in the subject and body. Each search runs once:
    its result is a column, and the later steps refer to the column.
    """
    texts = {"p_subject": subject, "p_from": from_addr, "p_body": body}
    df_cols = df.columns
    df = df.select(
        "*", *[nfkc(F.coalesce(F.col(c), F.lit(""))).alias(name) for name, c in texts.items()]
    )
    df = df.select(
        *df_cols, *[tidy_lines(F.col(name)).alias(name) for name in texts]
    )
    both = F.concat_ws(
        "\n", *[F.when(F.col(c) != "", F.col(c)) for c in ("p_subject", "p_body")]
    )
    df = with_label_values(df.select("*", both.alias("p_all")), "p_body")

    first = {field: F.get(F.col("labelled")[field], 0) for field in FIELDS}
    df = df.select(
        "*",
        F.coalesce(first["name"], mailtext.display_name(F.col("p_from"))).alias("p_name"),
        # A labelled email is kept as written if there is an address in it.
        F.when(mailtext.email_match(first["email"]) != "", first["email"]).alias("p_email"),
        mailtext.first_phone(first["phone"]).alias("p_phone"),
        mailtext.money_match(first["amount"]).alias("p_money"),
    )
    # The whole text is searched only for what no label gave.
    everything = F.col("p_all")
    df = df.select(
        "*",
        F.when(F.col("p_email").isNull(), mailtext.email_match(everything)).alias("m_email"),
        F.when(F.col("p_phone").isNull(), mailtext.phone_match(everything)).alias("m_phone"),
        F.when(
            first["invoice_or_order_id"].isNull(), mailtext.invoice_match(everything)
        ).alias("m_invoice"),
        F.when(F.col("p_money") != "", F.col("p_money"))
        .otherwise(mailtext.money_match(everything))
        .alias("f_money"),
    )
    df = df.select(
        "*",
        F.when(F.col("m_invoice") == "", mailtext.order_match(everything)).alias("m_order"),
        F.when(
            F.col("p_email").isNull() & (F.coalesce("m_email", F.lit("")) == ""),
            mailtext.email_match(F.col("p_from")),
        ).alias("m_sender"),
    )
    df = df.select(
        "*",
        F.coalesce("p_email", *[blank_to_null(F.col(c)) for c in ("m_email", "m_sender")])
        .alias("f_email"),
        F.coalesce("p_phone", mailtext.phone_of_match(F.col("m_phone"))).alias("f_phone"),
        F.coalesce(
            first["invoice_or_order_id"],
            *[blank_to_null(F.col(c)) for c in ("m_invoice", "m_order")],
        ).alias("f_reference"),
    )
    df = df.select("*", mailtext.money_of_match(F.col("f_money")).alias("money"))
    parsed = F.struct(
        F.col("p_name").alias("customer_name"),
        first["company"].alias("company_name"),
        F.col("f_email").alias("customer_email"),
        F.col("f_phone").alias("customer_phone"),
        F.col("money.amount").alias("amount_value"),
        F.col("money.currency").alias("amount_currency"),
        F.col("money.raw").alias("amount_raw"),
        F.col("f_reference").alias("reference_id"),
    )
    rejected = {
        "email": first["email"].isNotNull() & F.col("p_email").isNull(),
        "phone": first["phone"].isNotNull() & F.col("p_phone").isNull(),
        "amount": first["amount"].isNotNull() & (F.col("p_money") == ""),
    }
    df = df.select(*df_cols, "labelled", parsed.alias("parsed"),
                   *[c.alias(f"rejected_{f}") for f, c in rejected.items()])

    # The codes and messages of the errors, and their order.
    errors = []
    for field in FIELDS:
        errors.append(
            F.when(
                is_ambiguous(F.col("labelled")[field]),
                _error("ambiguous_match", field, f"Multiple labeled values found for {field}"),
            )
        )
        if field in rejected:
            errors.append(
                F.when(
                    F.col(f"rejected_{field}"),
                    _error("invalid_format", field, INVALID_MESSAGES[field]),
                )
            )
    for field, column in FIELDS.items():
        errors.append(
            F.when(
                F.col("parsed")[column].isNull(),
                _error("missing_field", field, f"Missing expected field: {field}"),
            )
        )
    df = df.select(*df_cols, "parsed", F.array_compact(F.array(*errors)).alias("parse_errors"))
    df = df.select("*", confidence(F.col("parse_errors")).alias("confidence"))
    return df


def confidence(errors: Column) -> Column:
    def count(code: str) -> Column:
        return F.size(F.filter(errors, lambda e: e["code"] == code))

    missing = count("missing_field")
    score = (
        (len(FIELDS) - missing) / F.lit(float(len(FIELDS)))
        - MISSING_COST * missing
        - AMBIGUOUS_COST * count("ambiguous_match")
        - INVALID_COST * count("invalid_format")
    )
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.round(score, 3)))


def with_aliases(parsed: Column) -> Column:
    """The parsed fields under both their names, and the amount as one struct."""
    amount = F.struct(
        parsed["amount_value"].alias("amount"),
        parsed["amount_currency"].alias("currency"),
        parsed["amount_raw"].alias("raw"),
    )
    canonical = ("customer_name", "company_name", "customer_email", "customer_phone",
                 "amount_value", "amount_currency", "amount_raw", "reference_id")
    return F.struct(
        *[parsed[c].alias(c) for c in canonical],
        *[parsed[c].alias(f) for f, c in FIELDS.items() if f != "amount"],
        F.when(parsed["amount_raw"].isNotNull(), amount).alias("amount"),
    )


def intake_items(decoded: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per decoded message (with headers): what is kept of it, and what was found in it."""
    items = decoded.select(
        *keep,
        "message_id", "thread_id", "internal_date", "from", "to", "subject", "date",
        F.col("text").alias("body_text"),
        F.col("chosen").alias("body_chosen"),
        F.col("warnings").alias("decode_warnings"),
    )
    return parse_mail(items, body="body_text").select(
        *keep,
        "message_id", "thread_id", "internal_date", "from", "to", "subject", "date",
        "body_text", "body_chosen", "decode_warnings",
        "parsed",
        F.col("confidence").alias("parser_confidence"),
        F.col("parse_errors").alias("parser_errors"),
    )


def without_bodies(items: DataFrame) -> DataFrame:
    """What may be shared: ids, sender, subject and the parsed fields, but no body text."""
    return items.select(
        "message_id", "subject", F.col("from").alias("from_addr"),
        "parser_confidence", "parsed", "parser_errors",
    )


def message_index(decoded: DataFrame, mask: bool = False) -> DataFrame:
    """One row per message with an id, with its headers and the kind of body chosen."""

    def shown(c: str) -> Column:
        return (mask_emails(F.col(c)) if mask else F.col(c)).alias(c)

    row = F.struct(F.col("message_id").alias("id"), shown("subject"), shown("from"), "date", "chosen")
    # Not a filter: it would be pushed below the decoding, which it would repeat for each mention of the id.
    return decoded.select(F.inline(F.when(F.col("message_id") != "", F.array(row))))


def body_previews(items: DataFrame, n: int = 10, order: str = "row_idx") -> DataFrame:
    return (
        items.orderBy(order)
        .limit(n)
        .select(
            order, "message_id", "subject",
            F.left("body_text", F.lit(120)).alias("body_preview_120"), "body_chosen",
        )
    )
