"""Expressions that find fields in mail text. They expect text from ``text.normalize_text``."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerline.functions.text import WS, WS_SET, blank_to_null, strip

# Fixed patterns: an email address, a phone number, an amount of money, and references.
EMAIL = r"(?U)\b([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})\b"
PHONE = rf"(?U)(?<!\w)\+?\d[\d().\-{WS_SET}]{{7,}}\d(?!\w)"
CODES = "USD|EUR|GBP|INR|AUD|CAD"
MONEY_BODY = (
    rf"(?:({CODES}){WS}*)?([$\u20ac\u00a3])?{WS}*"
    rf"(\d{{1,3}}(?:[ ,]\d{{3}})*(?:\.\d+)?|\d+(?:\.\d+)?){WS}*({CODES})?"
)
MONEY = rf"(?iU)\b{MONEY_BODY}\b"
REFERENCE = (
    rf"(?iU)\b{{word}}(?:{WS}*(?:id|number|no\.?|#))?{WS}*[:#-]?{WS}*([A-Z0-9][A-Z0-9_/-]{{{{1,}}}})"
)
INVOICE = REFERENCE.format(word="invoice")
ORDER = REFERENCE.format(word="order")

# Currency of a symbol.
SYMBOLS = {"$": "USD", "\u20ac": "EUR", "\u00a3": "GBP"}

# The labels under which each field is looked for.
LABELS = {
    "name": ["Name", "Customer Name", "Contact Name"],
    "company": ["Company", "Organization", "Org"],
    "email": ["Email", "Email Address", "Contact Email"],
    "phone": ["Phone", "Phone Number", "Mobile", "Tel", "Telephone"],
    "amount": ["Amount", "Total", "Total Amount", "Invoice Amount", "Payment Amount"],
    "invoice_or_order_id": ["Invoice", "Invoice ID", "Invoice #", "Order", "Order ID", "Order #"],
}


def label_values(text: Column, labels: Sequence[str]) -> Column:
    """All values of lines such as ``Label: value``; the value may stand on the next line."""
    names = "|".join(re.escape(label) for label in labels)
    pattern = rf"(?imdu)^{WS}*(?:{names}){WS}*[:\-]{WS}*([^\n]+?){WS}*$"
    found = F.regexp_extract_all(text, F.lit(pattern), 1)
    return F.filter(F.transform(found, strip), lambda v: v != "")


def email_match(text: Column) -> Column:
    """The first address in lower case; empty or NULL for none."""
    return F.when(F.contains(text, F.lit("@")), F.lower(F.regexp_extract(text, EMAIL, 1)))


def first_email(text: Column) -> Column:
    return blank_to_null(email_match(text))


def phone_of_match(match: Column) -> Column:
    """The digits of a phone match, if there are 10 to 15, with a leading plus sign kept."""
    match = strip(match)
    digits = F.regexp_replace(match, r"(?U)\D", "")
    plus = F.when(F.startswith(match, F.lit("+")), "+").otherwise("")
    return F.when(F.length(digits).between(10, 15), F.concat(plus, digits))


def phone_match(text: Column) -> Column:
    return F.regexp_extract(text, PHONE, 0)


def first_phone(text: Column) -> Column:
    """Only the first phone-like text counts, even if it has too few or too many digits."""
    return phone_of_match(phone_match(text))


def money_match(text: Column) -> Column:
    """The first amount in the text as it stands there, or an empty string."""
    return F.regexp_extract(text, MONEY, 0)


_DIGITS = [
    "".join(each)
    for each in zip(
        *[(c, str(unicodedata.decimal(c))) for c in map(chr, range(128, 0x110000))
          if unicodedata.category(c) == "Nd"],
        strict=True,
    )
]


def money_of_match(match: Column) -> Column:
    """``struct<amount,currency,raw>`` of a match, NULL for none. The match is short, so taking
    it apart again costs little compared with one search of the text per group."""
    whole = rf"(?iU)^{MONEY_BODY}$"
    # Digits of all scripts count, as in the patterns.
    number = F.translate(F.regexp_extract(match, whole, 3), *_DIGITS)
    amount = F.translate(number, " ,", "").try_cast("double")
    symbol = F.regexp_extract(match, whole, 2)
    of_symbol = F.lit(None).cast("string")
    for sign, code in SYMBOLS.items():
        of_symbol = F.when(symbol == sign, code).otherwise(of_symbol)
    currency = F.coalesce(
        blank_to_null(F.upper(F.regexp_extract(match, whole, 4))),
        blank_to_null(F.upper(F.regexp_extract(match, whole, 1))),
        of_symbol,
    )
    found = F.struct(
        amount.alias("amount"), currency.alias("currency"), strip(match).alias("raw")
    )
    return F.when((match != "") & amount.isNotNull(), found)


def first_money(text: Column) -> Column:
    return money_of_match(money_match(text))


def invoice_match(text: Column) -> Column:
    return F.regexp_extract(text, INVOICE, 1)


def order_match(text: Column) -> Column:
    return F.regexp_extract(text, ORDER, 1)


def first_reference(text: Column) -> Column:
    """An invoice id, else an order id."""
    return F.coalesce(blank_to_null(invoice_match(text)), blank_to_null(order_match(text)))


def display_name(from_addr: Column) -> Column:
    """The name in front of the address of a sender; NULL if there is only an address."""
    name = strip(F.substring_index(from_addr, "<", 1))
    name = F.btrim(F.btrim(name, F.lit('"')), F.lit("'"))
    name = F.regexp_replace(name, f"{WS}+", " ")
    is_address = name.rlike(rf"^{EMAIL}\z")
    return F.when((name != "") & ~is_address, name)
