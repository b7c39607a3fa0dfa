import base64
import datetime
import unicodedata

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ledgerline.functions import coerce, mailtext, mime, text


def evaluate(spark, values, *columns):
    df = spark.createDataFrame(list(enumerate(values)), "i long, c string")
    rows = df.select("i", *[c.alias(f"o{n}") for n, c in enumerate(columns)]).orderBy("i").collect()
    return [tuple(r)[1:] for r in rows]


STRINGS = [
    "  Hello World  ", " Mixed \t  SPACES　 ", "it's o'neil-smith 3rd", "", None, "\x1cé È a\n",
]


def test_strings_as_python_has_them(spark):
    c = F.col("c")
    found = evaluate(
        spark, STRINGS, text.strip(c), text.normalize_string(c, collapse_spaces=True),
        text.normalize_string(c, case="title"), text.is_blank(c),
    )
    for value, (stripped, collapsed, titled, blank) in zip(STRINGS, found, strict=True):
        plain = value or ""
        assert stripped == (None if value is None else plain.strip())
        assert collapsed == " ".join(plain.split())
        assert titled == plain.strip().title()
        assert blank == (plain.strip() == "")


def python_float(value):
    try:
        return float(value.strip().replace(",", ""))
    except ValueError:
        return None


def test_numbers_as_python_has_them(spark):
    values = ["1,234.50", "\t2,000\n", "1_000", "1__0", "_1", "1_", "1d", "1f", "+.5e-3", "5.", ".",
              "-Infinity", "0x10", "1e5", "e5", "abc", "$1", "1 2", ", 5", "1e400"]
    found = evaluate(spark, values, coerce.to_number(F.col("c"), StringType()))
    assert [f[0] for f in found] == [python_float(v) for v in values]


def test_number_reasons(spark):
    values = ["", None, "it's", 'a"b\'', "x\ty", "7"]
    c = F.col("c")
    reason = coerce.number_reason(c, coerce.to_number(c, StringType()), StringType())
    shown = [f[0] for f in evaluate(spark, values, reason)]
    expected = ["blank", "not a number: NoneType"]
    expected += [f"could not convert string to float: {v!r}" for v in values[2:5]] + [None]
    assert shown == expected


def python_date(value, formats):
    for f in formats:
        try:
            return datetime.datetime.strptime(value.strip(), f).date().isoformat()
        except ValueError:
            continue
    return None


@pytest.mark.parametrize("formats", [["%Y-%m-%d"], ["%Y-%m-%d", "%d/%m/%Y", "%m/%d/%Y"], ["%m-%d-%Y"]])
def test_dates_as_python_has_them(spark, formats):
    values = ["2026-02-19", " 19/02/2026 ", "02/13/2026", "02/03/2026", "2/3/2026", "2026-02-30",
              "2026/02/19", "02-19-2026", "26-02-19", "2026-2-9", "0000-01-01", "2026-02-019", ""]
    found = evaluate(spark, values, coerce.to_date_text(F.col("c"), StringType(), formats))
    assert [f[0] for f in found] == [python_date(v, formats) for v in values]


def test_strict_dates_and_bools(spark):
    values = ["2026-02-19", "2026-2-19", "2026-02-30", " 2024-02-29 ", "YES", "0", "maybe", None]
    c = F.col("c")
    found = evaluate(spark, values, coerce.to_iso_date(c), coerce.to_bool(c, StringType()))
    assert [f[0] for f in found] == ["2026-02-19", None, None, "2024-02-29", None, None, None, None]
    assert [f[1] for f in found] == [None, None, None, None, True, False, None, None]


def test_floats_as_python_prints_them(spark):
    values = [0.0, 12.0, 0.26, 1e7, 1234567890.125, 0.0001, 0.00012345, 1e-5, 1.5e16, -3e20, 123456789012345.6]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, d double")
    shown = [r["t"] for r in df.select("i", text.float_text(F.col("d")).alias("t")).orderBy("i").collect()]
    assert shown == [repr(v) for v in values]


def test_stable_characters_never_change():
    for char in text.NFKC_STABLE:
        assert unicodedata.normalize("NFKC", char) == char and unicodedata.combining(char) == 0


def python_tidy(value):
    value = unicodedata.normalize("NFKC", value).replace("\r\n", "\n").replace("\r", "\n")
    value = value.replace("​", "").replace("﻿", "")
    import re

    lines = [re.sub(r"[ \t]+", " ", line).strip() for line in value.split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def test_normalised_text(spark):
    values = ["Ｔｅst ﬁ²", " a\t\tb \r\n\r\n\r\n \r c​ ", "x \x0b\n y\x1c\n", "café \n ok",
              "éa", "", "\n\n a \n \n \n b"]
    found = evaluate(spark, values, text.normalize_text(F.col("c")))
    assert [f[0] for f in found] == [python_tidy(v) for v in values]


def python_base64(value):
    value = value.strip()
    try:
        return base64.urlsafe_b64decode(value + "=" * (-len(value) % 4))
    except ValueError:
        return None


def test_base64_as_python_reads_it(spark):
    values = ["aGVsbG8", "aGVsbG8=", "-_-_", "A", "QUI=QUI=", "QU*JD", "", " aGVsbG8 ", "AA=", "AAA"]
    found = evaluate(spark, values, mime.base64url_bytes(F.col("c")))
    assert [None if f[0] is None else bytes(f[0]) for f in found] == [python_base64(v) for v in values]


def test_mail_expressions(spark):
    values = ["write Zed.X@Mail.Example.org now", "call +1 (415) 555-0189 today", "pay USD 1,249.50",
              "€3,880.00", "total$5 EUR", "Invoice no. INV-7/1 and order PO-1", "order #: PO-556", "12-34 567 89"]
    c = F.col("c")
    found = evaluate(
        spark, values, mailtext.first_email(c), mailtext.first_phone(c),
        mailtext.first_money(c), mailtext.first_reference(c),
    )
    assert found[0][0] == "zed.x@mail.example.org"
    assert found[1][1] == "+14155550189"
    assert tuple(found[2][2]) == (1249.5, "USD", "USD 1,249.50")
    assert tuple(found[3][2]) == (3880.0, None, "3,880.00")
    assert tuple(found[4][2]) == (5.0, "EUR", "$5 EUR")
    assert found[5][3] == "INV-7/1" and found[6][3] == "PO-556"
    assert found[7][1] is None


def test_masking_and_names(spark):
    values = ['"Mina P." <m@x.org>', "a.b@x.org, Q <zz@y.co>", "plain"]
    c = F.col("c")
    found = evaluate(spark, values, text.mask_emails(c), mailtext.display_name(c))
    assert found[0] == ('"Mina P." <m***@x.org>', "Mina P.")
    assert found[1][0] == "a***@x.org, Q <z***@y.co>"
    assert found[2] == ("plain", "plain")


def test_file_names(spark):
    values = ["a/b:c?.tar.gz", " ..x.. ", " ", "n" * 200, ".profile", "noext"]
    c = F.col("c")
    found = evaluate(
        spark, values, text.safe_file_name(c, F.lit("m_1")), text.file_extension(c), text.file_stem(c)
    )
    assert [f[0] for f in found] == ["a_b_c_.tar.gz", "x", "m_1", found[3][0], "profile", "noext"]
    assert len(found[3][0]) == 180 and found[3][0].startswith("n" * 163 + "~")
    long = evaluate(spark, ["x" * 300 + "1.pdf", "x" * 300 + "2.pdf"], text.safe_file_name(c, F.lit("m")))
    assert long[0] != long[1] and all(len(f[0]) == 180 and f[0].endswith(".pdf") for f in long)
    assert [f[1] for f in found] == [".gz", ".", "", "", "", ""]
    assert found[0][2] == "a/b:c?.tar" and found[4][2] == ".profile"
