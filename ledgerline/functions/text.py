"""String expressions: trimming, case, printing of values, masking and normalisation."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The characters counted as white space, for trimming and (as a class) in patterns.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WS_SET = r"\t\n\x0B\f\r\x1C-\x1F \x85\xA0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WS = f"[{WS_SET}]"

# Characters above ASCII that compatibility normalisation leaves alone in any company: the plain
# Latin-1 letters and signs, and common typographic marks. Texts without others skip Python.
NFKC_STABLE = (
    "".join(
        chr(n) for n in range(0x80, 0x100)
        if n not in (0xA0, 0xA8, 0xAA, 0xAF, 0xB2, 0xB3, 0xB4, 0xB5, 0xB8, 0xB9, 0xBA, 0xBC, 0xBD, 0xBE)
    )
    + "\u2013\u2014\u2018\u2019\u201c\u201d\u20ac"
)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed once however often ``use`` refers to it."""
    return F.get(F.transform(F.array(value), use), 0)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def is_blank(c: Column) -> Column:
    """NULL, empty, or nothing but white space."""
    return c.isNull() | (strip(c) == "")


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def title_case(c: Column) -> Column:
    """Upper-case the first letter after every non-letter, lower-case the other letters.

    ``initcap`` starts words after spaces only, so other non-letters get a marked space for it.
    """
    mark = "\ue000 "
    marked = F.regexp_replace(c, r"([^\p{L} ])(?=\p{L})", f"$1{mark}")
    return F.replace(F.initcap(marked), F.lit(mark), F.lit(""))


def single_spaces(c: Column) -> Column:
    """Every run of white space as one space."""
    other = WHITESPACE.replace(" ", "")
    return F.regexp_replace(F.translate(c, other, " " * len(other)), " {2,}", " ")


def normalize_string(
    c: Column, *, trim: bool = True, collapse_spaces: bool = False, case: str = "none"
) -> Column:
    """Clean one cell. NULL becomes the empty string; collapsing also trims."""
    out = F.coalesce(c.cast("string"), F.lit(""))
    if trim or collapse_spaces:
        out = strip(out)
    if collapse_spaces:
        out = single_spaces(out)
    change = {"lower": F.lower, "upper": F.upper, "title": title_case}.get(case)
    return change(out) if change else out


def quoted(c: Column) -> Column:
    """The text as it is shown in error reasons: quoted, with escapes."""
    body = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for char, shown in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        body = F.replace(body, F.lit(char), F.lit(shown))
    has_single, has_double = F.contains(c, F.lit("'")), F.contains(c, F.lit('"'))
    return F.when(
        has_single & ~has_double, F.concat(F.lit('"'), body, F.lit('"'))
    ).otherwise(F.concat(F.lit("'"), F.replace(body, F.lit("'"), F.lit("\\'")), F.lit("'")))


def float_text(c: Column) -> Column:
    """A double printed with the fewest digits, in plain notation from 1e-4 up to 1e16."""
    size = F.abs(c)
    java = c.cast("string")
    plain = F.rtrim(c.cast("decimal(38,21)").cast("string"), F.lit("0"))
    plain = F.when(F.endswith(plain, F.lit(".")), F.concat(plain, F.lit("0"))).otherwise(plain)
    mantissa = F.regexp_replace(F.substring_index(java, "E", 1), r"\.0$", "")
    power = F.substring_index(java, "E", -1).try_cast("int")
    scientific = F.concat(
        mantissa,
        F.when(power < 0, "e-").otherwise("e+"),
        F.when(F.abs(power) < 10, "0").otherwise(""),
        F.abs(power).cast("string"),
    )
    return (
        F.when(F.isnan(c), "nan")
        .when(size == float("inf"), F.when(c > 0, "inf").otherwise("-inf"))
        .when(((size >= 1e-3) & (size < 1e7)) | (c == 0), java)
        .when((size >= 1e-4) & (size < 1e16), plain)
        .otherwise(scientific)
    )


def json_text(c: Column) -> Column:
    """A string as a JSON string literal."""
    inside = F.to_json(F.array(c))
    return F.substring(inside, 2, F.length(inside) - 2)


def json_object(members: Iterable[tuple[str, Column]]) -> Column:
    """``{"a": 1, "b": "x"}`` from (name, JSON text) pairs; members with NULL text are left out."""
    parts = [F.concat(F.lit(f'"{name}": '), text) for name, text in members]
    return F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*parts)), ", "), F.lit("}"))


def mask_emails(c: Column) -> Column:
    """Keep the first letter and the domain of each email address."""
    # Fixed pattern: what counts as an email address in free text.
    pattern = r"([A-Za-z0-9._%+-])[A-Za-z0-9._%+-]*@([A-Za-z0-9.-]+\.[A-Za-z]{2,})"
    return F.when(F.contains(c, F.lit("@")), F.regexp_replace(c, pattern, "$1***@$2")).otherwise(c)


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.str.normalize("NFKC")


def nfkc(c: Column) -> Column:
    """Compatibility normalisation. The JVM has no such function for columns, so texts with
    characters that may change go to Python in Arrow batches; all others are sent as NULL."""
    is_ascii = F.octet_length(c) == F.length(c)
    may_change = ~is_ascii & F.translate(c, NFKC_STABLE, "").rlike(r"[^\x00-\x7F]")
    return F.coalesce(_nfkc(F.when(may_change, c)), c)


# White space other than the space, tab and line ends, which a line may also begin or end with. Most
# characters lie outside the range, and need not be compared with each of the spaces inside it.
RARE_SPACES = (
    r"[\x0B\f\x1C\x1D\x1E\x1F\x85\xA0[\u1680-\u3000&&[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]]"
)


def tidy_lines(c: Column) -> Column:
    """One kind of line end, no zero-width characters, single spaces, trimmed lines, and at most
    one blank line in a row. Expects normalised text (see ``nfkc``)."""
    text = F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    for char, kept in (("\t", " "), ("\u200b", ""), ("\ufeff", "")):
        text = F.replace(text, F.lit(char), F.lit(kept))
    text = F.regexp_replace(text, " {2,}", " ")
    # A line has at most one space at its ends now, unless it also has rarer white space there.
    edge = rf"[{WS_SET}&&[^\n]]"
    trimmed = F.replace(F.replace(text, F.lit(" \n"), F.lit("\n")), F.lit("\n "), F.lit("\n"))
    rare = F.regexp_replace(text, rf"(?md)^{edge}++|(?<!{edge}){edge}++$", "")
    text = F.when(c.rlike(RARE_SPACES), rare).otherwise(trimmed)
    return strip(F.regexp_replace(text, "\n{3,}", "\n\n"))


def normalize_text(c: Column) -> Column:
    return tidy_lines(nfkc(F.coalesce(c, F.lit(""))))


# The characters that a file name may not have.
FORBIDDEN_IN_NAMES = '\\/:*?"<>|'
MAX_NAME_LENGTH = 180


def safe_file_name(name: Column, fallback: Column) -> Column:
    """A name that can be stored: forbidden characters replaced, unprintable ones dropped."""
    raw = F.coalesce(blank_to_null(strip(name)), fallback)
    safe = F.translate(raw, FORBIDDEN_IN_NAMES, "_" * len(FORBIDDEN_IN_NAMES))
    safe = F.btrim(strip(safe), F.lit("."))
    safe = F.regexp_replace(safe, r"[\p{C}\p{Z}&&[^ ]]", "")
    # What is cut off stays in the name as a hash, and the suffix stays as it is.
    ending = F.regexp_extract(safe, r"^.+(\.[^.]{1,20})$", 1)
    mark = F.concat(F.lit("~"), F.left(F.sha2(safe, 256), F.lit(16)), ending)
    short = F.concat(F.left(safe, F.lit(MAX_NAME_LENGTH) - F.length(mark)), mark)
    return F.when(safe == "", F.concat(fallback, F.lit(".bin"))).otherwise(
        F.when(F.length(safe) > MAX_NAME_LENGTH, short).otherwise(safe)
    )


def file_extension(name: Column) -> Column:
    """The last suffix with its dot, lower-cased; empty for none and for names like ``.profile``."""
    last = F.regexp_extract(name, r"([^/]*)/*$", 1)
    return F.lower(strip(F.regexp_extract(last, r"^.+(\.[^.]+)$", 1)))


def file_stem(name: Column) -> Column:
    suffix = F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)
    return F.left(name, F.length(name) - F.length(suffix))
