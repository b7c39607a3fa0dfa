"""Expressions on message parts: base64, headers, names and types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerline.functions.text import blank_to_null, let, strip


def base64url_bytes(data: Column) -> Column:
    """The bytes of base64 or base64url text, padded or not; NULL if it cannot be decoded."""
    plain = F.replace(F.replace(strip(data), F.lit("-"), F.lit("+")), F.lit("_"), F.lit("/"))
    return F.coalesce(F.try_to_binary(plain, F.lit("base64")), _loose_base64(plain))


def _loose_base64(text: Column) -> Column:
    """As above, but characters that are not base64 are passed over (they count for the padding),
    and so is what follows the end mark."""

    def padded_text(text: Column) -> Column:
        missing = F.pmod(-F.length(text), F.lit(4))
        padded = F.rpad(text, F.length(text) + missing, "=")
        return F.regexp_replace(padded, "[^A-Za-z0-9+/=]", "")

    def decoded(padded: Column, head: Column) -> Column:
        loose = F.pmod(F.length(head), F.lit(4))
        ends = F.length(padded) - F.length(head)
        closed = (
            F.when(loose == 0, True)
            .when(loose == 1, False)
            .when(loose == 2, F.substring(padded, F.length(head) + 1, F.lit(2)) == "==")
            .otherwise(ends > 0)
        )
        whole = F.rpad(head, F.length(head) + F.pmod(-F.length(head), F.lit(4)), "=")
        return F.when(closed, F.try_to_binary(whole, F.lit("base64")))

    return let(
        padded_text(text),
        lambda padded: let(
            F.substring_index(padded, "=", 1), lambda head: decoded(padded, head)
        ),
    )


def utf8_text(content: Column) -> Column:
    """Text of UTF-8 bytes; bad sequences become the replacement character."""
    return F.make_valid_utf8(content.cast("string"))


def header_value(headers: Column, name: str) -> Column:
    """The value of the first header of that name (any case), or NULL."""
    wanted = name.lower()
    hits = F.filter(headers, lambda h: F.lower(strip(h["name"])) == wanted)
    return F.get(hits, 0)["value"]


def header_parameter(value: Column, parameter: str) -> Column:
    """A parameter of a header value, such as ``filename`` in ``attachment; filename="a.pdf"``.

    The extended form ``filename*=UTF-8''a.pdf`` is read too.
    """
    chunks = F.split(value, ";")
    chunks = F.transform(F.filter(chunks, lambda _, i: i > 0), strip)
    pairs = F.transform(
        F.filter(chunks, lambda x: F.contains(x, F.lit("="))),
        lambda x: F.struct(
            F.lower(strip(F.substring_index(x, "=", 1))).alias("key"),
            F.btrim(strip(F.substring(x, F.locate("=", x) + 1, F.length(x))), F.lit("\"'")).alias(
                "value"
            ),
        ),
    )
    hits = F.filter(
        pairs, lambda p: p["key"].isin(parameter, f"{parameter}*") & (p["value"] != "")
    )
    return F.substring_index(F.get(hits, 0)["value"], "''", -1)


def part_file_name(filename: Column, headers: Column) -> Column:
    """The name of a part: its own, else that in Content-Disposition, else in Content-Type."""
    return F.coalesce(
        blank_to_null(strip(filename)),
        blank_to_null(header_parameter(header_value(headers, "Content-Disposition"), "filename")),
        blank_to_null(header_parameter(header_value(headers, "Content-Type"), "name")),
        F.lit(""),
    ).transform(strip)


def part_mime_type(mime_type: Column, headers: Column) -> Column:
    def bare(value: Column) -> Column:
        return blank_to_null(strip(F.substring_index(strip(value), ";", 1)))

    return F.coalesce(bare(mime_type), bare(header_value(headers, "Content-Type")), F.lit(""))
