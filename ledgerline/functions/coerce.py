"""Coercion of sheet cells. Nothing here can fail a job: a bad cell gives NULL, and a reason
where one is asked for."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, NumericType, StringType

from ledgerline.functions.text import quoted, strip

# The words read as true and as false.
TRUE_WORDS = ("true", "t", "yes", "y", "1")
FALSE_WORDS = ("false", "f", "no", "n", "0")

# Fixed pattern: a decimal number; underscores may stand between digits.
_DECIMAL = (
    r"^(?!.*(?:[^0-9]_|_[^0-9]|_$))[+-]?(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?$"
)

# Strptime directives, their Spark letters, and the texts they accept.
_DATE_PARTS = {
    "%Y": ("yyyy", r"(?!0000)\d{4}"),
    "%m": ("M", r"\d{1,2}"),
    "%d": ("d", r"\d{1,2}"),
    "%y": ("yy", r"\d{2}"),
    "%b": ("MMM", r"[A-Za-z]+"),
    "%B": ("MMMM", r"[A-Za-z]+"),
    "%H": ("H", r"\d{1,2}"),
    "%M": ("m", r"\d{1,2}"),
    "%S": ("s", r"\d{1,2}"),
}


def double_of_text(text: Column) -> Column:
    """A double, or NULL where the text is not a number (``1d`` and ``1__0`` are not)."""
    word = F.lower(text)
    return (
        F.when(text.rlike(_DECIMAL), F.translate(text, "_", "").try_cast("double"))
        .when(word.isin("inf", "+inf", "infinity", "+infinity"), F.lit(float("inf")))
        .when(word.isin("-inf", "-infinity"), F.lit(float("-inf")))
        .when(word.isin("nan", "+nan", "-nan"), F.lit(float("nan")))
    )


def _without_commas(text: Column, strip_commas: bool) -> Column:
    return F.replace(text, F.lit(","), F.lit("")) if strip_commas else text


def to_number(c: Column, dtype: DataType, strip_commas: bool = True) -> Column:
    if isinstance(dtype, NumericType):
        return c.cast("double")
    if isinstance(dtype, StringType):
        return double_of_text(strip(_without_commas(c, strip_commas)))
    return F.lit(None).cast("double")


def number_reason(c: Column, value: Column, dtype: DataType, strip_commas: bool = True) -> Column:
    """Why ``value``, the parsed number of ``c``, is NULL; NULL where it is not."""
    if isinstance(dtype, BooleanType):
        return F.when(c.isNull(), "not a number: NoneType").otherwise("bool is not a number")
    if isinstance(dtype, NumericType):
        return F.when(c.isNull(), "not a number: NoneType")
    if not isinstance(dtype, StringType):
        return F.when(c.isNull(), "not a number: NoneType").otherwise(
            f"not a number: {dtype.typeName()}"
        )
    text = strip(c)
    shown = quoted(_without_commas(text, strip_commas))
    return (
        F.when(c.isNull(), "not a number: NoneType")
        .when(text == "", "blank")
        .when(value.isNull(), F.concat(F.lit("could not convert string to float: "), shown))
    )


def spark_date_format(strptime_format: str) -> tuple[str, str]:
    """The Spark form of a strptime format, and a pattern of the texts it can fit."""
    letters, shape = [], []
    for token in re.findall(r"%.|[^%]+|%", strptime_format):
        if token in _DATE_PARTS:
            letter, accepted = _DATE_PARTS[token]
        elif token.startswith("%"):
            raise ValueError(f"date format {strptime_format!r}: {token} is not supported")
        else:
            letter, accepted = re.sub(r"([A-Za-z']+)", _as_literal, token), re.escape(token)
        letters.append(letter)
        shape.append(accepted)
    return "".join(letters), "^" + "".join(shape) + "$"


def _as_literal(match: re.Match[str]) -> str:
    return "'" + match.group(0).replace("'", "''") + "'"


def to_date_text(c: Column, dtype: DataType, formats: Sequence[str]) -> Column:
    """ISO date text by the first format that fits, or NULL."""
    if not isinstance(dtype, StringType):
        return F.lit(None).cast("string")
    text = strip(c)
    # The pattern is tried first: it is much cheaper than a parse that fails.
    tries = []
    for letters, shape in map(spark_date_format, formats):
        tries.append(F.when(text.rlike(shape), F.try_to_date(text, letters)))
    return F.date_format(F.coalesce(*tries), "yyyy-MM-dd")


def date_reason(c: Column, value: Column, dtype: DataType) -> Column:
    if not isinstance(dtype, StringType):
        shown = "bool" if isinstance(dtype, BooleanType) else dtype.typeName()
        return F.when(c.isNull(), "not a date string: NoneType").otherwise(
            f"not a date string: {shown}"
        )
    return (
        F.when(c.isNull(), "not a date string: NoneType")
        .when(strip(c) == "", "blank")
        .when(value.isNull(), "unparseable date")
    )


def to_bool(c: Column, dtype: DataType) -> Column:
    if isinstance(dtype, BooleanType):
        return c
    if isinstance(dtype, NumericType):
        return c != 0
    word = F.lower(strip(c.cast("string")))
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)


def to_iso_date(c: Column) -> Column:
    """The text itself if it is a strict YYYY-MM-DD calendar date, else NULL."""
    text = strip(c.cast("string"))
    real = text.rlike(r"^\d{4}-\d{2}-\d{2}$") & ~F.startswith(text, F.lit("0000"))
    return F.when(real & F.try_to_date(F.when(real, text), "yyyy-MM-dd").isNotNull(), text)
