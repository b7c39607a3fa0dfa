"""Normalisation and validation of sheet rows. Rows are annotated with reasons, never dropped.

The annotated frame has one row per input row:

==========  ===================================================================
row_idx     position of the row, 0-based, given by the source
raw         struct, the cells as they came
cells       struct, the cells after the transforms; a number that cannot be read is NULL here
t_reasons   array, one reason per cell that a transform could not handle
clean       struct, the validated and typed cells
v_reasons   array, one code per broken rule; empty for a valid row
==========  ===================================================================
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StringType, StructType

from ledgerline.functions import coerce
from ledgerline.functions.text import (
    float_text,
    is_blank,
    json_object,
    json_text,
    normalize_string,
    strip,
)
from ledgerline.rules import CASES, ColumnRule, Transforms

ROW = "row_idx"


def _struct_types(df: DataFrame, name: str) -> dict[str, DataType]:
    return {f.name: f.dataType for f in df.schema[name].dataType.fields}


def _cell(struct: str, name: str) -> Column:
    return F.col(struct)[name]


def as_rows(df: DataFrame, row: str = ROW) -> DataFrame:
    """Pack the columns of a sheet into ``raw``, next to its position."""
    return df.select(F.col(row).alias(ROW), F.struct(*[c for c in df.columns if c != row]).alias("raw"))


def apply_transforms(
    df: DataFrame, schema: Sequence[ColumnRule], transforms: Transforms, row: str = ROW
) -> DataFrame:
    """Add ``cells`` and ``t_reasons``. Columns that the sheet does not have are passed over."""
    rows = as_rows(df, row)
    types = _struct_types(rows, "raw")
    rules = {r.name: r for r in schema if r.name in types}

    # Every cell is parsed once, as a column of its own, and then used for the value and the reason.
    parsed = {}
    for name, rule in rules.items():
        if rule.type == "number":
            parsed[name] = coerce.to_number(_cell("raw", name), types[name], transforms.strip_commas)
        elif rule.type == "date_iso":
            parsed[name] = coerce.to_date_text(
                _cell("raw", name), types[name], transforms.date_formats
            )
    rows = rows.select("*", *[c.alias(f"parsed_{name}") for name, c in parsed.items()])

    cells, reasons = [], []
    for name, dtype in types.items():
        raw = _cell("raw", name)
        kind = rules[name].type if name in rules else None
        value, reason = raw, None
        if kind == "string":
            case = transforms.case.get(name)
            value = normalize_string(
                raw,
                trim=transforms.trim,
                collapse_spaces=transforms.collapse_spaces,
                case=case if case in CASES else "none",
            )
            if transforms.null_is_absent:
                value = F.when(raw.isNotNull(), value)
        elif kind == "number":
            value = F.col(f"parsed_{name}")
            reason = coerce.number_reason(raw, value, dtype, transforms.strip_commas)
        elif kind == "date_iso":
            found = F.col(f"parsed_{name}")
            reason = coerce.date_reason(raw, found, dtype)
            value = F.coalesce(found, raw.cast("string"))
        cells.append(value.alias(name))
        if reason is not None:
            if transforms.null_is_absent:
                reason = F.when(raw.isNotNull(), reason)
            reasons.append(F.concat(F.lit(f"{name}: "), reason))
    return rows.select(
        ROW, "raw", F.struct(*cells).alias("cells"), _present(reasons).alias("t_reasons")
    )


def _present(reasons: list[Column]) -> Column:
    if not reasons:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*reasons))


def validate(df: DataFrame, schema: Sequence[ColumnRule], row: str = ROW) -> DataFrame:
    """Add ``clean`` and ``v_reasons``. Takes transformed rows or a plain sheet."""
    if "cells" not in df.columns:
        df = as_rows(df, row).select(
            "*", F.col("raw").alias("cells"), F.array().cast("array<string>").alias("t_reasons")
        )
    types = _struct_types(df, "cells")
    raw_types = _struct_types(df, "raw")

    def typed(rule: ColumnRule) -> Column:
        cell = _cell("cells", rule.name)
        if rule.type == "number":
            return F.coalesce(
                coerce.to_number(cell, types[rule.name]),
                coerce.to_number(_cell("raw", rule.name), raw_types[rule.name]),
            )
        if rule.type == "bool":
            return coerce.to_bool(cell, types[rule.name])
        if rule.type == "date_iso":
            return coerce.to_iso_date(cell)
        return strip(F.coalesce(cell.cast("string"), F.lit("")))

    present = [r for r in schema if r.name in types]
    absent = [r for r in schema if r.name not in types]
    df = df.select("*", *[typed(r).alias(f"typed_{r.name}") for r in present])

    reasons = []
    for rule in schema:
        blank, value = F.lit(True), F.lit(None)
        if rule.name in types:
            # A number cell that could not be read is NULL in ``cells``, so look at ``raw``.
            source = "raw" if rule.type == "number" else "cells"
            dtype = (raw_types if rule.type == "number" else types)[rule.name]
            cell = _cell(source, rule.name)
            blank = is_blank(cell) if isinstance(dtype, StringType) else cell.isNull()
            value = F.col(f"typed_{rule.name}")
        # The reason codes.
        if rule.required:
            on_blank = F.lit(f"missing_required:{rule.name}")
        elif not rule.allow_blank:
            on_blank = F.lit(f"blank_not_allowed:{rule.name}")
        else:
            on_blank = F.lit(None).cast("string")
        reasons.append(
            F.when(blank, on_blank).when(
                value.isNull(), F.lit(f"type_error:{rule.name}:{rule.type}")
            )
        )

    by_name = {r.name: r for r in present}
    clean = [
        (F.col(f"typed_{n}") if n in by_name else _cell("cells", n)).alias(n) for n in types
    ]
    empty = {"string": F.lit(""), "number": F.lit(None).cast("double"),
             "bool": F.lit(None).cast("boolean"), "date_iso": F.lit(None).cast("string")}
    clean += [empty[r.type].alias(r.name) for r in absent]
    return df.select(
        ROW, "raw", "cells", "t_reasons",
        F.struct(*clean).alias("clean"), _present(reasons).alias("v_reasons"),
    )


def is_valid() -> Column:
    return F.size("v_reasons") == 0


def cells_as_text(annotated: DataFrame) -> list[Column]:
    """The transformed cells; number cells as text, so that one that cannot be read stays visible."""
    raw_types = _struct_types(annotated, "raw")
    out = []
    for name, dtype in _struct_types(annotated, "cells").items():
        cell = _cell("cells", name)
        if dtype.typeName() == "double" and raw_types[name] != dtype:
            cell = F.coalesce(float_text(cell), _cell("raw", name).cast("string"))
        out.append(cell.alias(name))
    return out


def valid_rows(annotated: DataFrame) -> DataFrame:
    """The typed cells of the valid rows, with their positions."""
    return _where(annotated, is_valid(), F.col("clean"))


def _where(annotated: DataFrame, condition: Column, row: Column) -> DataFrame:
    """The position and the fields of the struct ``row`` of the rows under ``condition``.

    The rows come out of an array that is empty for the others. A filter on reasons would be pushed
    below the projection that works them out, and would parse every cell a second time.
    """
    return annotated.select(ROW, F.inline(F.when(condition, F.array(row))))


def invalid_rows(annotated: DataFrame) -> DataFrame:
    """The rows that break a rule, as they were given to the validation."""
    row = F.struct(*cells_as_text(annotated)).alias("row")
    return _where(annotated, ~is_valid(), F.struct(row, F.col("v_reasons").alias("reasons")))


def mark_rows(annotated: DataFrame, prefix: str = "_") -> DataFrame:
    """All rows, each with a flag and its reasons in one text."""
    return annotated.select(
        ROW,
        *cells_as_text(annotated),
        is_valid().alias(f"{prefix}valid"),
        F.array_join("v_reasons", "|").alias(f"{prefix}reasons"),
    )


def validation_counts(annotated: DataFrame) -> DataFrame:
    return annotated.agg(
        F.count(F.lit(1)).alias("rows_in"),
        F.count_if(is_valid()).alias("rows_valid"),
        F.count_if(~is_valid()).alias("rows_invalid"),
    )


def row_json(df: DataFrame, struct: str, fallback: str | None = None, omit_null: bool = False) -> Column:
    """One row as a JSON object. ``fallback`` names the struct that holds the text of number cells
    that could not be read; ``omit_null`` leaves NULL cells out."""
    fallback_types = _struct_types(df, fallback) if fallback else {}

    def members() -> Iterator[tuple[str, Column]]:
        for name, dtype in _struct_types(df, struct).items():
            text = _value_text(_cell(struct, name), dtype)
            if name in fallback_types and fallback_types[name] != dtype:
                text = F.coalesce(text, _value_text(_cell(fallback, name), fallback_types[name]))
            yield name, text if omit_null else F.coalesce(text, F.lit("null"))

    return json_object(members())


def _value_text(c: Column, dtype: DataType) -> Column:
    kind = dtype.typeName()
    if kind == "string":
        return F.when(c.isNotNull(), json_text(c))
    if kind in ("double", "float"):
        return float_text(c.cast("double"))
    if isinstance(dtype, StructType) or kind in ("array", "map"):
        return F.to_json(c)
    if kind in ("boolean", "byte", "short", "integer", "long", "decimal"):
        return c.cast("string")
    return F.when(c.isNotNull(), json_text(c.cast("string")))
