"""The triage table: one row per message, updated by key, with columns that users may add."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.text import float_text, strip
from ledgerline.operators.extract import FIELDS, with_aliases
from ledgerline.operators.positions import with_rank

# The columns that a triage table always has.
TRIAGE_COLUMNS = (
    "message_id",
    "thread_id",
    "date",
    "from",
    "subject",
    "name",
    "company",
    "email",
    "phone",
    "amount",
    "invoice_or_order_id",
    "confidence",
    "gmail_link",
    "status",
    "last_run_id",
    "updated_at",
)
MANAGED = tuple(c for c in TRIAGE_COLUMNS if c != "status")
FIRST_SHEET_ROW = 2  # row 1 of a sheet is its header


def permalink(message_id: Column, mailbox_index: int = 0, anchor: str = "inbox") -> Column:
    """A link to a message; empty for a blank id."""
    key = strip(F.coalesce(message_id, F.lit("")))
    # Fixed value: the address of a message in the web client.
    start = f"https://mail.google.com/mail/u/{mailbox_index}/#{anchor}/"
    return F.when(key == "", "").otherwise(F.concat(F.lit(start), key))


def ensure_columns(df: DataFrame, required: Sequence[str] = TRIAGE_COLUMNS, row: str = "row_idx") -> DataFrame:
    """All cells as text, missing ones empty; missing columns are added on the right."""
    own = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns if c != row]
    added = [F.lit("").alias(c) for c in required if c not in df.columns]
    return df.select(row, *own, *added)


def triage_cells(
    items: DataFrame,
    run_id: str | Column,
    updated_at: str | Column,
    mailbox_index: int = 0,
    anchor: str = "inbox",
    row: str = "row_idx",
    keep: Sequence[str] = (),
) -> DataFrame:
    """Intake items as the texts that go into a triage table. Missing values are empty texts. The
    columns in ``keep`` are passed on."""
    fields = with_aliases(F.col("parsed"))
    df = items.select(row, *keep, "message_id", "thread_id", "date", "from", "subject",
                      "parser_confidence", fields.alias("fields"))
    score = F.col("parser_confidence")
    key = strip(F.coalesce("message_id", F.lit("")))
    cells = {
        "message_id": key,
        **{c: F.col(c) for c in ("thread_id", "date", "from", "subject")},
        **{f: F.col("fields")[f] for f in FIELDS if f != "amount"},
        "amount": F.to_json("fields.amount", {"ignoreNullFields": "false"}),
        # A confidence of zero is shown as an empty cell.
        "confidence": F.when(score != 0, float_text(score)),
        "gmail_link": permalink(key, mailbox_index, anchor),
        "last_run_id": F.lit(run_id),
        "updated_at": F.lit(updated_at),
    }
    return df.select(
        row, *keep, *[F.coalesce(cells[c].cast("string"), F.lit("")).alias(c) for c in MANAGED]
    )


def upsert(
    existing: DataFrame,
    cells: DataFrame,
    default_status: str = "NEW",
    preserve_status: bool = True,
    row: str = "row_idx",
    order: Sequence[str] = (),
    managed: Sequence[str] = MANAGED,
    own_positions: bool = False,
    rivals: Column | None = None,
) -> DataFrame:
    """Merge new cells into a triage table by ``message_id``; a new version is returned.

    * Managed columns are overwritten, user columns kept, and so is a status that is not blank.
    * If the table holds an id more than once, its first row is updated.
    * If an id comes more than once, its last cells count, at the place of the first. The last ones
      are those with the largest ``order`` columns, and of equal ones with the largest position.
    * New messages follow the existing rows in the order in which they came. With ``own_positions``
      the positions of the cells are beyond those of the table already, and are used as they are.
    * Rows of the table that are ``rivals`` compete with the cells, by ``order`` columns of their own;
      one that wins stays as it is. This needs ``own_positions``.

    Winners are found and ids matched on narrow rows: keys and positions. The wide rows are then
    joined on their row position, which is unique, so an id that fills much of the table makes no
    task larger.
    """
    table = ensure_columns(existing, [*TRIAGE_COLUMNS, *(c for c in managed if c not in TRIAGE_COLUMNS)], row)
    users = [c for c in table.columns if c not in managed and c not in TRIAGE_COLUMNS and c != row]

    key = strip(F.col("message_id"))
    last = F.max(F.struct(*order, row))[row] if order else F.max(row)
    competing = cells.where(key != "").select(key.alias("key"), row, *order)
    if rivals is not None:
        of_cells = [F.col(c).cast(cells.schema[c].dataType).alias(c) for c in order]
        competing = competing.union(existing.where(rivals & (key != "")).select(key.alias("key"), row, *of_cells))
    incoming = competing.groupBy("key").agg(F.min(row).alias("came_at"), last.alias("last"))
    known = (
        table.where(strip(F.col("message_id")) != "")
        .groupBy(strip(F.col("message_id")).alias("key"))
        .agg(F.min(row).alias("at"))
    )
    # A message without a row gets a negative position of its own, which matches none.
    placed = incoming.join(known, "key", "left").select(
        F.coalesce("at", -1 - F.col("came_at")).alias("at"), "came_at", "last"
    )
    # Columns of their own, not one struct, so that those that the caller does not read are not shuffled.
    wide = cells.select(F.col(row).alias("last"), *[F.col(c).cast("string").alias(f"_new_{c}") for c in managed])
    placed = placed.join(wide, "last").drop("last")
    after = F.lit(0) if own_positions else F.coalesce(table.agg(F.max(row)).scalar(), F.lit(-1)) + 1
    merged = table.join(placed, table[row] == placed["at"], "full_outer")

    is_hit = F.col("came_at").isNotNull()
    kept = F.lit(default_status)
    if preserve_status:
        kept = F.when(strip(F.col("status")) != "", F.col("status")).otherwise(default_status)
    values = {c: F.when(is_hit, F.col(f"_new_{c}")).otherwise(F.col(c)) for c in managed}
    values["status"] = F.when(is_hit, kept).otherwise(F.col("status"))
    values.update({c: F.coalesce(F.col(c), F.lit("")) for c in users})
    return merged.select(
        F.coalesce(F.col(row), after + F.col("came_at")).alias(row),
        *[values[c].alias(c) for c in table.columns if c != row],
    )


def sheet_rows(table: DataFrame, row: str = "row_idx") -> DataFrame:
    """The row number in the sheet of each id; of the last row if an id is there more than once."""
    ids = table.select(row, strip(F.col("message_id")).alias("message_id"))
    numbered = with_rank(ids, row, "rank")
    return (
        numbered.where(F.col("message_id") != "")
        .groupBy("message_id")
        .agg((F.max("rank") + FIRST_SHEET_ROW).alias("sheet_row_id"))
    )
