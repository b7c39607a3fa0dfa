"""Attachment policy, manifest, file names and routing.

``position`` is the unique arrival order of an attachment, a non-negative long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.mime import base64url_bytes
from ledgerline.functions.text import file_extension, file_stem, safe_file_name, strip
from ledgerline.operators.positions import BLOCK_BITS, with_rank, with_sum_before
from ledgerline.rules import AttachmentPolicy

def _decoded(data: Column) -> Column:
    return F.when(data == "", F.lit(b"")).otherwise(base64url_bytes(data))


def contents(blobs: DataFrame) -> DataFrame:
    """The bytes of the attachments with their size and hash, from base64url texts in ``data``. NULL
    where they cannot be decoded. Nothing is moved."""
    rows = blobs.withColumn("content", _decoded(F.col("data"))).drop("data")
    return rows.withColumns(
        {"size": F.length("content").cast("long"), "sha256": F.sha2("content", 256)}
    )


def with_facts(attachments: DataFrame, blobs: DataFrame, order: str | None = None) -> DataFrame:
    """Add ``size`` and ``sha256`` of the bytes of attachments, NULL if there are none or they cannot
    be decoded. Both are worked out where the bytes are, and only they are joined.

    ``blobs`` may be what `contents` gave, stored. Of repeated ones the first by ``order`` counts, without it the one with the smallest hash.
    """
    keys = ["message_id", "attachment_id"]
    first = F.struct(*([order] if order else []), F.col("sha256").isNull(), "sha256", "size")
    known = blobs if "sha256" in blobs.columns else contents(blobs)
    facts = known.groupBy(*keys).agg(F.min(first).alias("first"))
    facts = facts.select(*keys, "first.size", "first.sha256")
    kept = [c for c in attachments.columns if c not in ("size", "sha256")]
    return attachments.select(*kept).join(facts, keys, "left").select(*kept, "size", "sha256")


def with_content(attachments: DataFrame, blobs: DataFrame) -> DataFrame:
    """Join the bytes of attachments themselves, for those who read them. NULL if there are none or
    they cannot be decoded; of repeated blobs that which `with_facts` takes."""
    keys = ["message_id", "attachment_id"]
    first = F.struct(F.col("sha256").isNull(), "sha256", "content")
    one_each = contents(blobs).groupBy(*keys).agg(F.min(first)["content"].alias("content"))
    kept = [c for c in attachments.columns if c != "content"]
    return attachments.select(*kept).join(one_each, keys, "left").select(*kept, "content")


def policy_reason(policy: AttachmentPolicy, filename: Column, mime_type: Column, size: Column) -> Column:
    """``ok``, or why the policy does not allow the attachment. The size is checked first; then
    the type or the extension must be on its list, and an empty list allows everything."""
    # The words of the reasons.
    mime = F.lower(strip(F.coalesce(mime_type, F.lit(""))))
    extension = file_extension(F.coalesce(filename, F.lit("")))
    blocked = F.concat(
        F.lit("policy_blocked:mime="), F.when(mime == "", "?").otherwise(mime),
        F.lit("|ext="), F.when(extension == "", "?").otherwise(extension),
    )
    verdict = F.lit("ok")
    mimes = [m.strip().lower() for m in policy.allowed_mime_types]
    extensions = [e.strip().lower() for e in policy.allowed_extensions]
    if mimes and extensions:
        allowed = mime.isin(*mimes) | extension.isin(*extensions)
        verdict = F.when(allowed, "ok").otherwise(blocked)
    if policy.max_size_bytes is None:
        return verdict
    limit = policy.max_size_bytes
    too_large = F.concat(F.lit("size_exceeds_limit:"), size.cast("string"), F.lit(f">{limit}"))
    return F.when(size > limit, too_large).otherwise(verdict)


def with_safe_names(df: DataFrame) -> DataFrame:
    fallback = F.when(
        F.coalesce("part_id", F.lit("")) != "", F.concat_ws("_", "message_id", "part_id")
    ).otherwise(F.col("message_id"))
    return df.withColumn("safe_name", safe_file_name(F.coalesce("filename", F.lit("")), fallback))


def allocate_names(df: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """Add ``stored_name`` to rows with ``position`` (a unique long), ``folder`` and ``safe_name``.

    The first arrival of a name in a folder keeps it. Its further arrivals become ``stem-n.ext``,
    with the numbers in turn, but for those whose name another row of the folder asks for: a copy
    never takes a name that is somebody's own. There is no upper number. Without a folder the name
    is NULL.

    Ranks are counted in blocks of positions, also within one name, so a name that holds most of a
    folder makes no task larger. Which numbers are taken is worked out on the distinct names; how
    many of them lie below a copy's number is a running sum in the order of numbers.
    """
    stem = file_stem(F.col("safe_name"))
    suffix = F.substring("safe_name", F.length(stem) + 1, F.length("safe_name"))
    keys = ["folder", "safe_name"]
    rows = df.where(F.col("folder").isNotNull())
    turns = with_rank(rows, "position", "turn", keys, bits)

    number = F.regexp_extract(stem, r"-([1-9][0-9]{0,17})$", 1)
    parent = F.concat(F.regexp_replace(stem, r"-[1-9][0-9]{0,17}$", ""), suffix)
    wanted = rows.select(*keys).distinct().where(number != "")
    taken = wanted.select("folder", parent.alias("safe_name"), number.cast("long").alias("number"))
    taken = with_rank(taken, "number", "below", keys)
    # A taken number comes before the copies that have at least as many free numbers below theirs.
    taken = taken.groupBy(*keys, (F.col("number") - 1 - F.col("below")).alias("free")).agg(
        F.count(F.lit(1)).alias("n")
    )
    none = {c: F.lit(None).cast(rows.schema[c].dataType) for c in df.columns if c not in keys}
    steps = taken.select(
        *[none[c].alias(c) if c in none else F.col(c) for c in df.columns],
        F.lit(None).cast("long").alias("turn"), (F.col("free") * 2 + 1).alias("step"), "n",
    )
    both = turns.select("*", (F.col("turn") * 2).alias("step"), F.lit(0).cast("long").alias("n"))
    both = with_sum_before(both.unionByName(steps), "step", F.col("n"), "skipped", keys)
    copy = F.concat(
        stem, F.lit("-"), (F.col("turn") + F.col("skipped")).cast("string"), suffix
    )
    name = F.when(F.col("turn") == 0, F.col("safe_name")).otherwise(copy)
    named = both.where(F.col("turn").isNotNull()).select(*df.columns, name.alias("stored_name"))
    apart = df.where(F.col("folder").isNull()).withColumn("stored_name", F.lit(None).cast("string"))
    return named.unionByName(apart)


def route(
    attachments: DataFrame, policy: AttachmentPolicy, bits: int = BLOCK_BITS
) -> DataFrame:
    """`decide` where each attachment goes, and under which name.

    Names are given out in several passes over ``attachments``: store them, unless they cost no more
    than a scan. They are worked out on positions, folders and names alone, and joined back by position.
    """
    decided = decide(attachments, policy)
    names = allocate_names(decided.select("position", "folder", "safe_name"), bits)
    names = names.where("folder IS NOT NULL").select(F.col("position").alias("at"), "stored_name")
    path = F.concat_ws("/", F.lit("attachments"), F.col("folder"), F.col("stored_name"))
    return decided.join(names, F.col("position") == F.col("at"), "left").select(
        *[c for c in decided.columns if c not in ("folder", "safe_name")],
        F.when(F.col("stored_name").isNotNull(), path).otherwise("").alias("saved_path"),
    )


def decide(attachments: DataFrame, policy: AttachmentPolicy) -> DataFrame:
    """Where each attachment goes and why, with the ``folder`` and the ``safe_name`` it asks for if it is
    stored; no names are given out, so nothing is shuffled. Totals and manifests without paths need no more.

    ========================  ==========================================================
    status                    meaning
    ========================  ==========================================================
    quarantined               the policy does not allow it
    routed_artifacts          to be stored under ``saved_path``
    routed_drive              to be uploaded
    error                     it could not be routed
    ERROR                     there is no content
    ========================  ==========================================================

    Takes ``content``, or its ``size`` and ``sha256`` as `with_facts` gives them. The content itself
    takes no part in what follows: names need a shuffle, and bytes must not be in it.
    """
    if "content" in attachments.columns:
        facts = [F.length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256")]
        attachments = attachments.select(
            *[c for c in attachments.columns if c not in ("content", "size", "sha256")], *facts
        )
    verdict = F.when(F.col("size").isNull(), "download_failed").otherwise(
        policy_reason(policy, F.col("filename"), F.col("mime_type"), F.col("size"))
    )
    facts = with_safe_names(attachments).withColumn("verdict", verdict)
    passed = F.col("verdict") == "ok"
    to_store = F.when(F.col("size").isNotNull() & ~passed, "quarantine")
    if policy.route_mode == "artifacts":
        to_store = to_store.when(passed, "routed")
    drive_error = None
    if policy.route_mode == "drive" and not policy.drive_folder_id:
        drive_error = "drive_missing_folder_id"
    elif policy.route_mode == "drive" and not policy.drive_ready:
        drive_error = "drive_client_not_configured"
    # The words for where an attachment went.
    sent = "routed_drive" if policy.route_mode == "drive" else "routed_artifacts"
    status = F.when(F.col("size").isNull(), "ERROR").when(~passed, "quarantined").otherwise(
        "error" if drive_error else sent
    )
    reason = F.when(passed, drive_error or "ok").otherwise(F.col("verdict"))
    return facts.select(
        "position", "message_id", "part_id", "attachment_id", "filename", "mime_type", "size",
        "sha256", status.alias("status"), reason.alias("reason"), to_store.alias("folder"), "safe_name",
    )


def manifest(routed: DataFrame) -> DataFrame:
    """The manifest of all attachments that had content."""
    return routed.where(F.col("status") != "ERROR").select(
        "filename", F.col("mime_type").alias("mime"), "size", "sha256", "status", "reason",
        "saved_path", F.lit(None).cast("string").alias("drive_file_id"),
        F.lit(None).cast("string").alias("drive_file_url"),
    )


def raw_paths(attachments: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """The path under which the bytes of each attachment are kept as they came."""
    named = allocate_names(
        with_safe_names(attachments.drop("content")).withColumn("folder", F.lit("raw")), bits
    )
    return named.select(
        "position", "message_id", "attachment_id",
        F.concat(F.lit("attachments/"), "folder", F.lit("/"), "stored_name").alias("raw_path"),
    )


def attachment_summary(routed: DataFrame, list_failures: DataFrame | None = None) -> DataFrame:
    """One row per attachment, and one per message whose attachments could not be listed."""
    rows = routed.select("message_id", "filename", "status", "reason", "saved_path")
    if list_failures is None:
        return rows
    failed = list_failures.select(
        "message_id", F.lit("ERROR").alias("status"),
        F.concat(F.lit("list_attachments_failed:"), "error").alias("reason"),
    )
    return rows.unionByName(failed, allowMissingColumns=True)


def attachment_totals(routed: DataFrame, list_failures: DataFrame | None = None) -> DataFrame:
    """One row of counts, of what `decide` or `route` gave."""
    rows = attachment_summary(routed.withColumn("saved_path", F.lit("")), list_failures)
    is_listing = F.startswith("reason", F.lit("list_attachments_failed:"))
    is_routed = F.startswith("status", F.lit("routed_"))
    is_held = F.col("status") == "quarantined"
    return rows.agg(
        F.count_if(~is_listing).alias("attachments_total"),
        F.count_if(is_routed).alias("attachments_routed"),
        F.count_if(is_held).alias("attachments_quarantined"),
        F.count_if(~is_routed & ~is_held).alias("attachments_errors"),
    )
