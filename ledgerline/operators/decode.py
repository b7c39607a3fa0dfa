"""Decoding of mail messages given as JSON texts.

A message is a tree of parts of any depth. It is flattened inside its own row, so decoding needs no
shuffle: no exploding, and no grouping by message afterwards. Trees of usual depth are read with a
fixed schema; deeper or malformed ones are walked level by level, to any depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.mime import (
    base64url_bytes,
    header_value,
    part_file_name,
    part_mime_type,
    utf8_text,
)
from ledgerline.functions.text import is_blank, strip


def _text_at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def _is_set(v: Column) -> Column:
    return v.isNotNull() & ~F.is_variant_null(v)


def _is_object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>").isNotNull()


def _children(part: Column) -> Column:
    listed = F.try_variant_get(part, "$.parts", "array<variant>")
    return F.coalesce(F.filter(listed, _is_object), F.array().cast("array<variant>"))


def _tree(payload: Column, json: Column) -> Column:
    """All parts with their paths, level by level. Each step adds the children of the last level.

    The number of steps comes from the text itself: a level needs an opening bracket, so there
    are never more levels than brackets, and no depth is out of reach.
    """
    brackets = F.length(json) - F.length(F.replace(json, F.lit("["), F.lit("")))
    steps = F.when(brackets > 0, F.sequence(F.lit(1), brackets)).otherwise(
        F.array().cast("array<int>")
    )
    root = F.array(
        F.struct(F.array().cast("array<int>").alias("path"), payload.alias("part"))
    )

    def next_level(node: Column) -> Column:
        return F.transform(
            _children(node["part"]),
            lambda part, i: F.struct(
                F.concat(node["path"], F.array(i)).alias("path"), part.alias("part")
            ),
        )

    def step(state: Column, _: Column) -> Column:
        known = F.size(state["nodes"])
        last = F.slice(state["nodes"], state["done"] + 1, known - state["done"])
        grown = F.struct(
            F.concat(state["nodes"], F.flatten(F.transform(last, next_level))).alias("nodes"),
            known.alias("done"),
        )
        return F.when(known == state["done"], state).otherwise(grown)

    start = F.struct(root.alias("nodes"), F.lit(0).alias("done"))
    return F.aggregate(steps, start, step, lambda state: state["nodes"])


def _part_fields(node: Column) -> Column:
    part = node["part"]
    body = F.try_variant_get(part, "$.body", "variant")
    data = F.try_variant_get(part, "$.body.data", "variant")
    size = F.try_variant_get(part, "$.body.size", "variant")
    size_text = strip(F.try_variant_get(size, "$", "string"))
    listed = F.try_variant_get(part, "$.parts", "variant")
    entries = F.try_variant_get(part, "$.parts", "array<variant>")
    headers = F.transform(
        F.filter(F.try_variant_get(part, "$.headers", "array<variant>"), _is_object),
        lambda h: F.struct(
            F.coalesce(_text_at(h, "$.name"), F.lit("")).alias("name"),
            _text_at(h, "$.value").alias("value"),
        ),
    )
    data_is_text = _is_set(data) & (F.schema_of_variant(data) == "STRING")
    attachment_id = F.try_variant_get(part, "$.body.attachmentId", "variant")
    id_is_text = _is_set(attachment_id) & (F.schema_of_variant(attachment_id) == "STRING")
    problems = F.array_compact(
        F.array(
            F.when(_is_set(body) & ~_is_object(body), "malformed body: expected dict"),
            F.when(_is_set(data) & ~data_is_text, "malformed body data: expected string"),
            F.when(
                _is_set(listed) & entries.isNull(), "malformed MIME structure: parts must be a list"
            ),
            F.when(
                F.exists(entries, lambda e: ~_is_object(e)),
                "malformed MIME structure: part entry must be a dict",
            ),
        )
    )
    return F.struct(
        node["path"].alias("path"),
        _text_at(part, "$.partId").alias("part_id"),
        _text_at(part, "$.mimeType").alias("mime_type"),
        _text_at(part, "$.filename").alias("filename"),
        headers.alias("headers"),
        F.when(data_is_text, F.try_variant_get(data, "$", "string")).alias("data"),
        F.when(id_is_text, F.try_variant_get(attachment_id, "$", "string")).alias("attachment_id"),
        F.when(
            _is_set(size)
            & F.schema_of_variant(size).isin("BIGINT", "STRING")
            & size_text.rlike(r"^[+-]?\d+$"),
            size_text.try_cast("long"),
        ).alias("size"),
        problems.alias("problems"),
    )


_NODE = (
    "struct<path:array<int>,part_id:string,mime_type:string,filename:string,"
    "headers:array<struct<name:string,value:string>>,data:string,attachment_id:string,size:bigint,"
    "problems:array<string>>"
)
USUAL_DEPTH = 3


def _usual_schema() -> str:
    part = (
        "struct<partId:string,mimeType:string,filename:string,"
        "headers:array<struct<name:string,value:string>>,"
        "body:struct<data:variant,attachmentId:variant,size:string>,parts:{}>"
    )
    below = "string"  # what lies deeper stays text, and its presence is all that matters
    for _ in range(USUAL_DEPTH):
        below = f"array<{part.format(below)}>"
    return (
        "id string, threadId string, internalDate string, "
        f"payload {part.format(below)}, broken string"
    )


def _string_of(v: Column) -> Column:
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def _usual_part(part: Column, path: Column) -> Column:
    size = strip(part["body"]["size"])
    headers = F.transform(
        part["headers"],
        lambda h: F.struct(
            F.coalesce(h["name"], F.lit("")).alias("name"), h["value"].alias("value")
        ),
    )
    return F.struct(
        path.alias("path"),
        part["partId"].alias("part_id"),
        part["mimeType"].alias("mime_type"),
        part["filename"].alias("filename"),
        headers.alias("headers"),
        _string_of(part["body"]["data"]).alias("data"),
        _string_of(part["body"]["attachmentId"]).alias("attachment_id"),
        F.when(size.rlike(r"^[+-]?\d+$"), size.try_cast("long")).alias("size"),
        F.array().cast("array<string>").alias("problems"),
    )


def _usual_parts(part: Column, path: Column, levels: int = USUAL_DEPTH) -> Column:
    """A part and all below it, in reading order."""
    own = F.array(_usual_part(part, path))
    if levels == 0:
        return own
    below = F.transform(
        part["parts"],
        lambda child, i: _usual_parts(child, F.concat(path, F.array(i)), levels - 1),
    )
    return F.concat(own, F.coalesce(F.flatten(below), F.array().cast(f"array<{_NODE}>")))


def _is_unusual(part: Column, levels: int = USUAL_DEPTH) -> Column:
    """Whether a tree is deeper than the schema, or has an entry that is no part, or data that is
    no text."""
    data = part["body"]["data"]
    here = part.isNull() | (_is_set(data) & (F.schema_of_variant(data) != "STRING"))
    if levels == 0:
        return here | part["parts"].isNotNull()
    below = F.exists(part["parts"], lambda child: _is_unusual(child, levels - 1))
    return here | F.coalesce(below, F.lit(False))


def with_parts(messages: DataFrame, json: str = "json") -> DataFrame:
    """Add the message fields and ``parts``, its flat list of parts in reading order.

    Text that is not JSON, or a message without a payload, has no parts.
    """
    read = messages.select(
        "*",
        F.from_json(json, _usual_schema(), {"columnNameOfCorruptRecord": "broken"}).alias("usual"),
    )
    payload = F.col("usual")["payload"]
    unusual = F.col("usual")["broken"].isNotNull() | (payload.isNotNull() & _is_unusual(payload))
    read = read.select("*", F.coalesce(unusual, F.lit(True)).alias("is_unusual"))

    doc = F.when(F.col("is_unusual"), F.try_parse_json(json))
    read = read.select("*", doc.alias("doc"))
    found = F.try_variant_get("doc", "$.payload", "variant")
    read = read.select(
        "*",
        F.when(_is_set(found) & _is_object(found), found).alias("payload"),
        F.coalesce(_is_set(found), F.lit(False)).alias("has_payload"),
    )
    walked = F.array_sort(
        F.transform(_tree(F.col("payload"), F.col(json)), _part_fields)
    )
    nothing = F.array().cast(f"array<{_NODE}>")
    parts = (
        F.when(
            ~F.col("is_unusual"),
            F.when(payload.isNull(), nothing).otherwise(
                _usual_parts(payload, F.array().cast("array<int>"))
            ),
        )
        .when(F.col("payload").isNull(), nothing)
        .otherwise(walked)
    )

    def field(name: str) -> Column:
        walked_to = _text_at(F.col("doc"), f"$.{name}")
        text = F.when(F.col("is_unusual"), walked_to).otherwise(F.col("usual")[name])
        return F.coalesce(text, F.lit(""))

    # The texts of the warnings.
    problems = F.when(
        F.col("is_unusual"),
        F.array_compact(
            F.array(
                F.when(F.col("doc").isNull(), "malformed message: expected dict"),
                F.when(
                    F.col("has_payload") & F.col("payload").isNull(),
                    "malformed message payload: expected dict",
                ),
            )
        ),
    ).otherwise(F.array().cast("array<string>"))
    out = read.select(
        *[c for c in messages.columns if c != json],
        field("id").alias("message_id"),
        field("threadId").alias("thread_id"),
        field("internalDate").alias("internal_date"),
        parts.alias("parts"),
        problems.alias("message_problems"),
    )
    return out


def extract_parts(with_parts_df: DataFrame, keep: tuple[str, ...] = ("message_id",)) -> DataFrame:
    """One row per part, in reading order by ``part_position``; ``part_path`` like 000.001, longer where a number needs it."""
    rows = with_parts_df.select(*keep, F.posexplode("parts").alias("part_position", "part"))
    path = F.array_join(
        F.transform("part.path", lambda i: F.lpad(i.cast("string"), F.greatest(F.length(i.cast("string")), F.lit(3)), F.lit("0"))),
        ".",
    )
    return rows.select(*keep, "part_position", path.alias("part_path"), "part.*").drop("path")


def decode_bodies(with_parts_df: DataFrame) -> DataFrame:
    """Add the texts of a message and choose its body: plain, else html, else none."""

    def decoded(part: Column) -> Column:
        text = F.when(strip(part["data"]) == "", "").otherwise(
            utf8_text(base64url_bytes(part["data"]))
        )
        return F.struct(
            F.coalesce(part["mime_type"], F.lit("")).alias("mime"), text.alias("text"),
            part["data"].alias("data"), part["problems"].alias("problems"),
        )

    def warnings_of(body: Column) -> Column:
        near = F.translate(F.left(body["data"], F.lit(24)), "\n\r", "  ")
        bad = F.concat(F.lit("invalid base64url data near '"), near, F.lit("'"))
        return F.when(
            body["data"].isNotNull() & body["text"].isNull(), F.concat(body["problems"], F.array(bad))
        ).otherwise(body["problems"])

    df = with_parts_df.select("*", F.transform("parts", decoded).alias("bodies"))

    def joined(*mimes: str) -> Column:
        texts = F.transform(
            F.filter("bodies", lambda b: b["mime"].isin(*mimes) & b["text"].isNotNull()),
            lambda b: b["text"],
        )
        return F.when(F.size(texts) > 0, F.array_join(texts, "\n\n"))

    df = df.select(
        "*", joined("text/plain", "").alias("text_plain"), joined("text/html").alias("text_html")
    )
    chosen = (
        F.when(~is_blank(F.col("text_plain")), "plain")
        .when(~is_blank(F.col("text_html")), "html")
        .otherwise("none")
    )
    df = df.select("*", chosen.alias("chosen"))
    text = (
        F.when(F.col("chosen") == "plain", F.col("text_plain"))
        .when(F.col("chosen") == "html", F.col("text_html"))
        .otherwise("")
    )
    warnings = F.concat(
        "message_problems", F.flatten(F.transform("bodies", warnings_of))
    )
    return df.select("*", text.alias("text"), warnings.alias("warnings")).drop(
        "bodies", "message_problems"
    )


def with_headers(with_parts_df: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """Add header values of the message as columns; empty where there is no such header."""
    names = names or {"from": "From", "to": "To", "subject": "Subject", "date": "Date"}
    headers = F.get(F.col("parts"), 0)["headers"]
    return with_parts_df.select(
        "*",
        *[
            F.coalesce(header_value(headers, header), F.lit("")).alias(column)
            for column, header in names.items()
        ],
    )


def list_attachments(
    with_parts_df: DataFrame, keep: tuple[str, ...] = ("message_id",)
) -> DataFrame:
    """One row per part that refers to an attachment."""
    kept = with_parts_df.select(
        *keep,
        F.posexplode(
            F.filter("parts", lambda p: ~is_blank(p["attachment_id"]))
        ).alias("attachment_position", "part"),
    )
    return kept.select(
        *keep,
        "attachment_position",
        F.col("part.part_id").alias("part_id"),
        F.col("part.attachment_id").alias("attachment_id"),
        part_file_name(F.col("part.filename"), F.col("part.headers")).alias("filename"),
        part_mime_type(F.col("part.mime_type"), F.col("part.headers")).alias("mime_type"),
        F.col("part.size").alias("size_estimate"),
    )


def decode_counts(decoded: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """One row: how many messages were fetched and which body was chosen. ``found`` is the list of
    ids that were looked for; without it, the messages themselves."""
    counts = decoded.agg(
        F.count(F.lit(1)).alias("fetched_count"),
        *[
            F.count_if(F.col("chosen") == kind).alias(f"decoded_{kind}_count")
            for kind in ("plain", "html", "none")
        ],
    )
    if found is None:
        return counts.select(F.col("fetched_count").alias("ids_found"), "*")
    ids = found.agg(F.count(F.lit(1))).scalar()
    return counts.select(ids.alias("ids_found"), "*")
