"""Rules as small frozen records. They live on the driver and only generate column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

TYPES = ("string", "number", "bool", "date_iso")
CASES = ("lower", "upper", "title")


class SchemaError(ValueError):
    """The column rules cannot be used."""


@dataclass(frozen=True)
class ColumnRule:
    name: str
    type: str
    required: bool = False
    allow_blank: bool = True

    def __post_init__(self) -> None:
        if self.type not in TYPES:
            raise SchemaError(f"column {self.name}: type must be one of {', '.join(TYPES)}")


@dataclass(frozen=True)
class Transforms:
    trim: bool = True
    collapse_spaces: bool = False
    case: Mapping[str, str] = field(default_factory=dict)
    date_formats: Sequence[str] = ("%Y-%m-%d",)
    strip_commas: bool = True
    # A NULL cell is a present but empty cell. Set this for sources in which NULL stands for a
    # key that the row does not have: such cells are left alone and not printed.
    null_is_absent: bool = False


@dataclass(frozen=True)
class Dedupe:
    keys: Sequence[str] = ()
    keep: str = "first"

    def __post_init__(self) -> None:
        if self.keep not in ("first", "last"):
            raise ValueError("keep must be 'first' or 'last'")


@dataclass(frozen=True)
class AttachmentPolicy:
    max_size_bytes: int | None = None
    allowed_mime_types: Sequence[str] = ()
    allowed_extensions: Sequence[str] = ()
    route_mode: str = "artifacts"
    drive_folder_id: str = ""
    drive_ready: bool = False

    def __post_init__(self) -> None:
        if self.route_mode not in ("artifacts", "drive"):
            raise ValueError("route_mode must be 'artifacts' or 'drive'")


@dataclass(frozen=True)
class Labels:
    success: str
    needs_review: str
    error: str

    def __post_init__(self) -> None:
        if not (self.success.strip() and self.needs_review.strip() and self.error.strip()):
            raise ValueError("the labels for success, needs_review and error must not be blank")


def schema_from_config(rules: Mapping[str, Any]) -> list[ColumnRule]:
    """Column rules from ``rules['schema']``; without it all listed columns are strings."""
    spec = rules.get("schema")
    if spec is None:
        listed = [(name, True) for name in rules.get("required_columns") or []]
        listed += [(name, False) for name in rules.get("optional_columns") or []]
        return [
            ColumnRule(str(name), "string", required=must, allow_blank=not must)
            for name, must in listed
        ]
    if not isinstance(spec, Mapping):
        raise SchemaError("schema must map column names to their rules")
    for name, rule in spec.items():
        if not isinstance(rule, Mapping):
            raise SchemaError(f"column {name}: the rule must be a mapping")
    return [
        ColumnRule(
            name=str(name),
            type=rule.get("type"),
            required=bool(rule.get("required", False)),
            allow_blank=bool(rule.get("allow_blank", True)),
        )
        for name, rule in spec.items()
    ]


def transforms_from_config(config: Mapping[str, Any] | None) -> Transforms:
    config = config or {}
    strings = config.get("strings") or {}
    numbers = config.get("numbers") or {}
    formats = (config.get("dates") or {}).get("formats") or ["%Y-%m-%d"]
    return Transforms(
        trim=bool(strings.get("trim", True)),
        collapse_spaces=bool(strings.get("collapse_spaces", False)),
        case=dict(strings.get("case") or {}),
        date_formats=tuple(formats),
        strip_commas=bool(numbers.get("strip_commas", True)),
    )


def attachment_policy_from_config(config: Mapping[str, Any] | None) -> AttachmentPolicy:
    config = config or {}

    def words(key: str) -> tuple[str, ...]:
        listed = config.get(key)
        if not isinstance(listed, (list, tuple)):
            return ()
        cleaned = (w.strip().lower() for w in listed if isinstance(w, str))
        return tuple(dict.fromkeys(w for w in cleaned if w))

    limit = config.get("max_size_bytes")
    if isinstance(limit, str):
        limit = int(limit) if limit.strip().lstrip("+-").isdigit() else None
    if isinstance(limit, bool) or not isinstance(limit, int):
        limit = None
    return AttachmentPolicy(
        max_size_bytes=limit,
        allowed_mime_types=words("allowed_mime_types"),
        allowed_extensions=words("allowed_extensions"),
        route_mode=str(config.get("route_mode") or "artifacts").strip().lower() or "artifacts",
        drive_folder_id=str(config.get("drive_folder_id") or "").strip(),
    )
