"""Intake, cleanup and audit of operational tables and mail, as Spark DataFrame operators."""

from ledgerline.rules import (
    AttachmentPolicy,
    ColumnRule,
    Dedupe,
    Labels,
    SchemaError,
    Transforms,
    attachment_policy_from_config,
    schema_from_config,
    transforms_from_config,
)

__all__ = [
    "AttachmentPolicy",
    "ColumnRule",
    "Dedupe",
    "Labels",
    "SchemaError",
    "Transforms",
    "attachment_policy_from_config",
    "schema_from_config",
    "transforms_from_config",
]
