"""Declared rules of a table, and reading them from JSON."""

import json
from dataclasses import dataclass, field, fields
from typing import Any


@dataclass(frozen=True)
class ColumnRules:
    name: str
    dtype: str | None = None
    nullable: bool = True
    required: bool = True
    min_value: float | None = None
    max_value: float | None = None
    allowed_values: tuple[Any, ...] | None = None
    max_null_fraction: float | None = None
    regex_pattern: str | None = None
    min_length: int | None = None
    max_length: int | None = None


@dataclass(frozen=True)
class TableRules:
    columns: tuple[ColumnRules, ...] = field(default_factory=tuple)
    allow_extra_columns: bool = True
    min_rows: int | None = None
    max_rows: int | None = None
    require_unique: tuple[str, ...] | None = None


def _build(kind, content):
    unknown = set(content) - {item.name for item in fields(kind)}
    if unknown:
        raise ValueError(f"unknown rule keys: {sorted(unknown)}")
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in content.items()})


def rules_from_dict(content):
    content = dict(content)
    columns = [_build(ColumnRules, item) for item in content.pop("columns", [])]
    return _build(TableRules, {**content, "columns": columns})


def rules_from_file(path):
    with open(path, encoding="utf-8") as handle:
        return rules_from_dict(json.load(handle))
