"""Input validation shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

#: configuration values that mean "not set"
UNSET = (None, "", "-")


def require_columns(df: DataFrame, names: Iterable[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; present: {df.columns}")


def is_unset(value: object) -> bool:
    return value in UNSET


def split_names(value: str | Iterable[str] | None) -> list[str]:
    """Comma separated text or a list of names; an unset value gives ``[]``."""
    if isinstance(value, str) or value is None:
        if is_unset(value):
            return []
        return [part.strip() for part in value.split(",") if part.strip()]
    return list(value)
