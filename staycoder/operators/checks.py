"""Input checks that fail early and name what is wrong."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame


def require_columns(df: DataFrame, names: Iterable[str], what: str) -> None:
    absent = [name for name in names if name not in df.columns]
    if absent:
        raise ValueError(f"{what} lacks the columns {absent}; it has {df.columns}")


def require_rows(df: DataFrame, message: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(message)
    return df


def require_choice(value: str, choices: Iterable[str], what: str) -> str:
    choices = tuple(choices)
    if value not in choices:
        raise ValueError(f"{what} must be one of {choices}, not {value!r}")
    return value
