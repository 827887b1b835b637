"""Bounds of the query surface and pages of results."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

# Fixed values of the query contract.
DEFAULT_LIMIT, MAX_LIMIT, MAX_OFFSET = 50, 100, 100_000
DEFAULT_TIMEOUT_MS, MIN_TIMEOUT_MS, MAX_TIMEOUT_MS = 250, 10, 5000
MAX_HOPS = 3


def _whole(value, low: int, high: int, name: str) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or not low <= value <= high:
        raise ValueError(f"{name} must be an integer from {low} to {high}")
    return value


def page_bounds(limit: int = DEFAULT_LIMIT, offset: int = 0) -> tuple[int, int]:
    return _whole(limit, 1, MAX_LIMIT, "limit"), _whole(offset, 0, MAX_OFFSET, "offset")


def timeout_bound(timeout_ms: int = DEFAULT_TIMEOUT_MS) -> int:
    return _whole(timeout_ms, MIN_TIMEOUT_MS, MAX_TIMEOUT_MS, "timeout_ms")


def aware(at: datetime) -> datetime:
    if at.tzinfo is None:
        raise ValueError("an instant needs a time zone")
    return at


@dataclass(frozen=True)
class Page:
    items: list[Row]
    total: int
    limit: int
    offset: int

    @property
    def has_more(self) -> bool:
        return self.offset + len(self.items) < self.total


def ordered_page(df: DataFrame, keys: list[Column], limit: int = DEFAULT_LIMIT, offset: int = 0) -> DataFrame:
    """One page in a stable order; the keys must end in a unique one."""
    limit, offset = page_bounds(limit, offset)
    return df.orderBy(*keys).offset(offset).limit(limit)


def page(df: DataFrame, keys: list[Column], limit: int = DEFAULT_LIMIT, offset: int = 0) -> Page:
    return Page(ordered_page(df, keys, limit, offset).collect(), df.count(), limit, offset)


def sort_key(name: str, allowed: tuple[str, ...]) -> Column:
    if name not in allowed:
        raise ValueError(f"sort must be one of {', '.join(allowed)}")
    return F.col(name)
