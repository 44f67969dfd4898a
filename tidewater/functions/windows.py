"""Window specifications over the panel. Frames count rows, not weeks: gaps are not filled."""

from __future__ import annotations

from pyspark.sql import Window, WindowSpec

FIRST, LAST = Window.unboundedPreceding, Window.unboundedFollowing


def season(start: int = FIRST, end: int = 0) -> WindowSpec:
    """Rows of a unit's year up to this week."""
    return Window.partitionBy("unit", "yr").orderBy("wn").rowsBetween(start, end)


def in_season() -> WindowSpec:
    """For functions that look at one other row."""
    return Window.partitionBy("unit", "yr").orderBy("wn")


def whole_year() -> WindowSpec:
    return Window.partitionBy("unit", "yr")


def same_week(start: int = FIRST, end: int = -1) -> WindowSpec:
    """Rows of the same week in a unit's earlier years."""
    return Window.partitionBy("unit", "wn").orderBy("yr").rowsBetween(start, end)


def history(start: int = FIRST, end: int = 0) -> WindowSpec:
    """Rows of a unit across years."""
    return Window.partitionBy("unit").orderBy("yr", "wn").rowsBetween(start, end)


def in_history() -> WindowSpec:
    return Window.partitionBy("unit").orderBy("yr", "wn")
