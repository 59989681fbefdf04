"""Dates and periods. "Now" is always an argument, so every result is reproducible.

Periods are half-open ranges of the raw column, never ``year(col) = …``: only the former
reach the file scan as pushed filters.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, functions as F

Moment = datetime | date | str


def as_datetime(value: Moment) -> datetime:
    if isinstance(value, str):
        return datetime.fromisoformat(value)
    if isinstance(value, datetime):
        return value
    return datetime(value.year, value.month, value.day)


def as_date(value: Moment) -> date:
    return as_datetime(value).date()


def ts_lit(value: Moment) -> Column:
    return F.lit(as_datetime(value).isoformat(sep=" ")).cast("timestamp_ntz")


def date_lit(value: Moment) -> Column:
    return F.lit(as_date(value))


def period_bounds(as_of: Moment, unit: str) -> tuple[datetime, datetime]:
    """[start, end) of the day, week, month or year that holds ``as_of``.

    The reports use two kinds of week: ``week`` starts on Monday, ``week_sunday`` on Sunday.
    """
    day = as_datetime(as_of).replace(hour=0, minute=0, second=0, microsecond=0)
    if unit == "day":
        return day, day + timedelta(days=1)
    if unit == "week":
        start = day - timedelta(days=day.weekday())
        return start, start + timedelta(days=7)
    if unit == "week_sunday":
        start = day - timedelta(days=(day.weekday() + 1) % 7)
        return start, start + timedelta(days=7)
    if unit == "month":
        start = day.replace(day=1)
        return start, (start + timedelta(days=32)).replace(day=1)
    if unit == "year":
        start = day.replace(month=1, day=1)
        return start, start.replace(year=start.year + 1)
    raise ValueError(f"unknown period: {unit!r}")


def in_period(col: Column | str, bounds: tuple[datetime, datetime]) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    return (col >= ts_lit(bounds[0])) & (col < ts_lit(bounds[1]))


def month_start_back(as_of: Moment, months: int) -> date:
    """First day of the month ``months`` months before ``as_of``."""
    day = as_date(as_of)
    index = day.year * 12 + day.month - 1 - months
    return date(index // 12, index % 12 + 1, 1)


def day_range(col: Column | str, start: Moment | None, end: Moment | None) -> list[Column]:
    """Inclusive day bounds on a timestamp column; a bound that is not given adds nothing."""
    col = F.col(col) if isinstance(col, str) else col
    found = []
    if start is not None:
        found.append(col >= ts_lit(as_date(start)))
    if end is not None:
        found.append(col < ts_lit(as_date(end) + timedelta(days=1)))
    return found


def date_range(col: Column | str, start: Moment | None, end: Moment | None) -> list[Column]:
    """Inclusive bounds on a date column."""
    col = F.col(col) if isinstance(col, str) else col
    found = []
    if start is not None:
        found.append(col >= date_lit(start))
    if end is not None:
        found.append(col <= date_lit(end))
    return found


def iso_millis(col: Column | str) -> Column:
    """ISO 8601 with milliseconds, read as UTC."""
    return F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def iso_seconds(col: Column | str) -> Column:
    """ISO 8601 of a whole-second wall-clock value."""
    return F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss'.000Z'")
