"""Filters of tables laid out by month.

A period is a range of the raw column, which the layout's partition column does not follow by
itself. Where a frame has that column, the filters here name the months as well, so that the scan
lists and reads those folders only.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from tallybook.functions.clock import Moment, as_date, date_lit, in_period
from tallybook.functions.rows import where_all

# Dated column -> partition column of the layout by month.
MONTH_COLUMNS = {"order_date": "order_month", "transaction_date": "transaction_month"}


def month_of(column: str) -> Column:
    """The first day of the month of a dated column."""
    return F.trunc(F.col(column), "month").alias(MONTH_COLUMNS[column])


def months_between(
    df: DataFrame, column: str, start: Moment | None = None, end: Moment | None = None
) -> list[Column]:
    """The months of ``start`` to ``end``, both included; nothing if ``df`` is not laid out so."""
    month = MONTH_COLUMNS[column]
    if month not in df.columns:
        return []
    found = []
    if start is not None:
        found.append(F.col(month) >= date_lit(as_date(start).replace(day=1)))
    if end is not None:
        found.append(F.col(month) <= date_lit(as_date(end).replace(day=1)))
    return found


def last_instant(bounds: tuple[datetime, datetime]) -> datetime:
    return bounds[1] - timedelta(microseconds=1)


def during(df: DataFrame, column: str, bounds: tuple[datetime, datetime]) -> DataFrame:
    """Rows of the half-open period."""
    months = months_between(df, column, bounds[0], last_instant(bounds))
    return where_all(df, [*months, in_period(column, bounds)])
