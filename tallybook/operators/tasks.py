"""Task lists and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallybook.functions.clock import Moment, iso_seconds, ts_lit
from tallybook.functions.rows import Page, page_and_total, paginate, where_all
from tallybook.functions.text import contains_any

DONE = "completed"

# Sort name -> priorities in listing order.
PRIORITY_SORTS = {
    "priority_asc": ("high", "medium", "low"),
    "priority_desc": ("low", "medium", "high"),
}


def _is_open() -> Column:
    return F.col("status") != DONE


def _is_overdue(as_of: Moment) -> Column:
    return (F.col("due_date") < ts_lit(as_of)) & _is_open()


def _with_category(tasks: DataFrame, categories: DataFrame) -> DataFrame:
    labels = categories.select(
        F.col("id").alias("category_id"),
        F.col("name").alias("category_name"),
        F.col("color").alias("category_color"),
    )
    return tasks.join(labels, "category_id", "left").select(
        *tasks.columns, "category_name", "category_color"
    )


def tasks_upcoming(tasks: DataFrame, categories: DataFrame, start: Moment, end: Moment) -> DataFrame:
    """Open tasks due from ``start`` to ``end``, both included, soonest first."""
    due = tasks.where(F.col("due_date").between(ts_lit(start), ts_lit(end)) & _is_open())
    return (
        _with_category(due, categories)
        .orderBy("due_date", "id")
        .withColumn("due_date", iso_seconds("due_date"))
    )


def _matching(tasks: DataFrame, as_of: Moment, search: str | None, status: str | None) -> DataFrame:
    conditions = []
    if search:
        conditions.append(contains_any(["title", "description"], search))
    if status == "overdue":
        conditions.append(_is_overdue(as_of))
    elif status and status != "all":
        conditions.append(F.col("status") == status)
    return where_all(tasks, conditions)


def _order(sort: str | None) -> list[Column]:
    if sort in PRIORITY_SORTS:
        ranked = F.array(*[F.lit(p) for p in PRIORITY_SORTS[sort]])
        # An unlisted priority has position 0 and comes first.
        return [F.coalesce(F.array_position(ranked, F.col("priority")), F.lit(0)).asc(), F.asc("id")]
    if sort == "due_date_desc":
        return [F.desc("due_date"), F.desc("id")]
    return [F.asc("due_date"), F.asc("id")]


def tasks_search(
    tasks: DataFrame,
    categories: DataFrame,
    as_of: Moment,
    search: str | None = None,
    filter: str | None = None,
    sort: str | None = None,
    page: int = 1,
    limit: int = 10,
) -> DataFrame:
    """One page of tasks. ``filter``: all, overdue or a status; ``sort``: due_date_asc (also
    for anything unknown), due_date_desc, priority_asc (high first), priority_desc."""
    wanted = paginate(_listed(tasks, as_of, search, filter), _order(sort), page, limit)
    return _shown(wanted, categories, sort)


def tasks_search_page(
    tasks: DataFrame,
    categories: DataFrame,
    as_of: Moment,
    search: str | None = None,
    filter: str | None = None,
    sort: str | None = None,
    page: int = 1,
    limit: int = 10,
) -> Page:
    """``tasks_search`` and ``tasks_search_total`` of the same filters, from one scan of the tasks."""
    found = page_and_total(_listed(tasks, as_of, search, filter), _order(sort), page, limit)
    return Page(_shown(found.rows, categories, sort), found.total)


def _listed(tasks: DataFrame, as_of: Moment, search: str | None, status: str | None) -> DataFrame:
    return _matching(tasks, as_of, search, status).select(
        "id",
        "title",
        "description",
        "due_date",
        "priority",
        "status",
        "category_id",
        "reminder_minutes",
    )


def _shown(wanted: DataFrame, categories: DataFrame, sort: str | None) -> DataFrame:
    return (
        _with_category(wanted, categories)
        .orderBy(*_order(sort))
        .withColumn("due_date", iso_seconds("due_date"))
    )


def tasks_search_total(
    tasks: DataFrame, as_of: Moment, search: str | None = None, filter: str | None = None
) -> DataFrame:
    return _matching(tasks, as_of, search, filter).agg(F.count(F.lit(1)).alias("total"))


def tasks_summary(tasks: DataFrame, as_of: Moment) -> DataFrame:
    """Four counts in one scan; pending means not completed."""
    return tasks.agg(
        F.count(F.lit(1)).alias("total"),
        F.count(F.when(F.col("status") == DONE, 1)).alias("completed"),
        F.count(F.when(_is_open(), 1)).alias("pending"),
        F.count(F.when(_is_overdue(as_of), 1)).alias("overdue"),
    )
