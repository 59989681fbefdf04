"""Cash ledger reports and searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallybook.functions.clock import Moment, date_range, day_range, month_start_back
from tallybook.functions.months import months_between
from tallybook.functions.rows import money, stack_metrics, where_all
from tallybook.schemas import LEDGER_CATEGORIES

# Sort name -> (column, descending).
SORTS = {
    "data-asc": ("transaction_date", False),
    "data-desc": ("transaction_date", True),
    "valor-asc": ("amount", False),
    "valor-desc": ("amount", True),
}


def _income() -> Column:
    return F.when(F.col("type") == "entrada", F.col("amount"))


def _expense() -> Column:
    return F.when(F.col("type") == "saida", F.col("amount"))


def _booked_in(ledger: DataFrame, start: Moment | None = None, end: Moment | None = None) -> list[Column]:
    """Inclusive bounds on the booking date, and on the months of a ledger laid out by them."""
    column = "transaction_date"
    return [*months_between(ledger, column, start, end), *date_range(column, start, end)]


def finance_summary(
    ledger: DataFrame, orders: DataFrame, start: Moment | None = None, end: Moment | None = None
) -> DataFrame:
    """Income, expenses and balance of the ledger, revenue of the orders, in an inclusive range."""
    booked = where_all(ledger, _booked_in(ledger, start, end)).select(
        _income().alias("income"), _expense().alias("expense")
    )
    dated = [*months_between(orders, "order_date", start, end), *day_range("order_date", start, end)]
    sold = where_all(orders, dated).select(
        F.col("total_amount").alias("revenue")
    )
    nothing = F.lit(0).cast("decimal(10,2)")
    total_in = F.coalesce(F.sum("income"), nothing)
    total_out = F.coalesce(F.sum("expense"), nothing)
    return stack_metrics(booked, sold).agg(
        total_in.cast("double").alias("total_income"),
        total_out.cast("double").alias("total_expenses"),
        (total_in - total_out).cast("double").alias("balance"),
        money(F.col("revenue")).alias("total_revenue"),
    )


def cashflow_by_month(ledger: DataFrame, as_of: Moment, months: int = 6) -> DataFrame:
    """Income and expenses per month since the first of the month ``months`` months back."""
    return (
        where_all(ledger, _booked_in(ledger, month_start_back(as_of, months)))
        .groupBy(F.date_format("transaction_date", "yyyy-MM").alias("month_year"))
        .agg(money(_income()).alias("total_income"), money(_expense()).alias("total_expenses"))
        .orderBy("month_year")
    )


def category_distribution(
    ledger: DataFrame, start: Moment | None = None, end: Moment | None = None
) -> DataFrame:
    """Expenses and income per category that has any, in the categories' declared order."""
    declared = F.array(*[F.lit(c) for c in LEDGER_CATEGORIES])
    return (
        where_all(ledger, _booked_in(ledger, start, end))
        .groupBy("category")
        .agg(money(_expense()).alias("total_expenses"), money(_income()).alias("total_income"))
        .where((F.col("total_expenses") > 0) | (F.col("total_income") > 0))
        .orderBy(F.coalesce(F.array_position(declared, F.col("category")), F.lit(0)), "category")
    )


def transactions_search(
    ledger: DataFrame,
    start: Moment | None = None,
    end: Moment | None = None,
    type: str | None = None,
    category: str | None = None,
    order: str | None = None,
) -> DataFrame:
    """Ledger rows of a range, type and category; newest first unless another order is named.

    Either bound may stand alone.
    """
    conditions = _booked_in(ledger, start, end)
    if type:
        conditions.append(F.col("type") == type)
    if category:
        conditions.append(F.col("category") == category)
    column, descending = SORTS.get(order or "", SORTS["data-desc"])
    keys = [F.desc(column), F.desc("id")] if descending else [F.asc(column), F.asc("id")]
    return (
        where_all(ledger, conditions)
        .orderBy(*keys)
        .select(
            "id",
            "description",
            F.col("amount").cast("double").alias("amount"),
            "type",
            "category",
            F.date_format("transaction_date", "yyyy-MM-dd").alias("date"),
        )
    )


def transaction_lookup(ledger: DataFrame, ids: DataFrame) -> DataFrame:
    """The ledger rows named in ``ids`` (one ``id`` column); unknown ids are absent."""
    return ledger.join(ids.select("id"), "id", "left_semi").select(
        "id",
        "description",
        F.col("amount").cast("double").alias("amount"),
        "type",
        "category",
        F.date_format("transaction_date", "yyyy-MM-dd").alias("transaction_date"),
    )
