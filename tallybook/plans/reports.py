"""Named report and search queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from tallybook.operators import finance, oil, products, recipes, sales, tasks
from tallybook.plans.parameters import (
    HALF_YEAR,
    LOG_AS_OF,
    MONTH,
    ORDERS_AS_OF,
    ORDERS_SEEN,
    TASKS_AS_OF,
    TASKS_FROM,
    TASKS_TO,
)
from tallybook.sources.bindings import Bindings

Query = Callable[[Bindings], DataFrame]


def items_text(documents: DataFrame, column: str, fields: list[str]) -> DataFrame:
    """Nested lines as text, so that the whole document can be compared value by value."""
    line = lambda x: F.concat_ws(":", *[x[f].cast("string") for f in fields])
    return documents.withColumn(column, F.array_join(F.transform(column, line), ","))


def _sales_documents(b: Bindings) -> DataFrame:
    found = sales.sales_documents(b.orders, b.customers, b.order_items, b.products)
    return items_text(found, "items", ["product", "quantity", "valor"])


def _sale_details(b: Bindings) -> DataFrame:
    """Every order that a line names; the ids come from the whole line table."""
    ids = b.order_items.select(F.col("order_id").alias("id"))
    found = sales.sale_details(b.orders, b.customers, b.order_items, b.products, ids)
    for name in ("total_amount", "amount_received", "change_given"):
        found = found.withColumn(name, F.col(name).cast("double"))
    return items_text(found, "items", ["product", "product_name", "quantity", "valor"])


def _recipe_details(b: Bindings) -> DataFrame:
    found = recipes.recipe_details(b.recipes, b.recipe_ingredients, b.products)
    return items_text(found, "ingredients", ["id", "name", "quantity", "unit", "notes", "product_id", "missing"])


def _product_lookup(b: Bindings) -> DataFrame:
    """Products by the user ids of the whole event table, used here as keys; some are unknown."""
    ids = b.source("events").select(F.col("user_id").alias("id"))
    return products.product_lookup(b.products, ids)


def _transaction_lookup(b: Bindings) -> DataFrame:
    """Ledger rows by the ids all lines would have; only returned lines are booked."""
    ids = b.order_items.select(
        (F.lit(1000000000000) + F.col("order_id") * 100 + F.col("line_number")).alias("id")
    )
    return finance.transaction_lookup(b.ledger, ids)


QUERIES: dict[str, Query] = {
    "sales_kpis": lambda b: sales.sales_kpis(b.orders, b.products, b.customers, ORDERS_AS_OF),
    "top_products": lambda b: sales.top_products(b.order_items, b.products, b.orders, ORDERS_AS_OF),
    "recent_orders": lambda b: sales.recent_orders(b.orders, b.customers, b.order_items, 2, 25),
    "recent_orders_after": lambda b: sales.recent_orders(
        b.orders, b.customers, b.order_items, 1, 25, after=ORDERS_SEEN
    ),
    "recent_orders_total": lambda b: sales.recent_orders_total(b.orders),
    "low_stock": lambda b: products.low_stock(b.products),
    "sales_by_weekday": lambda b: sales.sales_by_weekday(b.orders, ORDERS_AS_OF),
    "sales_by_month_day": lambda b: sales.sales_by_month_day(b.orders, ORDERS_AS_OF),
    "sales_by_year_month": lambda b: sales.sales_by_year_month(b.orders, ORDERS_AS_OF),
    "sales_totals": lambda b: sales.sales_totals(b.orders, ORDERS_AS_OF),
    "sales_documents": _sales_documents,
    "sale_details": _sale_details,
    "ingredient_picker": lambda b: products.ingredient_picker(b.products),
    "product_search": lambda b: products.product_search(b.products, None, "low", "RING", 1, 20),
    "product_search_category": lambda b: products.product_search(
        b.products, "promo", None, None, 2, 50
    ),
    "product_search_total": lambda b: products.product_search_total(b.products, None, "low", "RING"),
    "stock_counts": lambda b: products.stock_counts(b.products),
    "product_categories": lambda b: products.product_categories(b.products),
    "product_lookup": _product_lookup,
    "recipe_list": lambda b: recipes.recipe_list(
        b.recipes, b.recipe_ingredients, b.products, None, "1", 1, 30
    ),
    "recipe_list_total": lambda b: recipes.recipe_list_total(b.recipes, None, "1"),
    "recipe_categories": lambda b: recipes.recipe_categories(b.recipes),
    "recipe_counts": lambda b: recipes.recipe_counts(
        b.recipes, b.recipe_log, b.recipe_ingredients, b.products, LOG_AS_OF
    ),
    "recipe_details": _recipe_details,
    "tasks_upcoming": lambda b: tasks.tasks_upcoming(
        b.tasks, b.task_categories, TASKS_FROM, TASKS_TO
    ),
    "tasks_search": lambda b: tasks.tasks_search(
        b.tasks, b.task_categories, TASKS_AS_OF, "ERROR", "overdue", "priority_asc", 1, 50
    ),
    "tasks_search_total": lambda b: tasks.tasks_search_total(
        b.tasks, TASKS_AS_OF, "ERROR", "overdue"
    ),
    "tasks_search_deep_page": lambda b: tasks.tasks_search(
        b.tasks, b.task_categories, TASKS_AS_OF, None, "all", "due_date_desc", 6, 200
    ),
    "tasks_summary": lambda b: tasks.tasks_summary(b.tasks, TASKS_AS_OF),
    "finance_summary": lambda b: finance.finance_summary(b.ledger, b.orders, *HALF_YEAR),
    "finance_summary_unbounded": lambda b: finance.finance_summary(b.ledger, b.orders),
    "cashflow_by_month": lambda b: finance.cashflow_by_month(b.ledger, ORDERS_AS_OF, 6),
    "category_distribution": lambda b: finance.category_distribution(b.ledger, *HALF_YEAR),
    "transactions_search": lambda b: finance.transactions_search(
        b.ledger, *MONTH, type="saida", order="valor-desc"
    ),
    "transactions_search_category": lambda b: finance.transactions_search(
        b.ledger, start=HALF_YEAR[0], category="impostos", order="data-asc"
    ),
    "transaction_lookup": _transaction_lookup,
    "oil_impact": lambda b: oil.oil_impact(b.oil_disposals, ORDERS_AS_OF),
    "oil_impact_same_year": lambda b: oil.oil_impact(b.oil_disposals, ORDERS_AS_OF, same_year=True),
    "recent_disposals": lambda b: oil.recent_disposals(b.oil_disposals),
}
