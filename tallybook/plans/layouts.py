"""Named queries over tables laid out for them: by month, by day, bucketed by name, as JSON."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import cached_property, reduce

from pyspark.sql import DataFrame, functions as F

from tallybook.functions.rows import Page
from tallybook.operators import daily_parts, products, recipes, sales, tasks
from tallybook.operators.changes import next_id
from tallybook.operators.customer_names import keep_names, keep_new_names, resolve_kept_names
from tallybook.plans import report_sql, reports, write_sql
from tallybook.plans.parameters import LOG_AS_OF, ORDERS_AS_OF, TASKS_AS_OF
from tallybook.sources import tables
from tallybook.sources.bindings import Bindings, with_tables
from tallybook.sources.monthly import read_by_month, write_by_month, write_lines_by_month
from tallybook.sources.scratch import scratch_path


class MonthlyBindings(Bindings):
    """The same tables, with orders, lines and ledger written by month and read back."""

    @cached_property
    def orders(self) -> DataFrame:
        return self._laid_out("orders", super().orders)

    @cached_property
    def ledger(self) -> DataFrame:
        return self._laid_out("financial_transactions", super().ledger)

    @cached_property
    def order_items(self) -> DataFrame:
        lines, path = super().order_items, scratch_path(self.spark, "lines-by-month")
        write_lines_by_month(lines, Bindings(self.spark, self.sf_dir).orders, path)
        return read_by_month(self.spark, "order_items", path, lines.schema)

    def _laid_out(self, table: str, rows: DataFrame) -> DataFrame:
        path = scratch_path(self.spark, f"{table}-by-month")
        write_by_month(rows, table, path)
        return read_by_month(self.spark, table, path, rows.schema)


MONTHLY = (
    "sales_kpis",
    "top_products",
    "sales_by_weekday",
    "sales_by_month_day",
    "sales_by_year_month",
    "sales_totals",
    "finance_summary",
    "cashflow_by_month",
    "category_distribution",
    "transactions_search",
)


def _monthly(name: str) -> Callable[[Bindings], DataFrame]:
    return lambda b: reports.QUERIES[name](MonthlyBindings(b.spark, b.sf_dir))


# -- daily parts ------------------------------------------------------------------------------


def _recipe_counts_from_days(b: Bindings) -> DataFrame:
    """The log added in two batches that share every day."""
    root = scratch_path(b.spark, "preparations")
    odd = F.coalesce(F.col("recipe_id") % 2 == 1, F.lit(False))
    for batch in (b.recipe_log.where(odd), b.recipe_log.where(~odd)):
        daily_parts.add_preparations(batch, root)
    return daily_parts.recipe_counts_from_days(b.recipes, b.recipe_ingredients, b.products, root, LOG_AS_OF)


def _top_products_from_days(b: Bindings) -> DataFrame:
    root = scratch_path(b.spark, "lines-by-day")
    daily_parts.add_lines(b.order_items, b.orders, root)
    return daily_parts.top_products_from_days(b.products, root, ORDERS_AS_OF)


# -- names kept between batches ---------------------------------------------------------------

NAME_BATCHES = 3


def _batches(b: Bindings) -> list[DataFrame]:
    """All sales in batches that follow each other in arrival."""
    feed = b.orders_feed.select("feed_id", "arrival_seq", "customer")
    low, high = feed.agg(F.min("arrival_seq"), F.max("arrival_seq")).first()
    if low is None:
        return []
    step = (high - low) // NAME_BATCHES + 1
    place = F.floor((F.col("arrival_seq") - low) / F.lit(step))
    return [feed.where(place == i) for i in range(NAME_BATCHES)]


def _resolved_by_batches(b: Bindings) -> tuple[DataFrame, DataFrame]:
    """(links, new customers) of all batches, every one matched to the names kept so far."""
    table, path = f"names_{uuid.uuid4().hex}", scratch_path(b.spark, "names")
    keep_names(b.customers, table, path)
    following = next_id(b.customers)
    done = []
    for batch in _batches(b):
        found = resolve_kept_names(batch, table, following)
        keep_new_names(found.new, table, path)
        following += found.new.count()
        done.append(found)
    return tuple(reduce(DataFrame.unionByName, side) for side in zip(*done))


# -- JSON documents ---------------------------------------------------------------------------


def _documents(b: Bindings) -> DataFrame:
    return sales.sales_documents(b.orders, b.customers, b.order_items, b.products)


def _sales_documents_json(b: Bindings) -> DataFrame:
    """Orders with their lines written as JSON lines and read back."""
    path, found = scratch_path(b.spark, "documents"), _documents(b)
    tables.write_json_documents(found, path)
    read = tables.read_json_documents(b.spark, path, found.schema)
    return reports.items_text(read, "items", ["product", "quantity", "valor"])


def _sales_documents_values(b: Bindings) -> DataFrame:
    """What single values of the documents say, read without a declared form."""
    found = tables.json_values(
        tables.to_json_documents(_documents(b)),
        {
            "id": ("$.id", "bigint"),
            "customer_name": ("$.customer_name", "string"),
            "items": ("$.items", "array<struct<product:string,quantity:int,valor:decimal(10,2)>>"),
            "notes": ("$.notes.text", "string"),
        },
    )
    pieces = F.aggregate("items", F.lit(0).cast("bigint"), lambda total, line: total + line["quantity"])
    return found.select("id", "customer_name", F.size("items").alias("lines"), pieces.alias("pieces"), "notes")


# -- pages with their totals ------------------------------------------------------------------


def _told(page: Page) -> DataFrame:
    return page.rows.withColumn("total", F.lit(page.total))


def _page_sql(page: str, total: str) -> str:
    return f"SELECT p.*, t.total FROM ({report_sql.SQL[page]}) p, ({report_sql.SQL[total]}) t"


QUERIES: dict[str, Callable[[Bindings], DataFrame]] = {
    **{f"{name}_monthly": _monthly(name) for name in MONTHLY},
    "recipe_counts_from_days": _recipe_counts_from_days,
    "top_products_from_days": _top_products_from_days,
    "intake_resolve_customers_kept": lambda b: _resolved_by_batches(b)[0],
    "intake_new_customers_kept": lambda b: _resolved_by_batches(b)[1],
    "sales_documents_json": _sales_documents_json,
    "sales_documents_values": _sales_documents_values,
    "product_search_page": lambda b: _told(
        products.product_search_page(b.products, None, "low", "RING", 1, 20)
    ),
    "recipe_list_page": lambda b: _told(
        recipes.recipe_list_page(b.recipes, b.recipe_ingredients, b.products, None, "1", 1, 30)
    ),
    "tasks_search_page": lambda b: _told(
        tasks.tasks_search_page(
            b.tasks, b.task_categories, TASKS_AS_OF, "ERROR", "overdue", "priority_asc", 1, 50
        )
    ),
}

SQL: dict[str, str] = {
    **{f"{name}_monthly": report_sql.SQL[name] for name in MONTHLY},
    "recipe_counts_from_days": report_sql.SQL["recipe_counts"],
    "top_products_from_days": report_sql.SQL["top_products"],
    "intake_resolve_customers_kept": write_sql.SQL["intake_resolve_customers"],
    "intake_new_customers_kept": write_sql.SQL["intake_new_customers"],
    "sales_documents_json": report_sql.SQL["sales_documents"],
    "sales_documents_values": with_tables(
        """
, lines AS (SELECT i.order_id, COUNT(*) AS n, SUM(i.quantity) AS pieces
  FROM bo_order_items i JOIN bo_products p ON p.id = i.product_id GROUP BY i.order_id)
SELECT o.id, c.name AS customer_name, CAST(COALESCE(l.n, 0) AS INT) AS lines,
  CAST(COALESCE(l.pieces, 0) AS BIGINT) AS pieces, CAST(NULL AS VARCHAR) AS notes
FROM bo_orders o LEFT JOIN bo_customers c ON c.id = o.customer_id LEFT JOIN lines l ON l.order_id = o.id""",
        "bo_orders",
        "bo_customers",
        "bo_order_items",
        "bo_products",
    ),
    "product_search_page": _page_sql("product_search", "product_search_total"),
    "recipe_list_page": _page_sql("recipe_list", "recipe_list_total"),
    "tasks_search_page": _page_sql("tasks_search", "tasks_search_total"),
}
