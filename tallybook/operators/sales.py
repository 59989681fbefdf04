"""Dashboard figures, sales series and sale documents."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from tallybook.functions.clock import (
    Moment,
    in_period,
    iso_millis,
    period_bounds,
    ts_lit,
)
from tallybook.functions.months import MONTH_COLUMNS, during, last_instant, months_between
from tallybook.functions.rows import money, nest, paginate, small_page, stack_metrics, where_all
from tallybook.functions.text import fold_key
from tallybook.schemas import OPEN_STATUSES
from tallybook.sources.monthly import IS_OPEN

TOP_DAYS = 30  # Fixed value: the days a best-seller is counted over.


def _change(today: Column, yesterday: Column) -> Column:
    """Percent change to one decimal; 0 when there was nothing the day before."""
    ratio = (today - yesterday) / F.when(yesterday > 0, yesterday) * 100
    return F.coalesce(F.round(ratio, 1), F.lit(0.0))


def sales_kpis(orders: DataFrame, products: DataFrame, customers: DataFrame, as_of: Moment) -> DataFrame:
    """Sales and orders of the day against the day before, low stock, new customers.

    One aggregate over three stacked scans. Low stock is strictly below the minimum and
    includes zero and negative stock.
    """
    today = period_bounds(as_of, "day")
    yesterday = (today[0] - timedelta(days=1), today[0])
    is_today, is_yesterday = (in_period("order_date", p) for p in (today, yesterday))
    sold = during(orders, "order_date", (yesterday[0], today[1])).select(
        F.when(is_today, F.col("total_amount")).alias("sales_t"),
        F.when(is_yesterday, F.col("total_amount")).alias("sales_y"),
        F.when(is_today, 1).alias("orders_t"),
        F.when(is_yesterday, 1).alias("orders_y"),
    )
    low = products.where(F.col("current_stock") < F.col("minimum_stock")).select(F.lit(1).alias("low"))
    new = customers.where(in_period("created_at", period_bounds(as_of, "month"))).select(
        F.lit(1).alias("new")
    )
    return (
        stack_metrics(sold, low, new)
        .agg(
            money(F.col("sales_t")).alias("sales_t"),
            money(F.col("sales_y")).alias("sales_y"),
            *[F.count(c).alias(c) for c in ("orders_t", "orders_y", "low", "new")],
        )
        .select(
            F.col("sales_t").alias("today_sales"),
            _change(F.col("sales_t"), F.col("sales_y")).alias("sales_change"),
            F.col("orders_t").alias("today_orders"),
            _change(F.col("orders_t"), F.col("orders_y")).alias("orders_change"),
            F.col("low").alias("low_stock_count"),
            F.col("new").alias("new_customers"),
        )
    )


def top_products(
    items: DataFrame, products: DataFrame, orders: DataFrame, as_of: Moment, days: int = TOP_DAYS, n: int = 5
) -> DataFrame:
    """Product names with the most order lines (not pieces) in the last ``days`` days.

    The window opens at midnight and has no end. Lines are counted per product before the
    product names come in, so a best-seller reaches that join as one row. Products sharing
    a name count together. Of lines laid out by month, the months of the window are read.
    """
    since = period_bounds(as_of, "day")[0] - timedelta(days=days)
    month = MONTH_COLUMNS["order_date"]
    shared = [month] if month in items.columns and month in orders.columns else []
    dated = [*months_between(orders, "order_date", since), F.col("order_date") >= ts_lit(since)]
    recent = where_all(orders, dated).select(F.col("id").alias("order_id"), *shared)
    per_product = (
        items.select("order_id", "product_id", *shared)
        .join(recent, ["order_id", *shared], "left_semi")
        .groupBy("product_id")
        .agg(F.count(F.lit(1)).alias("_lines"))
    )
    return best_sellers(per_product, products, n)


def best_sellers(per_product: DataFrame, products: DataFrame, n: int) -> DataFrame:
    """The ``n`` names with most ``_lines`` of (product_id, _lines)."""
    names = products.select(F.col("id").alias("product_id"), "name")
    return (
        per_product.join(names, "product_id")
        .groupBy(fold_key("name").alias("_key"))
        .agg(F.min("name").alias("name"), F.sum("_lines").alias("sales_count"))
        .orderBy(F.desc("sales_count"), F.asc("_key"))
        .limit(n)
        .drop("_key")
    )


def recent_orders(
    orders: DataFrame,
    customers: DataFrame,
    items: DataFrame,
    page: int = 1,
    limit: int = 4,
    after: tuple[Moment, int] | None = None,
) -> DataFrame:
    """One page of orders, newest first, with customer name and line count.

    ``after`` is the (order_date, id) of the last order seen: pages are counted from there on, so
    that going on takes a filter that reaches the scan and a small top-k, however deep it is.

    Every order has its customer, so the page can be cut before anything is joined; only its few
    ids meet the item lines, which are filtered by broadcast and not shuffled.
    """
    newest = [F.desc("order_date"), F.desc("id")]
    if after is not None:
        day, last = ts_lit(after[0]), F.lit(after[1])
        older = (F.col("order_date") < day) | (F.col("id") < last)
        orders = orders.where((F.col("order_date") <= day) & older)
    wanted = paginate(
        orders.select("id", "order_number", "customer_id", "total_amount", "status", "order_date"),
        newest,
        page,
        limit,
    )
    lines = (
        items.select(F.col("order_id").alias("id"))
        .join(small_page(wanted.select("id"), limit), "id")
        .groupBy("id")
        .agg(F.count(F.lit(1)).alias("items_count"))
    )
    names = customers.select(F.col("id").alias("customer_id"), F.col("name").alias("customer_name"))
    return (
        names.join(small_page(wanted, limit), "customer_id")
        .join(small_page(lines, limit), "id", "left")
        .orderBy(*newest)
        .select(
            "id",
            "order_number",
            "customer_name",
            F.coalesce("items_count", F.lit(0)).alias("items_count"),
            F.col("total_amount").cast("double").alias("total_amount"),
            "status",
            F.date_format("order_date", "dd/MM/yyyy").alias("formatted_date"),
        )
    )


def recent_orders_total(orders: DataFrame) -> DataFrame:
    return orders.agg(F.count(F.lit(1)).alias("total"))


def sales_by_weekday(orders: DataFrame, as_of: Moment) -> DataFrame:
    """Revenue per weekday of the Monday-to-Sunday week of ``as_of``; listed Sunday first."""
    return (
        during(orders, "order_date", period_bounds(as_of, "week"))
        .groupBy(
            F.dayofweek("order_date").alias("dow"), F.date_format("order_date", "EEEE").alias("day")
        )
        .agg(money(F.col("total_amount")).alias("total"))
        .orderBy("dow")
        .select("dow", "day", "total")
    )


def sales_by_month_day(orders: DataFrame, as_of: Moment) -> DataFrame:
    """Revenue per day of the month of ``as_of``; days without sales are absent."""
    return (
        during(orders, "order_date", period_bounds(as_of, "month"))
        .groupBy(F.dayofmonth("order_date").alias("day"))
        .agg(money(F.col("total_amount")).alias("total"))
        .orderBy("day")
    )


def sales_by_year_month(orders: DataFrame, as_of: Moment) -> DataFrame:
    """Revenue per month of the year of ``as_of``."""
    return (
        during(orders, "order_date", period_bounds(as_of, "year"))
        .groupBy(
            F.month("order_date").alias("_month"), F.date_format("order_date", "MMMM").alias("month")
        )
        .agg(money(F.col("total_amount")).alias("total"))
        .orderBy("_month")
        .select("month", "total")
    )


def sales_series(orders: DataFrame, as_of: Moment, period: str) -> DataFrame:
    """'week' or 'month'; any other period means the year."""
    series = {"week": sales_by_weekday, "month": sales_by_month_day}
    return series.get(period, sales_by_year_month)(orders, as_of)


def sales_totals(orders: DataFrame, as_of: Moment) -> DataFrame:
    """Revenue of the day, the Sunday-to-Saturday week and the month, and open orders.

    One scan; unlike the weekday series, this week starts on Sunday. Orders laid out by month are
    read for the months of the periods and, elsewhere, only as far as they are open.
    """
    spans = {
        name: period_bounds(as_of, unit)
        for name, unit in (("today", "day"), ("week", "week_sunday"), ("month", "month"))
    }
    whole = (min(s[0] for s in spans.values()), max(s[1] for s in spans.values()))
    is_open = F.col("status").isin(*OPEN_STATUSES)
    months = months_between(orders, "order_date", whole[0], last_instant(whole))
    if months and IS_OPEN in orders.columns:
        orders = orders.where((F.col(IS_OPEN) == 1) | reduce(and_, months))
    return orders.where(in_period("order_date", whole) | is_open).agg(
        *[
            money(F.when(in_period("order_date", span), F.col("total_amount"))).alias(name)
            for name, span in spans.items()
        ],
        F.count(F.when(is_open, 1)).alias("pending"),
    )


def _with_lines(orders: DataFrame, lines: DataFrame, element: str) -> DataFrame:
    """Attach nested lines; an order without lines keeps an empty array."""
    return orders.join(lines, orders["id"] == lines["order_id"], "left").select(
        *[orders[c] for c in orders.columns],
        F.coalesce(lines["part"], F.lit(0)).alias("part"),
        F.coalesce(lines["items"], F.array().cast(f"array<{element}>")).alias("items"),
    )


def _nested_lines(
    items: DataFrame, products: DataFrame, element: Sequence[Column], part_rows: int | None
) -> DataFrame:
    """Lines with product names, as one array per order (several for an oversized order)."""
    names = products.select(F.col("id").alias("product_id"), F.col("name").alias("product_name"))
    wanted = ["order_id", "product_id", "quantity", "unit_price"]
    tie = [c for c in ("id", "line_number") if c in items.columns]
    lines = items.select(*wanted, *tie).join(names, "product_id")
    return nest(lines, "order_id", element, "items", tie, part_rows)


def sales_documents(
    orders: DataFrame, customers: DataFrame, items: DataFrame, products: DataFrame, part_rows: int | None = None
) -> DataFrame:
    """Every order with its customer and nested lines, newest first.

    An order is one document, ``part`` 0; with ``part_rows``, one of more lines than that comes as
    several, ``part`` 0, 1, ….
    Lines of a product that no longer exists are left out.
    """
    element = [
        F.col("product_name").alias("product"),
        F.col("quantity"),
        F.col("unit_price").alias("valor"),
    ]
    lines = _nested_lines(items, products, element, part_rows)
    buyers = customers.select(F.col("id").alias("customer_id"), F.col("name").alias("customer_name"))
    heads = orders.join(buyers, "customer_id", "left").select(
        "id",
        "order_number",
        "status",
        "total_amount",
        "order_date",
        "channel",
        "customer_name",
        "ifood_order",
    )
    return (
        _with_lines(heads, lines, "struct<product:string,quantity:int,valor:decimal(10,2)>")
        .orderBy(F.desc("order_date"), F.desc("id"), F.asc("part"))
        .withColumn("total_amount", F.col("total_amount").cast("double"))
        .withColumn("order_date", iso_millis("order_date"))
    )


def sale_details(
    orders: DataFrame,
    customers: DataFrame,
    items: DataFrame,
    products: DataFrame,
    ids: DataFrame,
    part_rows: int | None = None,
) -> DataFrame:
    """The orders named in ``ids`` (one ``id`` column), all columns, with nested lines.

    Ids without an order are simply absent. ``customer`` repeats the customer id.
    """
    wanted = ids.select("id")
    element = [
        F.col("product_id").alias("product"),
        F.col("product_name"),
        F.col("quantity"),
        F.col("unit_price").alias("valor"),
    ]
    chosen = items.join(wanted.withColumnRenamed("id", "order_id"), "order_id", "left_semi")
    lines = _nested_lines(chosen, products, element, part_rows)
    buyers = customers.select(F.col("id").alias("customer_id"), F.col("name").alias("customer_name"))
    heads = orders.join(wanted, "id", "left_semi").join(buyers, "customer_id", "left")
    heads = heads.select(
        *orders.columns, "customer_name", F.col("customer_id").alias("customer")
    )
    return _with_lines(
        heads, lines, "struct<product:bigint,product_name:string,quantity:int,valor:decimal(10,2)>"
    )
