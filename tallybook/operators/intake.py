"""Order intake: a batch of incoming sales against the tables they change.

``orders_feed`` has one row per sale (``feed_id``, ``arrival_seq``, customer, channel, status,
order_date as local text, …), ``items_feed`` one row per line. A sale is taken or refused as a
whole; a refused one leaves no trace in any table.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce
from operator import or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from tallybook.functions.rows import dense_index
from tallybook.functions.text import fold_key
from tallybook.operators.allocation import BLOCK_ORDERS, allocate_stock
from tallybook.operators.changes import next_id
from tallybook.schemas import CHANNELS
from tallybook.sources.scratch import deal, materialize, materialize_by

# Channel -> order number prefix.
PREFIXES = {"whatsapp": "WAT", "ifood": "IFO", "balcao": "BAL"}
CASH = "dinheiro"
# Fixed value: how the description of a sale's ledger row begins.
SALE_NUMBER = r"^Venda (\S+)"
# Fixed value: the largest total an order can store.
MAX_TOTAL = Decimal("99999999.99")

State = dict[str, DataFrame]  # customers, products, orders, order_items, financial_transactions


class Customers(NamedTuple):
    links: DataFrame  # feed_id, customer_id
    new: DataFrame  # id, name


class Intake(NamedTuple):
    accepted: DataFrame  # the new orders, with feed_id
    rejected: DataFrame  # feed_id, reject_reason
    shortages: DataFrame
    new: State  # the rows to add to each table; for products, id and quantity sold
    state: State  # the tables afterwards


def blank(name: str) -> Column:
    return F.col(name).isNull() | (F.col(name) == "")


def filled(name: str) -> Column:
    return F.when(~blank(name), F.col(name))


def to_utc(name: str, source_tz: str) -> Column:
    """Local wall-clock text as a whole-second UTC value; NULL if it is no date."""
    local = F.date_trunc("second", F.col(name).try_cast("timestamp_ntz")).cast("timestamp_ntz")
    return F.convert_timezone(F.lit(source_tz), F.lit("UTC"), local)


def line_price(items: DataFrame) -> Column:
    """``unit_price``, or ``valor`` where that is missing or zero."""
    price = F.col("unit_price")
    if "valor" not in items.columns:
        return price
    return F.coalesce(F.when(price != 0, price), F.col("valor"), price)


def line_amount(items: DataFrame) -> Column:
    return F.col("quantity") * line_price(items)


def intake_validate(orders_feed: DataFrame, items_feed: DataFrame, products: DataFrame) -> DataFrame:
    """(feed_id, reject_reason): the first thing wrong with each sale, NULL if nothing is.

    Beyond what the lines must hold (product and quantity), a quantity must be positive.
    """
    # Unknown products are few where products are many, so that lines need not meet all of them.
    asked = items_feed.select("product_id").distinct()
    missing = asked.join(products.select(F.col("id").alias("product_id")), "product_id", "left_anti")
    unknown = materialize(missing, "unknown").withColumn("_unknown", F.lit(True))
    product, quantity = F.col("product_id"), F.col("quantity")
    incomplete = product.isNull() | (product == 0) | quantity.isNull() | (quantity <= 0)
    # Line number and fault as one number, so that the first faulty line is a plain minimum.
    fault = F.when(incomplete, 0).when(F.col("_unknown"), 1)
    lines = (
        items_feed.join(unknown, "product_id", "left")
        .groupBy("feed_id")
        .agg(
            F.min(F.coalesce("line_no", F.lit(0)).cast("bigint") * 2 + fault).alias("_fault"),
            F.max(line_price(items_feed).isNull()).alias("_unpriced"),
            F.sum(line_amount(items_feed)).alias("_total"),
        )
    )
    reason = F.coalesce(
        F.when(F.col("_unpriced").isNull(), F.lit("no_items")),
        F.when(blank("status"), F.lit("no_status")),
        F.when(blank("order_date"), F.lit("no_date")),
        F.when(blank("channel"), F.lit("no_channel")),
        F.when(F.col("order_date").try_cast("timestamp_ntz").isNull(), F.lit("invalid_date")),
        F.when(F.pmod("_fault", F.lit(2)) == 0, F.lit("incomplete_item")),
        F.when(F.pmod("_fault", F.lit(2)) == 1, F.lit("unknown_product")),
        F.when(~F.lower("channel").isin(*CHANNELS), F.lit("invalid_channel")),
        F.when(F.col("customer").isNull(), F.lit("no_customer")),
        F.when(F.col("_unpriced"), F.lit("item_without_price")),
        F.when(F.abs("_total") > MAX_TOTAL, F.lit("total_too_large")),
    )
    return orders_feed.join(lines, "feed_id", "left").select("feed_id", reason.alias("reject_reason"))


def order_number_max(orders: DataFrame) -> DataFrame:
    """The highest sequence in use per prefix and year."""
    number = F.col("order_number")
    return orders.groupBy(
        F.substring_index(number, "-", 1).alias("prefix"),
        F.get(F.split(number, "-"), F.lit(1)).try_cast("int").alias("year"),
    ).agg(F.max(F.substring_index(number, "-", -1).try_cast("bigint")).alias("last_seq"))


def _numbers_in_use(orders: DataFrame, year: int) -> DataFrame:
    """(name, value): prefix and sequence of every order numbered in ``year``."""
    begins = [F.col("order_number").startswith(f"{p}-{year}-") for p in PREFIXES.values()]
    return orders.where(reduce(or_, begins)).select(
        F.substring_index("order_number", "-", 1).alias("name"),
        F.substring_index("order_number", "-", -1).try_cast("bigint").alias("value"),
    )


def _highest(*values: DataFrame) -> dict[str, int]:
    """The highest value per name; the names are few and fixed, so few rows are fetched."""
    found = reduce(DataFrame.unionByName, values).groupBy("name").agg(F.max("value").alias("value"))
    return {r["name"]: r["value"] or 0 for r in found.collect()}


def last_numbers(orders: DataFrame, year: int) -> dict[str, int]:
    """The highest sequence in use per prefix."""
    return _highest(_numbers_in_use(orders, year))


def _prefix() -> Column:
    channel = F.lower("channel")
    chain = F.lit(None).cast("string")
    for name, prefix in PREFIXES.items():
        chain = F.when(channel == name, F.lit(prefix)).otherwise(chain)
    return chain


def _with_numbers(accepted: DataFrame, last: dict[str, int], year: int) -> DataFrame:
    """``order_number`` and ``_n``, the place in arrival order, for every accepted sale."""
    placed = dense_index(
        accepted.withColumn("prefix", _prefix()),
        [F.col("arrival_seq"), F.col("feed_id")],
        "_n",
        within=["prefix"],
        within_name="_k",
    )
    used = F.lit(0)
    for prefix, sequence in last.items():
        used = F.when(F.col("prefix") == prefix, F.lit(sequence)).otherwise(used)
    sequence = (used + F.col("_k") + F.lit(1)).cast("bigint")
    number = F.concat(F.col("prefix"), F.lit(f"-{year}-"), F.format_string("%04d", sequence))
    return placed.withColumn("order_number", number).select(*accepted.columns, "order_number", "_n")


def intake_order_numbers(accepted: DataFrame, orders: DataFrame, processing_year: int) -> DataFrame:
    """(feed_id, order_number): PREFIX-YEAR-NNNN, counting on from the orders table.

    The year is the one the batch is processed in, not the order's own. Numbers past 9999
    simply grow longer.
    """
    feed = accepted.select("feed_id", "arrival_seq", "channel")
    last = last_numbers(orders, processing_year)
    return _with_numbers(feed, last, processing_year).select("feed_id", "order_number")


def _customer_names(
    accepted: DataFrame, customers: DataFrame, first_id: int
) -> tuple[DataFrame, DataFrame]:
    """Folded name -> customer id for known and new names, and the new customers."""
    known = customers.groupBy(fold_key("name").alias("_name")).agg(F.min("id").alias("customer_id"))
    first = (
        accepted.where(F.col("customer").isNotNull())
        .groupBy(fold_key("customer").alias("_name"))
        .agg(F.min(F.struct("arrival_seq", "feed_id", "customer")).alias("_first"))
    )
    unknown = first.join(known, "_name", "left_anti").select("_name", "_first.*")
    created = dense_index(unknown, [F.col("arrival_seq"), F.col("feed_id")], "_n").withColumn(
        "customer_id", F.col("_n") + F.lit(first_id)
    )
    return (
        known.unionByName(created.select("_name", "customer_id")),
        created.select(F.col("customer_id").alias("id"), F.col("customer").alias("name")),
    )


def intake_resolve_customers(accepted: DataFrame, customers: DataFrame) -> Customers:
    """Match sales to customers by name (case and accents aside), creating the missing ones.

    Of several customers of one name the lowest id is taken. A new customer is spelled as in
    the first sale that names it, and ids follow the order of those first sales.
    """
    names, new = _customer_names(accepted, customers, next_id(customers))
    feed = accepted.select("feed_id", fold_key("customer").alias("_name"))
    return Customers(feed.join(names, "_name").select("feed_id", "customer_id"), new)


def order_totals(items: DataFrame, key: str = "order_id") -> DataFrame:
    """Quantity times price summed per order, exactly."""
    return items.groupBy(F.col(key).alias("order_id")).agg(
        F.sum(line_amount(items)).alias("total_amount")
    )


def cash_only(name: str) -> Column:
    return F.when(F.col("payment_method") == CASH, F.col(name).cast("decimal(10,2)")).alias(name)


def _payment_columns() -> list[Column]:
    return [
        filled("whatsapp").alias("whatsapp_number"),
        filled("ifood").alias("ifood_order"),
        filled("attendant").alias("attendant"),
        filled("payment_method").alias("payment_method"),
        cash_only("amount_received"),
        cash_only("change_given"),
    ]


def intake_payment_fields(orders_feed: DataFrame) -> DataFrame:
    """Channel contacts, and cash amounts kept only for cash payments. '' counts as absent."""
    return orders_feed.select("feed_id", *_payment_columns())


def _ledger_row(channel: str = "channel") -> list[Column]:
    words = [F.lit("Venda "), F.col("order_number"), F.lit(" ("), F.col(channel), F.lit(")")]
    return [
        F.concat(*words).alias("description"),
        F.col("total_amount").alias("amount"),
        F.lit("entrada").alias("type"),
        F.lit("venda").alias("category"),
        F.to_date("order_date").alias("transaction_date"),
    ]


def ledger_from_orders(orders: DataFrame) -> DataFrame:
    """One income row per order, dated by the order."""
    return orders.select(*_ledger_row())


def quantities_sold(items: DataFrame) -> DataFrame:
    return items.groupBy(F.col("product_id").alias("id")).agg(F.sum("quantity").alias("sold"))


def take_off_stock(products: DataFrame, sold: DataFrame) -> DataFrame:
    """Products less what ``sold`` (id, sold; one row per product) says."""
    left = (F.col("current_stock") - F.coalesce("sold", F.lit(0))).cast("int")
    return (
        products.join(sold, "id", "left").withColumn("current_stock", left).select(*products.columns)
    )


def stock_after_orders(products: DataFrame, items: DataFrame) -> DataFrame:
    """Products with the quantities of ``items`` taken off their stock."""
    return take_off_stock(products, quantities_sold(items))


def append_to(base: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows below a table; columns they lack stay NULL, columns it lacks are dropped."""
    kept = [c for c in rows.columns if c in base.columns]
    return base.unionByName(rows.select(*kept), allowMissingColumns=True)


def apply_new(state: State, new: State) -> State:
    """The tables with an intake's new rows added and its sales taken off the stock."""
    after = {name: append_to(state[name], rows) for name, rows in new.items() if name != "products"}
    return {**state, **after, "products": take_off_stock(state["products"], new["products"])}


class Counters(NamedTuple):
    """Where ids and order numbers go on; all an intake needs to know of the growing tables."""

    customer: int
    order: int
    item: int
    entry: int
    numbers: dict[str, int]  # prefix -> last sequence of the processing year


COUNTED = {
    "customer": "customers",
    "order": "orders",
    "item": "order_items",
    "entry": "financial_transactions",
}


def counters_of(state: State, processing_year: int) -> Counters:
    """Read off the tables, in one job."""
    ids = [
        state[table].select(F.lit(name).alias("name"), F.col("id").alias("value"))
        for name, table in COUNTED.items()
        if "id" in state[table].columns
    ]
    highest = _highest(*ids, _numbers_in_use(state["orders"], processing_year))
    return Counters(
        *[highest.pop(name, 0) + 1 for name in COUNTED],
        numbers=highest,
    )


def order_intake(
    orders_feed: DataFrame,
    items_feed: DataFrame,
    state: State,
    processing_year: int,
    source_tz: str = "UTC",
    strict: bool = False,
    block_orders: int = BLOCK_ORDERS,
    counters: Counters | None = None,
    dealt: bool = False,
) -> Intake:
    """Take in a whole batch: check, allocate stock, number, resolve customers, book.

    ``status`` and payment method are stored as given. With ``counters`` given, orders, lines
    and ledger on hand are not read at all. The feeds are written bucketed by sale, once, and not
    shuffled by sale again; ``dealt`` says that they come from a table bucketed so.
    """
    start = counters or counters_of(state, processing_year)
    items_feed = items_feed.select(
        "feed_id", "line_no", "product_id", "quantity", line_price(items_feed).alias("unit_price")
    )
    if not dealt:
        orders_feed = materialize_by(deal(orders_feed, "feed_id"), "feed_id", "heads")
        items_feed = materialize_by(deal(items_feed, "feed_id"), "feed_id", "asked")
    checked = intake_validate(orders_feed, items_feed, state["products"])
    checked = materialize_by(checked, "feed_id", "checked")
    valid = checked.where(F.col("reject_reason").isNull()).select("feed_id")
    allocation = allocate_stock(
        orders_feed.join(valid, "feed_id", "left_semi"),
        items_feed,
        state["products"],
        strict,
        block_orders,
    )
    taken = allocation.decisions.where("accepted").select("feed_id")
    refused = allocation.decisions.where(~F.col("accepted")).select(
        "feed_id", F.lit("out_of_stock").alias("reject_reason")
    )
    rejected = checked.where(F.col("reject_reason").isNotNull()).unionByName(refused)

    lines = materialize_by(items_feed.join(taken, "feed_id", "left_semi"), "feed_id", "lines")
    totals = order_totals(lines, "feed_id").select(F.col("order_id").alias("feed_id"), F.col("total_amount").alias("_total"))
    feed = materialize(orders_feed.join(taken, "feed_id", "left_semi").join(totals, "feed_id"), "taken")
    names, new_customers = _customer_names(feed, state["customers"], start.customer)
    accepted = materialize(
        _with_numbers(feed, start.numbers, processing_year)
        .withColumn("_name", fold_key("customer"))
        .join(names, "_name")
        .select(
            "feed_id",
            "_n",
            (F.col("_n") + F.lit(start.order)).alias("id"),
            "order_number",
            "customer_id",
            F.col("_total").cast("decimal(10,2)").alias("total_amount"),
            "status",
            filled("observations").alias("observations"),
            F.col("channel").alias("_channel"),
            F.lower("channel").alias("channel"),
            to_utc("order_date", source_tz).alias("order_date"),
            *_payment_columns(),
        ),
        "accepted",
    )
    new_items = lines.join(accepted.select("feed_id", F.col("id").alias("order_id")), "feed_id").select(
        "order_id", F.col("line_no").alias("line_number"), "product_id", "quantity", "unit_price"
    )
    if "id" in state["order_items"].columns:
        by_line = [F.col(c) for c in ("order_id", "line_number", "product_id", "quantity", "unit_price")]
        new_items = dense_index(new_items, by_line, "_i").withColumn(
            "id", F.col("_i") + F.lit(start.item)
        )
    entry_id = (F.col("_n") + F.lit(start.entry)).alias("id")
    new = {
        "customers": new_customers,
        "products": quantities_sold(lines),
        "orders": accepted.drop("feed_id", "_n", "_channel"),
        "order_items": new_items,
        "financial_transactions": accepted.select(entry_id, *_ledger_row("_channel")),
    }
    return Intake(
        accepted.drop("_n", "_channel"),
        rejected,
        allocation.shortages,
        new,
        apply_new(state, new),
    )
