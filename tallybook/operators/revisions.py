"""Changing and deleting orders that were already taken in."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from tallybook.operators.changes import replace_children
from tallybook.operators.intake import (
    MAX_TOTAL,
    SALE_NUMBER,
    State,
    blank,
    cash_only,
    filled,
    intake_resolve_customers,
    to_utc,
)
from tallybook.schemas import ORDER_STATUSES
from tallybook.sources.scratch import materialize


class Revision(NamedTuple):
    state: State
    rejected: DataFrame  # change_id, id, reject_reason


def _checked(
    changes: DataFrame, item_changes: DataFrame, state: State, source_tz: str
) -> DataFrame:
    """Changes with their UTC date, new total and the first thing wrong with them."""
    products = state["products"].select(F.col("id").alias("product_id"), F.lit(True).alias("_known"))
    orders = state["orders"].select("id", F.lit(True).alias("_exists"))
    product = F.col("product_id")
    incomplete = (
        product.isNull() | (product == 0) | F.col("quantity").isNull() | F.col("unit_price").isNull()
    )
    # Line number and fault as one number, so that the first faulty line is a plain minimum.
    fault = F.when(incomplete, 0).when(F.col("_known").isNull(), 1)
    lines = (
        item_changes.join(products, "product_id", "left")
        .groupBy("change_id")
        .agg(
            F.min(F.coalesce("line_no", F.lit(0)).cast("bigint") * 2 + fault).alias("_fault"),
            F.sum(F.col("quantity") * F.col("unit_price")).alias("_total"),
        )
    )
    utc = F.when(~blank("order_date"), to_utc("order_date", source_tz))
    reason = F.coalesce(
        F.when(blank("status"), F.lit("no_status")),
        F.when(~blank("order_date") & F.col("_utc").isNull(), F.lit("invalid_date")),
        F.when(F.pmod("_fault", F.lit(2)) == 0, F.lit("invalid_item")),
        F.when(F.pmod("_fault", F.lit(2)) == 1, F.lit("unknown_product")),
        F.when(F.col("_exists").isNull(), F.lit("unknown_order")),
        F.when(F.abs("_total") > MAX_TOTAL, F.lit("total_too_large")),
    )
    return (
        changes.withColumn("_utc", utc)
        .join(lines, "change_id", "left")
        .join(orders, "id", "left")
        .withColumn("_total", F.coalesce("_total", F.lit(0)))
        .withColumn("reject_reason", reason)
    )


def revise_orders(
    changes: DataFrame, item_changes: DataFrame, state: State, source_tz: str = "UTC"
) -> Revision:
    """Apply order changes in ``change_id`` order; the last valid one of an order decides.

    A change replaces the order's lines (none at all means total 0), status (an unknown one
    becomes pending), observations and payment; date and customer only where it names them, so
    those come from the last valid change that does. The order's ledger rows follow. Stock is
    not touched. Changes shrink to one per order before they meet the tables.
    """
    checked = materialize(_checked(changes, item_changes, state, source_tz), "changes")
    rejected = checked.where(F.col("reject_reason").isNotNull()).select(
        "change_id", "id", "reject_reason"
    )
    valid = checked.where(F.col("reject_reason").isNull())
    named = valid.where(~blank("customer")).select(
        F.col("change_id").alias("feed_id"), F.col("change_id").alias("arrival_seq"), "customer"
    )
    buyers = intake_resolve_customers(named, state["customers"])
    known_status = F.when(F.col("status").isin(*ORDER_STATUSES), F.col("status")).otherwise("pending")
    last = valid.groupBy("id").agg(
        F.max(
            F.struct(
                "change_id",
                known_status.alias("status"),
                F.coalesce("observations", F.lit("")).alias("observations"),
                F.col("_total").cast("decimal(10,2)").alias("total_amount"),
                filled("payment_method").alias("payment_method"),
                cash_only("amount_received"),
                cash_only("change_given"),
            )
        ).alias("_last"),
        F.max(F.when(F.col("_utc").isNotNull(), F.struct("change_id", "_utc"))).alias("_dated"),
        F.max(F.when(~blank("customer"), F.col("change_id"))).alias("feed_id"),
    )
    numbers = state["orders"].select("id", "order_number", F.col("order_date").alias("_old_date"))
    revised = materialize(
        last.join(buyers.links, "feed_id", "left")
        .join(numbers, "id")
        .select(
            "id",
            "order_number",
            "_last.*",
            F.coalesce("_dated._utc", "_old_date").alias("order_date"),
            "customer_id",
        ),
        "revised",
    )
    return Revision(
        dict(
            state,
            customers=state["customers"].unionByName(buyers.new, allowMissingColumns=True),
            orders=_revised_orders(state["orders"], revised),
            order_items=_revised_items(state["order_items"], revised, item_changes),
            financial_transactions=_revised_ledger(state["financial_transactions"], revised),
        ),
        rejected,
    )


REVISED = (
    "status",
    "observations",
    "total_amount",
    "payment_method",
    "amount_received",
    "change_given",
    "order_date",
)


def _revised_orders(orders: DataFrame, revised: DataFrame) -> DataFrame:
    new = revised.select("id", F.struct(*REVISED, "customer_id").alias("_new"))
    hit = F.col("_new").isNotNull()
    picked = {c: F.when(hit, F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in REVISED}
    picked["customer_id"] = F.coalesce("_new.customer_id", "customer_id").alias("customer_id")
    return orders.join(new, "id", "left").select(*[picked.get(c, F.col(c)) for c in orders.columns])


def _revised_items(order_items: DataFrame, revised: DataFrame, item_changes: DataFrame) -> DataFrame:
    lines = item_changes.join(
        revised.select(F.col("id").alias("order_id"), "change_id"), "change_id"
    ).select(
        "order_id",
        F.col("line_no").alias("line_number"),
        "product_id",
        F.col("quantity").cast("int").alias("quantity"),
        F.col("unit_price").cast("decimal(10,2)").alias("unit_price"),
    )
    order = ("order_id", "line_number", "product_id", "quantity")
    return replace_children(order_items, "order_id", revised, lines, order)


def _revised_ledger(ledger: DataFrame, revised: DataFrame) -> DataFrame:
    """Sale rows linked by the exact order number in their description."""
    by_number = revised.groupBy(F.col("order_number").alias("_number")).agg(
        F.max(F.struct("change_id", "total_amount", F.to_date("order_date").alias("_day"))).alias("_new")
    )
    booked_sale = F.coalesce(
        (F.col("type") == "entrada") & (F.col("category") == "venda") & (_sale_number() != ""), F.lit(False)
    )
    hit = F.col("_new").isNotNull()
    picked = {
        "amount": F.when(hit, F.col("_new.total_amount")).otherwise(F.col("amount")).alias("amount"),
        "transaction_date": F.when(hit, F.col("_new._day"))
        .otherwise(F.col("transaction_date"))
        .alias("transaction_date"),
    }
    sales = (
        ledger.where(booked_sale)
        .withColumn("_number", _sale_number())
        .join(by_number, "_number", "left")
        .select(*[picked.get(c, F.col(c)) for c in ledger.columns])
    )
    return sales.unionByName(ledger.where(~booked_sale))


def _sale_number() -> Column:
    """The order number a ledger row names; '' for rows that are no sale.

    Rows without a number stay out of the joins below: they would all share one key.
    """
    return F.regexp_extract("description", SALE_NUMBER, 1)


def void_orders(ids: DataFrame, state: State) -> State:
    """Delete the orders named in ``ids``, their lines and their ledger rows; no restocking.

    Ledger rows are matched by the exact order number, whatever their type. Tasks keep the keys of
    what goes at hand and let the tables pass by, which are not sorted for that.
    """
    gone = ids.select("id").hint("shuffle_hash")
    orders, items = state["orders"], state["order_items"]
    ledger = state["financial_transactions"]
    numbers = orders.join(gone, "id", "left_semi").select(F.col("order_number").alias("_number"))
    order_ids = ids.select(F.col("id").alias("order_id")).hint("shuffle_hash")
    named = F.coalesce(_sale_number() != "", F.lit(False))
    kept_sales = (
        ledger.where(named)
        .withColumn("_number", _sale_number())
        .join(numbers.hint("shuffle_hash"), "_number", "left_anti")
        .drop("_number")
    )
    return dict(
        state,
        orders=orders.join(gone, "id", "left_anti"),
        order_items=items.join(order_ids, "order_id", "left_anti"),
        financial_transactions=kept_sales.unionByName(ledger.where(~named)),
    )
