"""Named queries for sources, sinks, bulk changes and order intake."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tallybook.functions.rows import stack_metrics
from tallybook.operators import changes, intake, recipe_changes, revisions
from tallybook.operators.allocation import Allocation, allocate_stock
from tallybook.plans.parameters import PROCESSING_YEAR, STOCK_FACTOR
from tallybook.sources import tables
from tallybook.sources.bindings import Bindings
from tallybook.sources.scratch import scratch_path

Query = Callable[[Bindings], DataFrame]


def _keys(name: str, df: DataFrame, key: str = "id") -> DataFrame:
    return df.select(F.lit(name).alias("table_name"), F.col(key).alias("key"))


# -- sources and sinks ------------------------------------------------------------------------


def _bound_tables(b: Bindings) -> dict[str, DataFrame]:
    line_id = (F.col("order_id") * 100 + F.col("line_number")).alias("id")
    return {
        "customers": b.customers,
        "products": b.products,
        "orders": b.orders,
        "order_items": b.order_items.select("*", line_id),
        "task_categories": b.task_categories,
        "tasks": b.tasks,
        "recipes": b.recipes,
        "recipe_log": b.recipe_log,
        "recipe_ingredients": b.recipe_ingredients,
        "oil_disposals": b.oil_disposals,
        "financial_transactions": b.ledger,
    }


def _load_tables(b: Bindings) -> DataFrame:
    """Tables written and read back: rows of each, and how many of them break its declaration."""
    root = scratch_path(b.spark, "tables")
    bound = _bound_tables(b)
    for name, df in bound.items():
        tables.append_rows(df, f"{root}/{name}")
    loaded = tables.load_tables(b.spark, {name: f"{root}/{name}" for name in bound})
    counted = [
        df.withColumn("reason", tables.first_violation(name)).select(F.lit(name).alias("table_name"), "reason")
        for name, df in loaded.items()
    ]
    return (
        stack_metrics(*counted)
        .groupBy("table_name")
        .agg(F.count(F.lit(1)).alias("rows"), F.count("reason").alias("violations"))
    )


def _append_rows(b: Bindings) -> DataFrame:
    """Tasks written, the accepted new tasks appended to the same files, all read back."""
    path = scratch_path(b.spark, "tasks")
    tables.append_rows(b.tasks, path)
    tables.append_rows(_inserted(b).accepted, path)
    return b.spark.read.parquet(path)


def _write_snapshot(b: Bindings) -> DataFrame:
    """Products before and after an update as two versions; the later one read back."""
    root = scratch_path(b.spark, "snapshots")
    tables.write_snapshot({"products": b.products}, root, "1")
    old = tables.read_snapshot(b.spark, root, "1", ["products"])["products"]
    new = changes.update_rows(old, _product_changes(b), ["current_stock", "unit"], "products").rows
    tables.write_snapshot({"products": new}, root, "2")
    return tables.read_snapshot(b.spark, root, "2", ["products"])["products"]


# -- bulk changes -----------------------------------------------------------------------------


def _new_tasks(b: Bindings) -> DataFrame:
    """Every event as a new task; errors lack a title, some priorities and categories are unknown."""
    user, event = F.col("user_id"), F.col("event_id")
    return b.source("events").select(
        event.alias("seq"),
        F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type")).alias("title"),
        F.when(F.col("event_type") != "view", F.col("props")).otherwise("").alias("description"),
        F.col("ts").alias("due_date"),
        F.when(user % 9 == 0, "urgent").otherwise("low").alias("priority"),
        F.lit("pending").alias("status"),
        (user % 6).alias("category_id"),
        (event % 4 * 15).cast("int").alias("reminder_minutes"),
    )


def _inserted(b: Bindings) -> changes.Inserted:
    return changes.insert_rows(
        b.tasks, _new_tasks(b), "tasks", ["seq"], {"category_id": b.task_categories}
    )


def _product_changes(b: Bindings) -> DataFrame:
    """Every event as a stock count of the product its user id names; a later one wins."""
    return b.source("events").select(
        F.col("event_id").alias("seq"),
        F.col("user_id").alias("id"),
        F.floor("value").cast("int").alias("current_stock"),
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("unit"),
    )


def _update_rows(b: Bindings) -> DataFrame:
    done = changes.update_rows(
        b.products, _product_changes(b), ["current_stock", "unit"], "products"
    )
    return done.rows


def _delete_rows(b: Bindings) -> DataFrame:
    """What is left of three tables when the customers of one segment go."""
    machinery = b.source("customer").where(F.col("c_mktsegment") == "MACHINERY")
    left = changes.delete_rows(
        {"customers": b.customers, "orders": b.orders, "order_items": b.order_items},
        "customers",
        machinery.select(F.col("c_custkey").alias("id")),
    )
    return (
        _keys("customers", left["customers"])
        .unionByName(_keys("orders", left["orders"]))
        .unionByName(_keys("order_items", left["order_items"], "order_id"))
    )


def _delete_products(b: Bindings) -> DataFrame:
    """What is left of three tables when the promotional products go."""
    left = changes.delete_rows(
        {
            "products": b.products,
            "order_items": b.order_items,
            "recipe_ingredients": b.recipe_ingredients,
        },
        "products",
        b.products.where(F.col("category") == "PROMO"),
    )
    return (
        _keys("products", left["products"])
        .unionByName(_keys("order_items", left["order_items"], "order_id"))
        .unionByName(_keys("recipe_ingredients", left["recipe_ingredients"]))
    )


def _insert_ledger_rows(b: Bindings) -> DataFrame:
    """Every customer's balance as an opening entry; one segment has an unknown category."""
    balance, segment = F.col("c_acctbal"), F.col("c_mktsegment")
    entries = b.source("customer").select(
        F.col("c_custkey").alias("seq"),
        F.col("c_name").alias("description"),
        F.abs(balance).alias("amount"),
        F.when(balance < 0, "saida").otherwise("entrada").alias("type"),
        F.when(segment == "FURNITURE", "salario").otherwise("outros").alias("category"),
        F.lit("1998-01-01").cast("date").alias("transaction_date"),
    )
    done = changes.insert_rows(b.ledger, entries, "financial_transactions", ["seq"])
    return _as_numbers(done.rows, "amount")


def _mark_reminders_sent(b: Bindings) -> DataFrame:
    """All tasks, flagged where the event behind them was an error."""
    errors = b.source("events").where(F.col("event_type") == "error")
    unsent = b.tasks.select("id", "title", F.lit(False).alias("reminder_sent"))
    return changes.mark_reminders_sent(unsent, errors.select(F.col("event_id").alias("id")))


def _delete_set_null(b: Bindings) -> DataFrame:
    gone = b.task_categories.where(F.col("name").isin("ASIA", "EUROPE"))
    return changes.delete_set_null(b.tasks, "category_id", gone)


def _replace_children(b: Bindings) -> DataFrame:
    """The lines of every pending order merged to one per product."""
    pending = b.orders.where(F.col("status") == "pending").select("id")
    merged = (
        b.order_items.groupBy("order_id", "product_id")
        .agg(
            F.min("line_number").alias("line_number"),
            F.sum("quantity").cast("int").alias("quantity"),
            F.max("unit_price").alias("unit_price"),
        )
        .join(pending.withColumnRenamed("id", "order_id"), "order_id", "left_semi")
    )
    found = changes.replace_children(b.order_items, "order_id", pending, merged)
    return found.withColumn("unit_price", F.col("unit_price").cast("double"))


def _recipe_feed(b: Bindings, **more: Column) -> DataFrame:
    """Every order as a recipe; pending ones lack a name."""
    key = F.col("o_orderkey")
    named = F.concat(F.lit("Receita "), key.cast("string"))
    return b.source("orders").select(
        key.alias("feed_id"),
        F.when(F.col("o_orderstatus") != "P", named).alias("name"),
        F.col("o_orderpriority").alias("category"),
        (key % 90).cast("int").alias("prep_time"),
        F.col("o_orderstatus").alias("instructions"),
        *[value.alias(name) for name, value in more.items()],
    )


def _recipe_lines(b: Bindings) -> DataFrame:
    """Every line as an ingredient; some seventh lines name no product, some sixth ones no unit."""
    line, part = F.col("l_linenumber"), F.col("l_partkey")
    return b.source("lineitem").select(
        F.col("l_orderkey").alias("feed_id"),
        line.alias("line_no"),
        F.when((line == 7) & (part % 4 == 0), -part).otherwise(part).alias("product_id"),
        F.col("l_quantity").alias("quantity"),
        F.when((line != 6) | (F.col("l_returnflag") != "A"), "un").alias("unit"),
        F.col("l_returnflag").alias("notes"),
    )


def _recipes_inserted(b: Bindings) -> recipe_changes.RecipesWritten:
    return recipe_changes.insert_recipes(
        b.recipes, b.recipe_ingredients, b.products, _recipe_feed(b), _recipe_lines(b)
    )


def _recipes_revised(b: Bindings) -> recipe_changes.RecipesWritten:
    """Orders as revisions of their customer's recipe; some name an unknown one."""
    customer = F.col("o_custkey")
    named = F.when(F.col("o_orderkey") % 11 == 0, -customer).otherwise(customer)
    return recipe_changes.revise_recipes(
        b.recipes, b.recipe_ingredients, b.products, _recipe_feed(b, id=named), _recipe_lines(b)
    )


def _with_quantity(ingredients: DataFrame) -> DataFrame:
    return ingredients.withColumn("quantity", F.col("quantity").cast("double"))


# -- order intake -----------------------------------------------------------------------------


def intake_state(b: Bindings) -> intake.State:
    stocked = F.col("current_stock") * F.lit(STOCK_FACTOR)
    return {
        "customers": b.customers.select("id", "name"),
        "products": b.products.withColumn("current_stock", stocked),
        "orders": b.orders,
        "order_items": b.order_items,
        "financial_transactions": b.ledger,
    }


def _intake_validate(b: Bindings) -> DataFrame:
    """Every sale against a catalogue without the promotional products."""
    sold = b.products.where(F.col("category") != "PROMO")
    return intake.intake_validate(b.orders_feed, b.items_feed, sold)


def _allocation(b: Bindings) -> Allocation:
    """Every sale against a multiple of the stock."""
    return allocate_stock(b.orders_feed, b.items_feed, intake_state(b)["products"])


def _taken(b: Bindings) -> intake.Intake:
    return intake.order_intake(b.orders_feed, b.items_feed, intake_state(b), PROCESSING_YEAR)


def _order_intake(b: Bindings) -> DataFrame:
    done = _taken(b)
    accepted = done.accepted.select(
        "feed_id",
        "order_number",
        "customer_id",
        F.col("total_amount").cast("double").alias("total_amount"),
        F.lit(None).cast("string").alias("reject_reason"),
    )
    return accepted.unionByName(done.rejected, allowMissingColumns=True)


def taken_in(state: intake.State, decided: DataFrame) -> DataFrame:
    """Every table an intake leaves behind, and what was decided, stacked: the key and the values of each row."""

    def told(table: str, rows: DataFrame, key: str, other: str | None, amount: str | None, *texts: str) -> DataFrame:
        nothing = F.lit(None)
        return rows.select(
            F.lit(table).alias("table_name"),
            F.col(key).cast("bigint").alias("key"),
            (F.col(other) if other else nothing).cast("bigint").alias("other_key"),
            (F.col(amount) if amount else nothing).cast("double").alias("amount"),
            F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in texts]).alias("detail"),
        )

    orders = state["orders"].withColumn("day", F.to_date("order_date"))
    return reduce(
        DataFrame.unionByName,
        [
            told("decisions", decided, "feed_id", None, None, "order_number", "reject_reason"),
            told("customers", state["customers"], "id", None, None, "name"),
            told("products", state["products"], "id", None, "current_stock", "name"),
            told(
                "orders", orders, "id", "customer_id", "total_amount",
                "order_number", "channel", "status", "day", "payment_method",
            ),
            told("order_items", state["order_items"], "order_id", "product_id", "unit_price", "line_number", "quantity"),
            told(
                "financial_transactions", state["financial_transactions"], "id", None, "amount",
                "description", "type", "category", "transaction_date",
            ),
        ],
    )


def _order_intake_tables(b: Bindings) -> DataFrame:
    done = _taken(b)
    decided = done.accepted.select("feed_id", "order_number").unionByName(done.rejected, allowMissingColumns=True)
    return taken_in(done.state, decided)


def _order_totals(b: Bindings) -> DataFrame:
    found = intake.order_totals(b.items_feed, "feed_id")
    return found.withColumn("total_amount", F.col("total_amount").cast("double"))


def _payment_fields(b: Bindings) -> DataFrame:
    found = intake.intake_payment_fields(b.orders_feed)
    return found.withColumns(
        {c: F.col(c).cast("double") for c in ("amount_received", "change_given")}
    )


def _ledger_from_orders(b: Bindings) -> DataFrame:
    found = intake.ledger_from_orders(b.orders)
    return found.withColumn("amount", F.col("amount").cast("double"))


def _revision(b: Bindings) -> revisions.Revision:
    """Every order as a change of the order its customer id names, so orders change repeatedly."""
    source = F.col("o_orderstatus")
    orders = b.source("orders").select(
        F.col("o_orderkey").alias("change_id"),
        F.col("o_custkey").alias("id"),
        F.when(source == "F", "delivered").when(source == "O", "archived").alias("status"),
        F.when(source == "F", F.col("o_orderpriority")).alias("observations"),
        F.when(
            F.col("o_orderpriority") == "1-URGENT",
            F.concat(F.lit("Cliente novo "), F.col("o_custkey").cast("string")),
        ).alias("customer"),
        F.when(
            F.col("o_orderpriority") == "5-LOW", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm")
        ).alias("order_date"),
        F.when(source == "F", "dinheiro").otherwise("pix").alias("payment_method"),
        F.col("o_totalprice").alias("amount_received"),
        F.lit(0.5).alias("change_given"),
    )
    lines = b.items_feed.select(
        F.col("feed_id").alias("change_id"),
        "line_no",
        "product_id",
        "quantity",
        F.coalesce("unit_price", F.when(F.col("line_no") != 1, F.col("valor"))).alias("unit_price"),
    )
    return revisions.revise_orders(orders, lines, intake_state(b))


def _as_numbers(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


def _revised_orders(b: Bindings) -> DataFrame:
    found = _revision(b).state["orders"].select(
        "id",
        "order_number",
        "customer_id",
        "total_amount",
        "status",
        "observations",
        "order_date",
        "payment_method",
        "amount_received",
        "change_given",
    )
    return _as_numbers(found, "total_amount", "amount_received", "change_given")


def _voided(b: Bindings) -> DataFrame:
    """What is left of three tables when every pending order goes."""
    left = revisions.void_orders(b.orders.where(F.col("status") == "pending"), intake_state(b))
    return (
        _keys("orders", left["orders"])
        .unionByName(_keys("order_items", left["order_items"], "order_id"))
        .unionByName(_keys("financial_transactions", left["financial_transactions"]))
    )


QUERIES: dict[str, Query] = {
    "load_tables": _load_tables,
    "append_rows": _append_rows,
    "write_snapshot": _write_snapshot,
    "to_json_documents": lambda b: tables.to_json_documents(b.products),
    "insert_rows": lambda b: _inserted(b).rows,
    "insert_rows_rejected": lambda b: _inserted(b).rejected.select("seq", "reject_reason"),
    "update_rows": _update_rows,
    "delete_rows": _delete_rows,
    "delete_products": _delete_products,
    "delete_set_null": _delete_set_null,
    "insert_ledger_rows": _insert_ledger_rows,
    "insert_recipes": lambda b: _recipes_inserted(b).recipes,
    "insert_recipe_ingredients": lambda b: _with_quantity(_recipes_inserted(b).ingredients),
    "insert_recipes_rejected": lambda b: _recipes_inserted(b).rejected,
    "revise_recipes": lambda b: _recipes_revised(b).recipes,
    "revise_recipe_ingredients": lambda b: _with_quantity(_recipes_revised(b).ingredients),
    "revise_recipes_rejected": lambda b: _recipes_revised(b).rejected,
    "mark_reminders_sent": _mark_reminders_sent,
    "replace_children": _replace_children,
    "intake_validate": _intake_validate,
    "intake_allocate_stock": lambda b: _allocation(b).decisions,
    "intake_shortages": lambda b: _allocation(b).shortages,
    "intake_order_numbers": lambda b: intake.intake_order_numbers(
        b.orders_feed, b.orders, PROCESSING_YEAR
    ),
    "order_number_max": lambda b: intake.order_number_max(b.orders),
    "intake_resolve_customers": lambda b: intake.intake_resolve_customers(
        b.orders_feed, b.customers
    ).links,
    "intake_new_customers": lambda b: intake.intake_resolve_customers(b.orders_feed, b.customers).new,
    "order_totals": _order_totals,
    "intake_payment_fields": _payment_fields,
    "ledger_from_orders": _ledger_from_orders,
    "stock_after_orders": lambda b: intake.stock_after_orders(b.products, b.order_items),
    "order_intake": _order_intake,
    "order_intake_tables": _order_intake_tables,
    "revise_orders": _revised_orders,
    "revise_orders_items": lambda b: _as_numbers(_revision(b).state["order_items"], "unit_price"),
    "revise_orders_ledger": lambda b: _as_numbers(
        _revision(b).state["financial_transactions"], "amount"
    ),
    "revise_orders_rejected": lambda b: _revision(b).rejected,
    "void_orders": _voided,
}
