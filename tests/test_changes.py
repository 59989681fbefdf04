"""Bulk changes against what a dictionary of rows would become."""

import random

import pytest
import shop
from shop import at, day, frame, ids, rows, table

from tallybook.operators import changes


def test_insert_checks_completes_and_numbers(spark):
    new = frame(
        spark,
        "seq bigint, name string, category string, current_stock int, minimum_stock int, unit string",
        [
            (30, "Bolo", "Doces", 1, 2, "un"),
            (10, "Suco", "Bebidas", 0, 1, "l"),
            (20, "", "Bebidas", 0, 1, "l"),
            (40, "Sal", "Outros", 0, 0, "kg"),  # a minimum of 0 counts as not given
            (50, "Mel", "Outros", None, 1, "kg"),
        ],
    )
    done = changes.insert_rows(shop.products(spark), new, "products", ["seq"], as_of=shop.AS_OF)
    got = [(r["id"], r["name"], r["created_at"]) for r in done.accepted.orderBy("id").collect()]
    assert got == [(9, "Suco", shop.AS_OF), (10, "Bolo", shop.AS_OF)]
    assert done.rows.count() == 10
    assert sorted((r["seq"], r["reject_reason"]) for r in done.rejected.collect()) == [
        (20, "missing:name"), (40, "missing:minimum_stock"), (50, "missing:current_stock")
    ]


def test_insert_without_a_stated_column_is_rejected(spark):
    new = frame(
        spark, "name string, category string, minimum_stock int, unit string", [("Bolo", "Doces", 2, "un")]
    )
    done = changes.insert_rows(shop.products(spark), new, "products", ["name"])
    assert [r["reject_reason"] for r in done.rejected.collect()] == ["missing:current_stock"]
    assert done.accepted.count() == 0


def test_insert_tasks(spark):
    new = frame(
        spark,
        "seq bigint, title string, description string, due_date timestamp_ntz, priority string,"
        " status string, category_id bigint, reminder_minutes int",
        [
            (1, "a", "", at("2024-01-01"), "low", "pending", 0, 0),
            (2, "b", "x", at("2024-01-01"), "urgent", "pending", 1, 5),
            (3, "c", "x", None, "low", "pending", 1, 5),
            (4, "d", "x", at("2024-01-01"), "low", "pending", 9, 5),
            (5, "e", "x", at("2024-01-01"), "low", "completed", 2, 5),
        ],
    )
    done = changes.insert_rows(
        shop.tasks(spark), new, "tasks", ["seq"], {"category_id": shop.task_categories(spark)}
    )
    a, e = done.accepted.orderBy("id").collect()
    assert (a["id"], a["description"], a["category_id"], a["reminder_minutes"]) == (6, None, None, None)
    assert (e["id"], e["title"], e["reminder_sent"]) == (7, "e", False)
    assert dict((r["seq"], r["reject_reason"]) for r in done.rejected.collect()) == {
        2: "invalid:priority", 3: "missing:due_date", 4: "unknown:category_id"
    }


def test_insert_into_empty_table_starts_at_one(spark):
    new = frame(spark, "name string, color string", [("x", "#1"), ("y", None)])
    done = changes.insert_rows(
        shop.task_categories(spark).limit(0), new, "task_categories", ["name"]
    )
    assert rows(done.rows.select("id", "name")) == [(1, "x")]


@pytest.mark.parametrize(
    "name,schema,row,reason",
    [
        ("recipe_log", "recipe_id bigint, action string", (1, "eaten"), "invalid:action"),
        (
            "financial_transactions",
            "description string, amount double, type string, category string, transaction_date date",
            ("x", 1.5, "entrada", "salario", day("2024-01-01")),
            "invalid:category",
        ),
        (
            "oil_disposals",
            "product string, amount double, disposal_date date",
            ("x", None, day("2024-01-01")),
            "missing:amount",
        ),
    ],
)
def test_insert_rejects_what_a_table_cannot_hold(spark, name, schema, row, reason):
    base = table(spark, name, [])
    first = schema.split()[0]
    done = changes.insert_rows(base, frame(spark, schema, [row]), name, [first])
    assert [r["reject_reason"] for r in done.rejected.collect()] == [reason]


def test_updates_follow_the_last_change(spark):
    rng = random.Random(3)
    model = {r["id"]: [r["current_stock"], r["unit"]] for r in shop.products(spark).collect()}
    log = []
    for seq in range(60):
        # One product gets most of the changes; ids 9 and 10 do not exist.
        log.append((seq, rng.choice([1, 1, 1, 2, 5, 9, 10]), rng.randint(0, 99), f"u{seq}"))
    for _, i, stock, unit in log:
        if i in model:
            model[i] = [stock, unit]
    feed = frame(spark, "seq bigint, id bigint, current_stock int, unit string", log).repartition(5)
    done = changes.update_rows(shop.products(spark), feed, ["current_stock", "unit"], "products")
    assert {r["id"]: [r["current_stock"], r["unit"]] for r in done.rows.collect()} == model
    assert sorted(rows(done.unknown_ids)) == [(9,), (10,)]


def test_update_sets_null_and_rejects_what_does_not_fit(spark):
    feed = frame(
        spark,
        "seq bigint, id bigint, description string, status string",
        [(1, 1, "x", "completed"), (2, 1, "y", "lost"), (3, 2, None, "pending")],
    )
    done = changes.update_rows(shop.tasks(spark), feed, ["description", "status"], "tasks")
    got = {r["id"]: (r["description"], r["status"]) for r in done.rows.collect()}
    assert got[1] == ("x", "completed") and got[2] == (None, "pending")
    assert [(r["seq"], r["reject_reason"]) for r in done.rejected.collect()] == [(2, "invalid:status")]


def test_mark_reminders_sent(spark):
    got = changes.mark_reminders_sent(shop.tasks(spark), ids(spark, 2, 2, 70))
    assert [r["id"] for r in got.where("reminder_sent").collect()] == [2]
    assert got.count() == 5


def test_delete_follows_references(spark):
    shop_tables = {
        "customers": shop.customers(spark),
        "orders": shop.orders(spark),
        "order_items": shop.order_items(spark),
    }
    left = changes.delete_rows(shop_tables, "customers", ids(spark, 4, 99))
    assert sorted(r["id"] for r in left["customers"].collect()) == [1, 2, 3]
    assert 2 not in {r["id"] for r in left["orders"].collect()}
    assert 2 not in {r["order_id"] for r in left["order_items"].collect()}
    assert left["order_items"].count() == 7

    left = changes.delete_rows(
        {
            "products": shop.products(spark),
            "order_items": shop.order_items(spark),
            "recipe_ingredients": shop.recipe_ingredients(spark),
        },
        "products",
        ids(spark, 1, 3),
    )
    assert sorted(r["id"] for r in left["order_items"].collect()) == [2, 3, 7, 8]
    assert sorted(r["id"] for r in left["recipe_ingredients"].collect()) == [3, 5, 6]

    left = changes.delete_rows(
        {
            "recipes": shop.recipes(spark),
            "recipe_log": shop.recipe_log(spark),
            "recipe_ingredients": shop.recipe_ingredients(spark),
        },
        "recipes",
        ids(spark, 1),
    )
    assert sorted(r["id"] for r in left["recipe_log"].collect()) == [3, 4, 5]
    assert sorted(r["id"] for r in left["recipe_ingredients"].collect()) == [4, 5, 6]

    left = changes.delete_rows({"oil_disposals": shop.oil_disposals(spark)}, "oil_disposals", ids(spark, 1))
    assert left["oil_disposals"].count() == 3


def test_deleting_a_category_clears_it(spark):
    left = changes.delete_rows(
        {"task_categories": shop.task_categories(spark), "tasks": shop.tasks(spark)},
        "task_categories",
        ids(spark, 1),
    )
    assert {r["id"]: r["category_id"] for r in left["tasks"].collect()} == {1: None, 2: 2, 3: None, 4: 9, 5: None}
    assert rows(left["task_categories"].select("id")) == [(2,)]


def test_replace_children_numbers_on(spark):
    new = frame(
        spark,
        "recipe_id bigint, product_id bigint, quantity decimal(10,2), unit string, notes string, created_at timestamp_ntz",
        [(1, 4, shop.Decimal("2.00"), "un", None, None), (1, 1, shop.Decimal("1.00"), "un", None, None)],
    )
    got = changes.replace_children(
        shop.recipe_ingredients(spark), "recipe_id", ids(spark, 1, 3), new, ["recipe_id", "product_id"]
    )
    assert sorted((r["id"], r["recipe_id"], r["product_id"]) for r in got.collect()) == [
        (4, 2, 1), (5, 2, 5), (6, 2, 99), (7, 1, 1), (8, 1, 4)
    ]
