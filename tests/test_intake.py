"""Order intake against the one-sale-at-a-time model, and its single steps on awkward sales."""

import random
from decimal import Decimal

import pytest
import sequential
import shop
from pyspark.sql import functions as F
from shop import at, day, frame, ids, rows, table

from tallybook.operators import intake, revisions
from tallybook.operators.allocation import allocate_stock

FEED = (
    "feed_id bigint, arrival_seq bigint, customer string, channel string, status string,"
    " observations string, order_date string, whatsapp string, ifood string, attendant string,"
    " payment_method string, amount_received double, change_given double"
)
LINES = (
    "feed_id bigint, line_no int, product_id bigint, quantity int, unit_price decimal(10,2),"
    " valor decimal(10,2)"
)


def sale(feed_id, seq=None, **named):
    row = dict(
        feed_id=feed_id,
        arrival_seq=feed_id if seq is None else seq,
        customer="Maria",
        channel="balcao",
        status="paid",
        observations=None,
        order_date="2024-07-17T10:30",
        whatsapp=None,
        ifood=None,
        attendant=None,
        payment_method="pix",
        amount_received=None,
        change_given=None,
    )
    return {**row, **named}


def feed(spark, *sales):
    return frame(spark, FEED, [tuple(s.values()) for s in sales])


def line(feed_id, number, product, quantity=1, price="1.00", valor=None):
    money = lambda v: None if v is None else Decimal(v)
    return (feed_id, number, product, quantity, money(price), money(valor))


def lines(spark, *rows_):
    return frame(spark, LINES, list(rows_))


def stock(spark, levels):
    return table(
        spark,
        "products",
        [
            dict(id=i, name=f"p{i}", category="x", current_stock=n, minimum_stock=1, unit="un")
            for i, n in levels.items()
        ],
    )


def state(spark, levels):
    return {
        "customers": shop.customers(spark),
        "products": stock(spark, levels),
        "orders": shop.orders(spark),
        "order_items": shop.order_items(spark),
        "financial_transactions": shop.ledger(spark),
    }


# -- stock ------------------------------------------------------------------------------------


def random_batch(seed, orders, products, hot):
    rng = random.Random(seed)
    levels = {p: rng.randint(0, 30) for p in range(1, products + 1)}
    sales = [(i, rng.randint(0, 10**6)) for i in range(1, orders + 1)]
    asked = []
    for i, _ in sales:
        for _ in range(rng.randint(1, 3)):
            product = 1 if rng.random() < hot else rng.randint(1, products)
            asked.append((i, product, rng.randint(1, 9)))
    return levels, sales, asked


@pytest.mark.parametrize(
    "seed,orders,products,hot,block,strict",
    [
        (1, 40, 4, 0.3, 1000, False),
        (2, 60, 6, 0.3, 7, False),
        (3, 60, 5, 0.6, 3, True),
        (4, 120, 8, 0.3, 10, False),
        (5, 30, 1, 1.0, 4, False),
        (6, 200, 12, 0.4, 16, False),
    ],
)
def test_allocation_equals_one_by_one(spark, seed, orders, products, hot, block, strict):
    levels, sales, asked = random_batch(seed, orders, products, hot)
    done = allocate_stock(
        frame(spark, "feed_id bigint, arrival_seq bigint", sales),
        frame(spark, "feed_id bigint, product_id bigint, quantity int", asked),
        stock(spark, levels),
        strict,
        block,
    )
    verdicts, shortages = sequential.allocate(sales, asked, dict(levels), strict)
    assert dict(rows(done.decisions)) == verdicts
    assert len(set(verdicts.values())) == 2
    got = rows(done.shortages.select("feed_id", "product_id", "available", "requested"))
    assert sorted(got) == sorted(shortages)


def test_a_refused_order_leaves_its_stock_to_the_next(spark):
    sales = [(1, 1), (2, 2), (3, 3)]
    asked = [(1, 1, 6), (2, 1, 5), (3, 1, 4)]
    done = allocate_stock(
        frame(spark, "feed_id bigint, arrival_seq bigint", sales),
        frame(spark, "feed_id bigint, product_id bigint, quantity int", asked),
        stock(spark, {1: 10}),
    )
    assert dict(rows(done.decisions)) == {1: True, 2: False, 3: True}
    assert rows(done.shortages) == [(2, 1, "p1", 4, 5)]


def test_two_lines_of_a_product_are_checked_alone_unless_strict(spark):
    args = (
        frame(spark, "feed_id bigint, arrival_seq bigint", [(1, 1)]),
        frame(spark, "feed_id bigint, product_id bigint, quantity int", [(1, 1, 6), (1, 1, 6)]),
        stock(spark, {1: 10}),
    )
    assert rows(allocate_stock(*args).decisions) == [(1, True)]
    assert rows(allocate_stock(*args, strict=True).decisions) == [(1, False)]


def test_plenty_for_everyone(spark):
    done = allocate_stock(
        frame(spark, "feed_id bigint, arrival_seq bigint", [(1, 1), (2, 2)]),
        frame(spark, "feed_id bigint, product_id bigint, quantity int", [(1, 1, 2), (2, 1, 3)]),
        stock(spark, {1: 5}),
    )
    assert sorted(rows(done.decisions)) == [(1, True), (2, True)]
    assert rows(done.shortages) == []


# -- single steps -----------------------------------------------------------------------------


def test_validation_names_the_first_fault(spark):
    sales = feed(
        spark,
        sale(1),
        sale(2),
        sale(3, status=""),
        sale(4, order_date=None),
        sale(5, channel=None),
        sale(6, order_date="ontem"),
        sale(7),
        sale(8),
        sale(9, channel="correio"),
        sale(10, customer=None),
        sale(11),
        sale(12, channel="IFOOD"),
        sale(13),
        sale(14),
        sale(15, status=None, channel=None),
        sale(16),
    )
    faulty = lines(
        spark,
        line(1, 1, 1),
        line(3, 1, 1),
        line(4, 1, 1),
        line(5, 1, 1),
        line(6, 1, 1),
        line(7, 1, 1),
        line(7, 2, 1, 0),
        line(8, 1, 50),
        line(8, 2, None),
        line(9, 1, 1),
        line(10, 1, 1),
        line(11, 1, 1, 1, None, None),
        line(12, 1, 1, 1, None, "2.00"),
        line(13, 1, 1, -2),
        line(14, 1, 0),
        line(15, 1, 1),
        line(16, 1, 1, 2000, "99999999.00"),
    )
    assert dict(rows(intake.intake_validate(sales, faulty, stock(spark, {1: 9})))) == {
        1: None,
        2: "no_items",
        3: "no_status",
        4: "no_date",
        5: "no_channel",
        6: "invalid_date",
        7: "incomplete_item",
        8: "unknown_product",
        9: "invalid_channel",
        10: "no_customer",
        11: "item_without_price",
        12: None,
        13: "incomplete_item",
        14: "incomplete_item",
        15: "no_status",
        16: "total_too_large",
    }


def test_numbers_count_on_past_9999(spark):
    had = table(
        spark,
        "orders",
        [
            dict(id=1, order_number="BAL-2024-9999", customer_id=1, channel="balcao"),
            dict(id=2, order_number="BAL-2023-12345", customer_id=1, channel="balcao"),
            dict(id=3, order_number="IFO-2024-0007", customer_id=1, channel="ifood"),
            dict(id=4, order_number="estranho", customer_id=1, channel="ifood"),
        ],
    )
    sales = feed(
        spark,
        sale(1, 50),
        sale(2, 40),
        sale(3, 10, channel="IFOOD"),
        sale(4, 20, channel="whatsapp"),
        sale(5, 30, channel="ifood"),
    )
    assert dict(rows(intake.intake_order_numbers(sales, had, 2024))) == {
        1: "BAL-2024-10001",
        2: "BAL-2024-10000",
        3: "IFO-2024-0008",
        4: "WAT-2024-0001",
        5: "IFO-2024-0009",
    }
    assert dict(rows(intake.intake_order_numbers(sales, had, 2025)))[2] == "BAL-2025-0001"
    assert ("BAL", 2024, 9999) in rows(intake.order_number_max(had))


def test_customers_are_matched_by_folded_name(spark):
    sales = feed(
        spark,
        sale(1, 9, customer="JOÃO"),
        sale(2, 8, customer="Zé"),
        sale(3, 7, customer="ZE "),
        sale(4, 6, customer="maria"),
        sale(5, 5, customer="Ana"),
    )
    done = intake.intake_resolve_customers(sales, shop.customers(spark))
    assert dict(rows(done.links)) == {1: 1, 2: 6, 3: 6, 4: 4, 5: 5}
    assert sorted(rows(done.new)) == [(5, "Ana"), (6, "ZE ")]


def test_payment_fields(spark):
    sales = feed(
        spark,
        sale(1, payment_method="dinheiro", amount_received=50.0, change_given=1.5),
        sale(2, payment_method="pix", amount_received=50.0, change_given=1.5, whatsapp="9", ifood=""),
        sale(3, payment_method="dinheiro"),
        sale(4, payment_method=""),
    )
    assert sorted(rows(intake.intake_payment_fields(sales))) == [
        (1, None, None, None, "dinheiro", Decimal("50.00"), Decimal("1.50")),
        (2, "9", None, None, "pix", None, None),
        (3, None, None, None, "dinheiro", None, None),
        (4, None, None, None, None, None, None),
    ]


def test_totals_take_either_price(spark):
    some = lines(spark, line(1, 1, 1, 3, "0.10"), line(1, 2, 1, 2, None, "5.00"), line(2, 1, 1, 1, "0.00", "7.00"))
    assert sorted(rows(intake.order_totals(some, "feed_id"))) == [(1, Decimal("10.30")), (2, Decimal("7.00"))]


# -- the whole --------------------------------------------------------------------------------


def random_sales(seed, count, products):
    rng = random.Random(seed)
    names = ["João", "JOAO", "Maria", "Bia", "bía ", "Caio"]
    sales = [
        sale(
            i,
            rng.randint(0, 10**6),
            customer=rng.choice(names),
            channel=rng.choice(["whatsapp", "IFOOD", "balcao", "balcao", "balcao"]),
            payment_method=rng.choice(["dinheiro", "pix"]),
            amount_received=100.0,
        )
        for i in range(1, count + 1)
    ]
    asked = [
        line(i, n, rng.randint(1, products), rng.randint(1, 6), f"{rng.randint(1, 999) / 100:.2f}")
        for i in range(1, count + 1)
        for n in range(1, rng.randint(2, 4))
    ]
    return sales, asked


def test_intake_equals_one_by_one(spark):
    levels = {1: 40, 2: 25, 3: 60, 4: 5}
    sales, asked = random_sales(11, 80, 4)
    before = state(spark, levels)
    done = intake.order_intake(
        feed(spark, *sales, sale(900, 0, status=None)),
        lines(spark, *asked, line(900, 1, 1)),
        before,
        2024,
        "America/Sao_Paulo",
        block_orders=9,
    )
    left = dict(levels)
    taken, created = sequential.intake(
        sales,
        [(f, p, q, price) for f, _, p, q, price, _ in asked],
        left,
        [(1, "João"), (2, "joao"), (3, "JOAO "), (4, "Maria")],
        {"BAL": 12},
        2024,
    )
    assert 0 < len(taken) < len(sales)
    got = done.accepted.collect()
    assert {r["feed_id"]: (r["order_number"], r["customer_id"], r["total_amount"]) for r in got} == taken
    assert {r["order_date"] for r in got} == {at("2024-07-17T13:30")}
    assert {r["channel"] for r in got} == {"whatsapp", "ifood", "balcao"}
    arrival = {s["feed_id"]: s["arrival_seq"] for s in sales}
    by_arrival = sorted(got, key=lambda r: arrival[r["feed_id"]])
    assert [r["id"] for r in by_arrival] == list(range(13, 13 + len(got)))

    refused = dict(rows(done.rejected))
    assert refused.pop(900) == "no_status"
    assert set(refused) == {s["feed_id"] for s in sales} - set(taken) and set(refused.values()) == {"out_of_stock"}

    after = done.state
    assert {r["id"]: r["current_stock"] for r in after["products"].collect()} == left
    assert sorted(rows(after["customers"].where("id > 4").select("id", "name"))) == created
    assert after["orders"].count() == 12 + len(taken)
    items = after["order_items"].where("id > 8").collect()
    assert sorted(r["id"] for r in items) == list(range(9, 9 + len(items)))
    assert len(items) == sum(1 for x in asked if x[0] in taken)
    entries = after["financial_transactions"].where("id > 6").collect()
    assert sum(r["amount"] for r in entries) == sum(t for _, _, t in taken.values())
    one = next(r for r in entries if "IFO" in r["description"])
    assert one["description"].endswith("(IFOOD)") and one["category"] == "venda"
    assert {r["transaction_date"] for r in entries} == {day("2024-07-17")}


def test_nothing_comes_in(spark):
    before = state(spark, {1: 1})
    done = intake.order_intake(feed(spark), lines(spark), before, 2024)
    assert done.accepted.count() == done.rejected.count() == done.shortages.count() == 0
    assert done.state["orders"].count() == 12 and done.state["customers"].count() == 4


CHANGES = (
    "change_id bigint, id bigint, status string, observations string, customer string,"
    " order_date string, payment_method string, amount_received double, change_given double"
)
CHANGED_LINES = "change_id bigint, line_no int, product_id bigint, quantity int, unit_price decimal(10,2)"


def test_revisions(spark):
    before = state(spark, {1: 5, 2: 5})
    before["orders"] = table(
        spark,
        "orders",
        [
            dict(id=i, order_number=n, customer_id=1, total_amount="9.00", status="paid", channel="balcao", order_date=at("2024-01-01T10:00:00"))
            for i, n in ((1, "BAL-2024-1000"), (2, "BAL-2024-10000"), (3, "BAL-2024-0003"))
        ],
    )
    before["order_items"] = table(
        spark,
        "order_items",
        [dict(id=i, order_id=i, product_id=1, quantity=1, unit_price="9.00") for i in (1, 2, 3)],
    )
    changed = frame(
        spark,
        CHANGES,
        [
            (1, 1, "preparing", "a", "Nova", "2024-05-05T08:00", "dinheiro", 20.0, 2.0),
            (2, 1, "archived", None, None, None, "pix", 20.0, 2.0),  # keeps date and customer of 1
            (3, 3, None, None, None, None, None, None, None),
            (4, 2, "paid", None, None, None, None, None, None),  # one line lacks its price
            (5, 50, "paid", None, None, None, None, None, None),
            (6, 3, "paid", None, None, "logo", None, None, None),
            (7, 2, "paid", None, None, None, None, None, None),  # one product is unknown
        ],
    )
    changed_lines = frame(
        spark,
        CHANGED_LINES,
        [
            (1, 1, 1, 9, Decimal("9.00")),
            (2, 1, 1, 2, Decimal("1.50")),
            (2, 2, 2, 1, Decimal("4.00")),
            (4, 1, 1, 1, None),
            (7, 1, 88, 1, Decimal("1.00")),
        ],
    )
    done = revisions.revise_orders(changed, changed_lines, before, "UTC")
    assert {r["change_id"]: r["reject_reason"] for r in done.rejected.collect()} == {
        3: "no_status", 4: "invalid_item", 5: "unknown_order", 6: "invalid_date", 7: "unknown_product"
    }
    one, two, three = done.state["orders"].orderBy("id").collect()
    assert (one["status"], one["observations"], one["total_amount"]) == ("pending", "", Decimal("7.00"))
    assert (one["order_date"], one["payment_method"], one["amount_received"]) == (at("2024-05-05T08:00:00"), "pix", None)
    assert one["customer_id"] == 5
    assert (two["status"], two["total_amount"], three["total_amount"]) == ("paid", Decimal("9.00"), Decimal("9.00"))
    assert rows(done.state["customers"].where("id > 4").select("id", "name")) == [(5, "Nova")]
    items = sorted(rows(done.state["order_items"].select("id", "order_id", "product_id", "quantity")))
    assert items == [(2, 2, 1, 1), (3, 3, 1, 1), (4, 1, 1, 2), (5, 1, 2, 1)]
    entries = {r["id"]: (r["amount"], r["transaction_date"]) for r in done.state["financial_transactions"].collect()}
    # The exact number, not everything beginning with it.
    assert entries[1] == (Decimal("7.00"), day("2024-05-05"))
    assert entries[6] == (Decimal("50.00"), day("2024-03-02")) and len(entries) == 6
    assert {r["id"]: r["current_stock"] for r in done.state["products"].collect()} == {1: 5, 2: 5}


def test_revision_without_lines_empties_the_order(spark):
    before = state(spark, {1: 5})
    changed = frame(spark, CHANGES, [(1, 1, "paid", "x", None, None, None, None, None)])
    done = revisions.revise_orders(changed, frame(spark, CHANGED_LINES, []), before)
    assert done.state["order_items"].where("order_id = 1").count() == 0
    assert rows(done.state["orders"].where("id = 1").select("total_amount")) == [(Decimal("0.00"),)]


def test_void_removes_all_traces(spark):
    before = state(spark, {1: 5})
    before["orders"] = table(
        spark,
        "orders",
        [
            dict(id=1, order_number="BAL-2024-1000", customer_id=1, channel="balcao"),
            dict(id=2, order_number="BAL-2024-10000", customer_id=1, channel="balcao"),
        ],
    )
    left = revisions.void_orders(ids(spark, 1, 70), before)
    assert rows(left["orders"].select("id")) == [(2,)]
    assert left["order_items"].where("order_id = 1").count() == 0 and left["order_items"].count() == 6
    assert sorted(r["id"] for r in left["financial_transactions"].collect()) == [2, 3, 4, 5, 6]
    assert rows(left["products"].select("current_stock")) == [(5,)]


def test_ledger_rows_with_nulls_stay(spark):
    before = state(spark, {1: 5})
    ledger = before["financial_transactions"]
    for name in ("description", "type", "category"):
        odd = ledger.limit(1).withColumn(name, F.lit(None).cast(ledger.schema[name].dataType))
        before["financial_transactions"] = ledger.unionByName(odd)
        count = before["financial_transactions"].count()
        left = revisions.void_orders(frame(spark, "id bigint", []), before)
        assert left["financial_transactions"].count() == count
        done = revisions.revise_orders(frame(spark, CHANGES, []), frame(spark, CHANGED_LINES, []), before)
        assert done.state["financial_transactions"].count() == count


def test_tables_are_not_sorted_to_void_orders(spark):
    before = state(spark, {1: 5})
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = revisions.void_orders(ids(spark, 1, 70), before)
        for name in ("orders", "order_items", "financial_transactions"):
            plan = left[name]._jdf.queryExecution().executedPlan().toString()
            assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def chain(count):
    """Sales that each want a unit of two products, one shared with the sale before: every second is refused."""
    orders = [(i, i) for i in range(count)]
    items = [(i, p, 1) for i in range(count) for p in (i, i + 1)]
    return orders, items, {p: 1 for p in range(count + 1)}


@pytest.mark.parametrize("walk_rows", [200_000, 500])
def test_long_chains_do_not_need_a_round_for_each_link(spark, monkeypatch, walk_rows):
    from tallybook.operators import allocation

    orders, items, stock = chain(400)
    # A second chain, and sales of its own, beside the first.
    orders += [(1000 + i, s + 7) for i, s in orders] + [(5000, 3), (5001, 4)]
    items += [(1000 + f, 2000 + p, q) for f, p, q in items] + [(5000, 9000, 3), (5001, 9000, 3)]
    stock |= {2000 + p: q for p, q in stock.items()} | {9000: 5}
    steps = []
    write = allocation.materialize
    monkeypatch.setattr(allocation, "materialize", lambda df, label="table": steps.append(label) or write(df, label))
    found = allocation.allocate_stock(
        spark.createDataFrame(orders, "feed_id bigint, arrival_seq bigint"),
        spark.createDataFrame(items, "feed_id bigint, product_id bigint, quantity int"),
        spark.createDataFrame([(p, f"p{p}", s) for p, s in stock.items()], "id bigint, name string, current_stock int"),
        walk_rows=walk_rows,
    )
    verdicts, shortages = sequential.allocate(orders, items, dict(stock))
    assert {r.feed_id: r.accepted for r in found.decisions.collect()} == verdicts
    assert {(r.feed_id, r.product_id, r.available, r.requested) for r in found.shortages.collect()} == set(shortages)
    assert steps.count("walk") <= -(-800 // (walk_rows - 2)) + 1
    assert steps.count("round") <= steps.count("walk") + 3


def test_components_of_chains_stars_and_rings(spark):
    import random

    from tallybook.functions.graph import components

    random.seed(6)
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(50)]
    edges += [(2000 + i, 2000 + (i + 1) % 40) for i in range(40)] + [(7, 7), (9999, 9999)]
    shuffled = [(b, a) if random.random() < 0.5 else (a, b) for a, b in edges]
    found = {r.node: r.root for r in components(spark.createDataFrame(shuffled, "a bigint, b bigint")).collect()}
    want = {n: 0 for n in range(301)} | {1000 + i: 1000 for i in range(50)} | {2000 + i: 2000 for i in range(40)}
    assert found == want | {9999: 9999}


@pytest.mark.parametrize("tail_rows", [20_000, 0])
@pytest.mark.parametrize("block_orders", [5, 100_000])
def test_turns_and_shared_products_change_nothing(spark, monkeypatch, block_orders, tail_rows):
    """A batch in four turns, with a product of more lines than a block: each row passes few rounds."""
    import random

    from tallybook.operators import allocation

    rng = random.Random(11)
    orders = [(i, rng.randint(0, 9) * 1000 + i) for i in range(120)]
    items = [(i, p, rng.randint(1, 5)) for i in range(120) for p in {0, rng.randint(1, 25), rng.randint(1, 25)}]
    stock = {p: rng.randint(0, 40) for p in range(26)} | {0: 90}
    monkeypatch.setattr(allocation, "TURN_ROWS", 50)
    monkeypatch.setattr(allocation, "TAIL_ROWS", tail_rows)
    fronts = []
    write = allocation.materialize
    monkeypatch.setattr(allocation, "materialize", lambda df, label="table": fronts.append(label) or write(df, label))
    found = allocation.allocate_stock(
        spark.createDataFrame(orders, "feed_id bigint, arrival_seq bigint"),
        spark.createDataFrame(items, "feed_id bigint, product_id bigint, quantity int"),
        spark.createDataFrame([(p, f"p{p}", s) for p, s in stock.items()], "id bigint, name string, current_stock int"),
        block_orders=block_orders,
    )
    verdicts, shortages = sequential.allocate(orders, items, dict(stock))
    assert {r.feed_id: r.accepted for r in found.decisions.collect()} == verdicts
    assert {(r.feed_id, r.product_id, r.available, r.requested) for r in found.shortages.collect()} == set(shortages)
    assert fronts.count("used") == allocation.TURNS - 1


def exchanges(df):
    """The plan's shuffles, as text, before any is run."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]


def test_a_turn_finds_its_rows_dealt_by_product(spark, monkeypatch):
    from tallybook.operators import allocation

    monkeypatch.setattr(allocation, "TURN_ROWS", 10)
    # As in a large batch, where no side is small enough to be sent to every task.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    levels, sales, asked = random_batch(6, 200, 12, 0.4)
    first = []
    settle = allocation._settle
    def watched(rows, folder, turn, block_orders, walk_rows):
        first.append(exchanges(allocation._bounded(rows, block_orders)))
        settle(rows, folder, turn, block_orders, walk_rows)
    monkeypatch.setattr(allocation, "_settle", watched)
    try:
        done = allocation.allocate_stock(
            frame(spark, "feed_id bigint, arrival_seq bigint", sales),
            frame(spark, "feed_id bigint, product_id bigint, quantity int", asked),
            stock(spark, levels),
        )
        verdicts, shortages = sequential.allocate(sales, asked, dict(levels))
        assert dict(rows(done.decisions)) == verdicts
        got = rows(done.shortages.select("feed_id", "product_id", "available", "requested"))
        assert sorted(got) == sorted(shortages)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # Only what earlier turns used is dealt, never the rows.
    assert len(first) == 4 and not first[0] and all(len(x) <= 1 for x in first)


def test_feeds_are_dealt_by_sale_once(spark, monkeypatch):
    plans = {}
    write = intake.materialize_by
    def watched(df, key, label="table"):
        plans[label] = exchanges(df)
        return write(df, key, label)
    monkeypatch.setattr(intake, "materialize_by", watched)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sales, asked = random_sales(3, 30, 4)
        done = intake.order_intake(feed(spark, *sales), lines(spark, *asked), state(spark, {1: 20, 2: 9, 3: 30, 4: 5}), 2024)
        assert done.accepted.count() + done.rejected.count() == 30
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "heads" in plans and "asked" in plans
    # What is left to deal are the few that are taken and unknown products, not heads and lines.
    assert len(plans["lines"]) <= 1 and not any("feed_id" in x for x in plans["checked"] if "product_id" in x)


def test_missing_products_are_found_among_repeated_ones(spark):
    sales = [sale(1), sale(2), sale(3)]
    asked = [line(1, 1, 1), line(2, 1, 8), line(2, 2, 1), line(3, 1, None)]
    twice = stock(spark, {1: 5}).unionByName(stock(spark, {1: 7}))
    found = dict(rows(intake.intake_validate(feed(spark, *sales), lines(spark, *asked), twice)))
    assert found == {1: None, 2: "unknown_product", 3: "incomplete_item"}
