"""Tables by month, daily parts, kept names, JSON values and pages with totals."""

import uuid
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
import shop
from shop import frame, rows

from tallybook.functions.rows import page_and_total, paginate
from tallybook.operators import finance, products, recipes, sales, tasks
from tallybook.operators.customer_names import keep_names, keep_new_names, resolve_kept_names
from tallybook.operators.daily_parts import (
    add_lines,
    add_preparations,
    recipe_counts_from_days,
    top_products_from_days,
)
from tallybook.operators.intake import intake_resolve_customers
from tallybook.sources import tables
from tallybook.sources.monthly import read_by_month, write_by_month, write_lines_by_month

AS_OF = "2024-03-15 12:00:00"

ORDERS = "id bigint, customer_id bigint, order_date timestamp_ntz, total_amount decimal(10,2), status string"
LEDGER = (
    "id bigint, description string, amount decimal(10,2), type string, category string, transaction_date date"
)


def _orders(spark):
    days = ["2024-03-15", "2024-03-14", "2024-03-01", "2024-02-29", "2024-02-20", "2023-03-15", "2022-01-31"]
    found = [
        (i, i % 2, datetime.fromisoformat(day + " 10:00:00"), Decimal(i * 10), "pending" if i % 3 == 0 else "paid")
        for i, day in enumerate(days, start=1)
    ]
    found += [(90, 1, None, Decimal(5), "pending"), (91, 1, None, Decimal(5), None)]
    found += [(92, 0, datetime(2022, 1, 31), Decimal(7), None)]
    return frame(spark, ORDERS, found)


def _by_month(spark, table, df, folder):
    write_by_month(df, table, f"{folder}/{table}")
    return read_by_month(spark, table, f"{folder}/{table}", df.schema)


def _partition_filters(df):
    """Texts of the partition filters of the file scans."""
    plan = df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    return [line for line in plan.splitlines() if line.startswith("PartitionFilters:")]


def _sales_reports(orders):
    return {
        "weekday": sales.sales_by_weekday(orders, AS_OF),
        "month": sales.sales_by_month_day(orders, AS_OF),
        "year": sales.sales_by_year_month(orders, AS_OF),
        "totals": sales.sales_totals(orders, AS_OF),
    }


def test_reports_of_orders_by_month_read_their_months(spark, folder):
    plain = _orders(spark)
    laid = _by_month(spark, "orders", plain, folder)
    assert sorted(rows(laid.select(*plain.columns)), key=repr) == sorted(rows(plain), key=repr)
    for name, found in _sales_reports(laid).items():
        assert rows(found) == rows(_sales_reports(plain)[name]), name
        assert any("order_month" in text for text in _partition_filters(found)), name
    totals = _partition_filters(_sales_reports(laid)["totals"])
    assert any("is_open" in text for text in totals)
    goods, people = shop.products(spark), shop.customers(spark)
    kpis = sales.sales_kpis(laid, goods, people, AS_OF)
    assert rows(kpis) == rows(sales.sales_kpis(plain, goods, people, AS_OF))
    assert any("order_month" in text for text in _partition_filters(kpis))


def test_lines_by_month_are_read_for_the_window(spark, folder):
    orders = _orders(spark)
    items = frame(
        spark,
        "order_id bigint, product_id bigint, quantity int",
        [(o, p, 1) for o in (1, 2, 3, 6, 7, 90, 404) for p in range(1, o % 4 + 2)],
    )
    write_lines_by_month(items, orders, f"{folder}/lines")
    laid = read_by_month(spark, "order_items", f"{folder}/lines", items.schema)
    assert sorted(rows(laid.select(*items.columns))) == sorted(rows(items))
    found = sales.top_products(laid, shop.products(spark), _by_month(spark, "orders", orders, folder), AS_OF)
    assert rows(found) == rows(sales.top_products(items, shop.products(spark), orders, AS_OF))
    pruned = [text for text in _partition_filters(found) if "order_month" in text]
    assert len(pruned) >= 2 and all(">= 2024-02-01" in text for text in pruned if "dynamicpruning#" not in text)


def test_reports_of_a_ledger_by_month_read_their_months(spark, folder):
    day = datetime(2023, 12, 31).date()
    plain = frame(
        spark,
        LEDGER,
        [
            (i, f"t{i}", Decimal(i), "entrada" if i % 2 else "saida", "venda", day + timedelta(days=20 * i))
            for i in range(1, 12)
        ]
        + [(50, "undated", Decimal(1), "saida", "outros", None)],
    )
    laid, orders = _by_month(spark, "financial_transactions", plain, folder), _orders(spark)
    span = ("2024-02-01", "2024-05-20")
    reports = [
        lambda t: finance.finance_summary(t, orders, *span),
        lambda t: finance.cashflow_by_month(t, "2024-06-10", 2),
        lambda t: finance.category_distribution(t, *span),
        lambda t: finance.transactions_search(t, start=span[0]),
        lambda t: finance.transactions_search(t, end=span[1]),
    ]
    for report in reports:
        assert rows(report(laid)) == rows(report(plain))
        assert any("transaction_month" in text for text in _partition_filters(report(laid)))
    whole = finance.finance_summary(laid, orders)
    assert rows(whole) == rows(finance.finance_summary(plain, orders))


def test_empty_and_appended_months(spark, folder):
    plain = _orders(spark)
    empty = _by_month(spark, "orders", plain.where("false"), folder)
    assert rows(empty) == []
    write_by_month(plain.where("id <= 3"), "orders", f"{folder}/orders")
    write_by_month(plain.where("id > 3"), "orders", f"{folder}/orders")
    again = read_by_month(spark, "orders", f"{folder}/orders", plain.schema)
    assert again.count() == plain.count()
    assert rows(sales.sales_totals(again, AS_OF)) == rows(sales.sales_totals(plain, AS_OF))


LOG = "recipe_id bigint, action string, created_at timestamp_ntz"


def test_counts_from_days_equal_those_of_the_log(spark, folder):
    start = datetime(2024, 1, 1)
    ids = [1, 2, 3, 4, 32768, 32769, 65536, 1 << 40, 0, 777]  # 777: no such recipe
    logged = [(ids[i % len(ids)], "prepared", start + timedelta(hours=7 * i)) for i in range(120)]
    logged += [(5, "viewed", start), (None, "prepared", start), (6, "prepared", None)]
    log = frame(spark, LOG, logged)
    kept = frame(spark, "id bigint, name string", [(i, "r") for i in (*ids[:-1], 5, 6)])
    goods = frame(spark, "id bigint, current_stock int", [(1, 0), (2, 3)])
    used = frame(
        spark,
        "recipe_id bigint, product_id bigint",
        [(1, 1), (1, 1), (65536, 1), (777, 1), (2, 2), (None, 1)],
    )
    for third in range(3):
        add_preparations(log.where(f"coalesce(recipe_id, 0) % 3 = {third}"), folder)
    add_preparations(log.where("recipe_id = 3"), folder)  # sent again
    for as_of in ("2024-02-01 12:00:00", "2024-02-20 07:00:00", "2024-03-06 03:00:00", "2025-01-01 00:00:00"):
        want = rows(recipes.recipe_counts(kept, log, used, goods, as_of))
        found = recipe_counts_from_days(kept, used, goods, folder, as_of)
        assert rows(found) == want, as_of
        assert len({text for text in _partition_filters(found) if "month#" in text}) == 2
    nobody = kept.where("false")
    assert rows(recipe_counts_from_days(nobody, used, goods, folder, "2024-02-01")) == [(0, 0, 0)]


def test_best_sellers_from_days(spark, folder):
    orders = _orders(spark)
    items = frame(
        spark, "order_id bigint, product_id bigint", [(o, p) for o in (1, 2, 4, 5, 6, 90) for p in range(1, o + 1)]
    )
    for part in ("order_id < 4", "order_id >= 4"):
        add_lines(items.where(part), orders, folder)
    for as_of in (AS_OF, "2024-04-01 00:00:00", "2023-03-20"):
        want = rows(sales.top_products(items, shop.products(spark), orders, as_of))
        assert rows(top_products_from_days(shop.products(spark), folder, as_of)) == want


FEED = "feed_id bigint, arrival_seq bigint, customer string"


@pytest.fixture
def no_broadcast(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, before)


def test_kept_names_give_what_one_batch_gives(spark, folder, no_broadcast):
    people = frame(
        spark, "id bigint, name string", [(1, "Ana"), (2, "José "), (3, "jose"), (7, "Rui"), (8, None)]
    )
    names = ["ana", "Zé", "JOSE", None, "ze ", "Eva", "EVA", "Rui", "Bia", "zé", "", "bia"]
    feed = frame(spark, FEED, [(100 + i, i, name) for i, name in enumerate(names)])
    whole = intake_resolve_customers(feed, people)
    table, path = f"kept_{uuid.uuid4().hex}", f"{folder}/names"
    keep_names(people, table, path, buckets=4)
    following, links, new = 9, [], []
    for batch in (feed.where("arrival_seq < 4"), feed.where("arrival_seq between 4 and 7"), feed.where("arrival_seq > 7")):
        first = resolve_kept_names(batch, table, following, buckets=4)
        found = resolve_kept_names(batch, table, following, buckets=4)  # taken in again
        assert sorted(rows(first.links)) == sorted(rows(found.links))
        assert sorted(rows(first.new)) == sorted(rows(found.new))
        keep_new_names(found.new, table, path, buckets=4)
        assert rows(resolve_kept_names(batch, table, 999, buckets=4).new) == []
        links, new = links + rows(found.links), new + rows(found.new)
        following += found.new.count()
    assert sorted(links) == sorted(rows(whole.links))
    assert sorted(new) == sorted(rows(whole.new))


def test_kept_names_are_read_without_a_shuffle(spark, folder, no_broadcast):
    table, path = f"kept_{uuid.uuid4().hex}", f"{folder}/names"
    people = spark.range(1000).selectExpr("id", "concat('n', id) AS name")
    keep_names(people, table, path, buckets=8)
    batch = spark.range(5).selectExpr("concat('n', id) AS _name").repartition(8, "_name")
    joined = batch.join(spark.read.table(table), "_name", "left")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan


def test_json_documents_round_trip(spark, folder):
    documents = frame(
        spark,
        "id bigint, note string, items array<struct<product:string,quantity:int,valor:decimal(10,2)>>",
        [(1, None, [("pão \"x\"", 2, Decimal("3.00")), (None, None, None)]), (2, "a\nb", []), (3, "", None)],
    )
    tables.write_json_documents(documents, f"{folder}/json")
    got = tables.read_json_documents(spark, f"{folder}/json", documents.schema)
    assert sorted(rows(got), key=repr) == sorted(rows(documents), key=repr)
    odd = frame(spark, "id bigint, json string", [(1, '{"a":{"b":[1,"x"]}}'), (2, "{"), (3, None), (4, "{}")])
    picked = tables.json_values(odd, {"first": ("$.a.b[0]", "int"), "second": ("$.a.b[1]", "int")})
    assert sorted(rows(picked.select("id", "first", "second"))) == [(1, 1, None), (2, None, None), (3, None, None), (4, None, None)]
    with open(f"{folder}/json/broken.json", "w") as out:
        out.write('{"id": "many"')
    with pytest.raises(Exception, match="MALFORMED_RECORD|FAILED_READ_FILE"):
        tables.read_json_documents(spark, f"{folder}/json", documents.schema).collect()


@pytest.mark.parametrize("page, limit", [(1, 3), (2, 3), (9, 3), (1, 2000)])
def test_pages_carry_their_totals(spark, page, limit):
    goods = shop.products(spark)
    found = products.product_search_page(goods, None, "normal", None, page, limit)
    assert rows(found.rows) == rows(products.product_search(goods, None, "normal", None, page, limit))
    assert found.total == rows(products.product_search_total(goods, None, "normal", None))[0][0]
    todo, labels = shop.tasks(spark), shop.task_categories(spark)
    listed = tasks.tasks_search_page(todo, labels, AS_OF, sort="priority_asc", page=page, limit=limit)
    assert rows(listed.rows) == rows(tasks.tasks_search(todo, labels, AS_OF, sort="priority_asc", page=page, limit=limit))
    assert listed.total == todo.count()


def test_a_near_page_and_its_total_are_one_job(spark, folder):
    spark.range(5000).selectExpr("id", "id % 7 AS k").repartition(6).write.parquet(f"{folder}/t")
    df = spark.read.parquet(f"{folder}/t").where("k < 3")
    order = [df["k"].desc(), df["id"].asc()]
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "page")
    found = page_and_total(df, order, 2, 10)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) == 1
    assert rows(found.rows) == rows(paginate(df, order, 2, 10))
    assert found.total == df.count()
    deep = page_and_total(df, order, 30, 50)
    assert rows(deep.rows) == rows(paginate(df, order, 30, 50)) and deep.total == df.count()
    assert page_and_total(df.where("id < 0"), order, 1, 5).total == 0
