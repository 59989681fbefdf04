"""Reports and searches on hand-made tables."""

from datetime import date, datetime

import pytest
import shop
from shop import AS_OF, ids, rows, table

from tallybook.functions.clock import month_start_back, period_bounds
from tallybook.functions.text import contains_any, fold, same_text
from tallybook.operators import finance, oil, products, recipes, sales, tasks


def one(df):
    return df.collect()[0].asDict()


def test_period_bounds():
    b = lambda unit, when=AS_OF: tuple(d.date().isoformat() for d in period_bounds(when, unit))
    assert b("day") == ("2024-07-17", "2024-07-18")
    assert b("week") == ("2024-07-15", "2024-07-22")
    assert b("week_sunday") == ("2024-07-14", "2024-07-21")
    assert b("month") == ("2024-07-01", "2024-08-01")
    assert b("year") == ("2024-01-01", "2025-01-01")
    assert b("week", "2024-12-31") == ("2024-12-30", "2025-01-06")
    assert b("week_sunday", "2024-12-29") == ("2024-12-29", "2025-01-05")
    assert b("month", "2024-12-31") == ("2024-12-01", "2025-01-01")
    with pytest.raises(ValueError):
        period_bounds(AS_OF, "decade")


def test_month_start_back_clamps():
    assert month_start_back("2025-08-31", 6) == date(2025, 2, 1)
    assert month_start_back("2025-03-30", 1) == date(2025, 2, 1)
    assert month_start_back("2025-01-15", 13) == date(2023, 12, 1)


def test_text_matching(spark):
    df = shop.frame(spark, "t string", [("Pão",), ("PAO ",), ("100%",), (None,)])
    assert rows(df.select(fold("t"))) == [("pao",), ("pao ",), ("100%",), (None,)]
    assert df.where(same_text("t", "pão")).count() == 2
    assert df.where(contains_any(["t"], "%")).count() == 1
    assert df.where(~contains_any(["t"], "ÃO")).count() == 2


def test_sales_kpis(spark):
    got = one(sales.sales_kpis(shop.orders(spark), shop.products(spark), shop.customers(spark), AS_OF))
    assert got == {
        "today_sales": 30.3,
        "sales_change": 51.5,
        "today_orders": 2,
        "orders_change": 0.0,
        "low_stock_count": 5,
        "new_customers": 2,
    }


def test_sales_kpis_without_yesterday_or_rows(spark):
    o, p, c = shop.orders(spark), shop.products(spark), shop.customers(spark)
    got = one(sales.sales_kpis(o, p, c, "2024-07-14"))
    assert (got["today_sales"], got["sales_change"], got["orders_change"]) == (1.0, 0.0, 0.0)
    got = one(sales.sales_kpis(o.limit(0), p.limit(0), c.limit(0), AS_OF))
    assert list(got.values()) == [0.0, 0.0, 0, 0.0, 0, 0]


def test_top_products_counts_lines_by_name(spark):
    args = (shop.order_items(spark), shop.products(spark), shop.orders(spark), AS_OF)
    assert rows(sales.top_products(*args)) == [("COXINHA", 3), ("Pão de queijo", 2), ("Farinha", 1)]
    assert rows(sales.top_products(*args, n=1)) == [("COXINHA", 3)]


def test_recent_orders(spark):
    o, c, i = shop.orders(spark), shop.customers(spark), shop.order_items(spark)
    page = rows(sales.recent_orders(o, c, i, 1, 4))
    assert [r[0] for r in page] == [11, 12, 7, 2]
    assert page[3] == (2, "BAL-2024-0002", "Maria", 1, 20.2, "preparing", "17/07/2024")
    assert [r[3] for r in page] == [0, 0, 1, 1]
    assert [r[0] for r in rows(sales.recent_orders(o, c, i, 3, 5))] == [6, 10]
    assert rows(sales.recent_orders(o, c, i, 9, 5)) == []
    assert rows(sales.recent_orders_total(o)) == [(12,)]


def test_recent_orders_go_on_after_the_last_one_seen(spark):
    o, c, i = shop.orders(spark), shop.customers(spark), shop.order_items(spark)
    dates = {r["id"]: r["order_date"] for r in o.collect()}
    whole = rows(sales.recent_orders(o, c, i, 1, 12))
    seen, found = None, []
    while page := rows(sales.recent_orders(o, c, i, 1, 5, after=seen)):
        found += page
        seen = (dates[page[-1][0]], page[-1][0])
    assert found == whole


def test_sales_series(spark):
    o = shop.orders(spark)
    # Monday 15th to Sunday 21st, listed Sunday first.
    assert rows(sales.sales_series(o, AS_OF, "week")) == [
        (1, "Sunday", 3.0),
        (2, "Monday", 2.0),
        (3, "Tuesday", 20.0),
        (4, "Wednesday", 30.3),
        (5, "Thursday", 7.0),
        (7, "Saturday", 4.0),
    ]
    assert rows(sales.sales_series(o, AS_OF, "month"))[0] == (14, 1.0)
    assert rows(sales.sales_series(o, AS_OF, "anything")) == [("June", 11.0), ("July", 67.3)]


def test_sales_totals_week_starts_on_sunday(spark):
    got = one(sales.sales_totals(shop.orders(spark), AS_OF))
    assert got == {"today": 30.3, "week": 64.3, "month": 67.3, "pending": 2}
    assert list(one(sales.sales_totals(shop.orders(spark).limit(0), AS_OF)).values()) == [0, 0, 0, 0]


def test_sales_documents(spark):
    found = sales.sales_documents(
        shop.orders(spark), shop.customers(spark), shop.order_items(spark), shop.products(spark)
    ).collect()
    assert [r["id"] for r in found][:3] == [11, 12, 7]
    by_id = {r["id"]: r for r in found}
    assert len(found) == 12 and by_id[11]["items"] == []
    assert [tuple(i) for i in by_id[1]["items"]] == [
        ("Coxinha", 1, shop.Decimal("3.00")),
        ("Pão de queijo", 2, shop.Decimal("5.05")),
    ]
    assert [i["product"] for i in by_id[3]["items"]] == ["Coxinha"]  # the other product is gone
    assert by_id[2]["order_date"] == "2024-07-17T23:59:59.000Z"


def test_sale_details(spark):
    found = sales.sale_details(
        shop.orders(spark),
        shop.customers(spark),
        shop.order_items(spark),
        shop.products(spark),
        ids(spark, 2, 11, 500),
    ).collect()
    assert sorted(r["id"] for r in found) == [2, 11]
    two = next(r for r in found if r["id"] == 2)
    assert (two["customer"], two["customer_name"], two["part"]) == (4, "Maria", 0)
    assert [i.asDict() for i in two["items"]] == [
        {"product": 7, "product_name": "COXINHA", "quantity": 50, "valor": shop.Decimal("1.00")}
    ]


def test_oversized_sale_comes_in_parts(spark):
    items = table(
        spark,
        "order_items",
        [dict(id=i, order_id=1, product_id=1, quantity=1, unit_price="1.00") for i in range(40)],
    )
    found = sales.sales_documents(
        shop.orders(spark), shop.customers(spark), items, shop.products(spark), part_rows=8
    ).collect()
    parts = [len(r["items"]) for r in found if r["id"] == 1]
    assert len(parts) > 1 and sum(parts) == 40
    assert len(found) == 11 + len(parts)


def test_stock_levels(spark):
    p = shop.products(spark)
    labels = dict((r["id"], r["stock_status"]) for r in products.product_search(p, limit=50).collect())
    assert labels == {
        1: "normal", 2: "low", 3: "out", 4: "normal", 5: "out", 6: "low", 7: "low", 8: "low"
    }
    level = lambda s: sorted(r["id"] for r in products.product_search(p, stock=s, limit=50).collect())
    assert (level("low"), level("out"), level("normal")) == ([2, 7], [3, 5], [1, 4, 5])
    assert one(products.stock_counts(p)) == {"total": 8, "low": 2, "out": 2}
    assert one(products.stock_counts(p.limit(0))) == {"total": 0, "low": 0, "out": 0}
    # No ratio first, then by ratio.
    assert [r["id"] for r in products.low_stock(p).collect()] == [8, 6, 3, 7, 2]


def test_product_search(spark):
    p = shop.products(spark)
    find = lambda **k: [r["id"] for r in products.product_search(p, limit=50, **k).collect()]
    assert find(search="PAO") == [2, 1]  # by name: Coxinha, Pão de queijo
    assert find(search="%") == [4]
    assert find(category="salgados") == [2, 7, 1]
    assert find(category="Salgados", stock="low", search="grande") == [7]
    assert one(products.product_search_total(p, search="PAO")) == {"total": 2}
    assert [r["id"] for r in products.product_search(p, page=2, limit=3).collect()] == [3, 4, 1]
    assert rows(products.product_search(p, page=9)) == []
    assert [r["id"] for r in products.ingredient_picker(p).collect()] == [3, 4]
    assert rows(products.product_lookup(p, ids(spark, 1, 1, 77)).select("id")) == [(1,)]
    assert [c for (c,) in rows(products.product_categories(p))] == [
        "Bebidas", "Ingredientes", "Outros", "Salgados"
    ]


def test_recipe_list(spark):
    r, i, p = shop.recipes(spark), shop.recipe_ingredients(spark), shop.products(spark)
    # Stock 0 counts as missing (twice if listed twice), -1 does not, unknown products count as used.
    assert [(x[0], x[5], x[6]) for x in rows(recipes.recipe_list(r, i, p))] == [
        (3, 0, 0),
        (1, 3, 2),
        (2, 3, 1),
    ]
    assert [x[0] for x in rows(recipes.recipe_list(r, i, p, search="LIMAO"))] == [2]
    assert [x[0] for x in rows(recipes.recipe_list(r, i, p, category="doces"))] == [1]
    assert rows(recipes.recipe_list(r, i, p, page=2)) == []
    assert one(recipes.recipe_list_total(r, search="misture")) == {"total": 1}
    assert rows(recipes.recipe_categories(r)) == [("Bebidas",), ("Doces",), ("Salgados",)]


def test_recipe_counts(spark):
    frames = shop.recipes(spark), shop.recipe_log(spark), shop.recipe_ingredients(spark), shop.products(spark)
    assert one(recipes.recipe_counts(*frames, AS_OF)) == {"total": 3, "popular": 1, "missing": 2}
    empty = [f.limit(0) for f in frames]
    assert one(recipes.recipe_counts(*empty, AS_OF)) == {"total": 0, "popular": 0, "missing": 0}


def test_recipe_details(spark):
    r, i, p = shop.recipes(spark), shop.recipe_ingredients(spark), shop.products(spark)
    found = {x["id"]: x for x in recipes.recipe_details(r, i, p).collect()}
    assert [(g["id"], g["name"], g["missing"]) for g in found[1]["ingredients"]] == [
        (1, "Farinha", 1), (2, "Farinha", 1), (3, "Refrigerante", 0)
    ]
    assert [g["id"] for g in found[2]["ingredients"]] == [4, 5]
    assert found[3]["ingredients"] == []
    assert [x["id"] for x in recipes.recipe_details(r, i, p, ids(spark, 3, 8)).collect()] == [3]


def test_tasks(spark):
    t, c = shop.tasks(spark), shop.task_categories(spark)
    soon = tasks.tasks_upcoming(t, c, "2024-07-15T08:00:00", "2024-07-17T12:00:00").collect()
    assert [(x["id"], x["category_name"]) for x in soon] == [(4, None), (2, "Limpeza"), (1, "Compras")]
    assert soon[1]["due_date"] == "2024-07-17T11:59:59.000Z"
    find = lambda **k: [x["id"] for x in tasks.tasks_search(t, c, AS_OF, **k).collect()]
    assert find() == [4, 3, 2, 1, 5]
    assert find(sort="due_date_desc") == [5, 1, 2, 3, 4]
    assert find(sort="priority_asc") == [4, 1, 5, 2, 3]  # an unknown priority comes first
    assert find(sort="priority_desc") == [4, 3, 2, 1, 5]
    assert find(filter="overdue") == [4, 2]  # due exactly now is not overdue
    assert find(filter="completed") == [3]
    assert find(filter="all", search="pão") == [1, 5]
    assert find(search="%") == [2]
    assert find(page=2, limit=2) == [2, 1] and find(page=7) == []
    assert one(tasks.tasks_search_total(t, AS_OF, "pao")) == {"total": 2}
    assert one(tasks.tasks_summary(t, AS_OF)) == {
        "total": 5, "completed": 1, "pending": 4, "overdue": 2
    }
    assert list(one(tasks.tasks_summary(t.limit(0), AS_OF)).values()) == [0, 0, 0, 0]


def test_finance(spark):
    f, o = shop.ledger(spark), shop.orders(spark)
    assert one(finance.finance_summary(f, o)) == {
        "total_income": 157.1, "total_expenses": 50.0, "balance": 107.1, "total_revenue": 178.3
    }
    got = one(finance.finance_summary(f, o, start="2024-02-01", end="2024-02-29"))
    assert got == {"total_income": 0, "total_expenses": 50.0, "balance": -50.0, "total_revenue": 0}
    assert one(finance.finance_summary(f, o, end="2024-06-16"))["total_revenue"] == 106.0
    assert rows(finance.cashflow_by_month(f, "2024-03-30", 1)) == [("2024-02", 0.0, 50.0), ("2024-03", 57.0, 0.0)]
    # Declared order, and nothing for a category whose sums are zero.
    assert rows(finance.category_distribution(f)) == [
        ("venda", 0.0, 150.1), ("despesa", 40.0, 0.0), ("impostos", 10.0, 0.0), ("outros", 0.0, 7.0)
    ]


def test_transactions(spark):
    f = shop.ledger(spark)
    find = lambda **k: [r[0] for r in rows(finance.transactions_search(f, **k))]
    assert find() == [6, 5, 3, 4, 2, 1]
    assert find(order="data-asc") == [1, 2, 4, 3, 5, 6]
    assert find(order="valor-desc") == [1, 6, 2, 3, 5, 4]
    assert find(order="valor-asc", type="saida") == [4, 3, 2]
    assert find(start="2024-02-15") == [6, 5, 3, 4] and find(end="2024-02-01") == [2, 1]
    assert find(start="2024-02-01", end="2024-02-29", category="impostos") == [3]
    assert rows(finance.transaction_lookup(f, ids(spark, 3, 30))) == [
        (3, "x", 10.0, "saida", "impostos", "2024-02-29")
    ]


def test_oil(spark):
    d = shop.oil_disposals(spark)
    assert rows(oil.oil_impact(d, AS_OF)) == [(5.0, 7.5, 125000.0)]
    assert rows(oil.oil_impact(d, AS_OF, same_year=True)) == [(3.5, 5.25, 87500.0)]
    assert rows(oil.oil_impact(d, "2024-01-01")) == [(0.0, 0.0, 0.0)]
    assert [r[0] for r in rows(oil.recent_disposals(d, 3))] == [4, 1, 3]


def test_as_of_accepts_text_dates_and_datetimes(spark):
    o = shop.orders(spark)
    want = rows(sales.sales_totals(o, "2024-07-17 12:00:00"))
    assert rows(sales.sales_totals(o, date(2024, 7, 17))) == want
    assert rows(sales.sales_totals(o, datetime(2024, 7, 17, 23))) == want
