"""Hand-made tables holding the awkward cases, and small helpers to build frames."""

from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession

from tallybook.schemas import SCHEMAS

AS_OF = datetime(2024, 7, 17, 12, 0)  # a Wednesday


def at(text: str) -> datetime:
    return datetime.fromisoformat(text)


def day(text: str) -> date:
    return date.fromisoformat(text)


def table(spark: SparkSession, name: str, rows: list[dict]) -> DataFrame:
    """Rows of a declared table; columns not named are NULL."""
    schema = SCHEMAS[name]
    loose = type(schema)([type(f)(f.name, f.dataType, True) for f in schema])
    data = []
    for row in rows:
        unknown = set(row) - set(schema.names)
        assert not unknown, unknown
        data.append(
            tuple(
                Decimal(str(row[f.name]))
                if f.dataType.typeName() == "decimal" and row.get(f.name) is not None
                else row.get(f.name)
                for f in schema
            )
        )
    return spark.createDataFrame(data, loose)


def frame(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def ids(spark: SparkSession, *values: int) -> DataFrame:
    return frame(spark, "id bigint", [(v,) for v in values])


def rows(df: DataFrame) -> list[tuple]:
    return [tuple(r) for r in df.collect()]


def products(spark):
    p = lambda i, name, cat, desc, cur, low: dict(
        id=i, name=name, category=cat, description=desc, current_stock=cur, minimum_stock=low, unit="un"
    )
    return table(
        spark,
        "products",
        [
            p(1, "Pão de queijo", "Salgados", None, 10, 5),
            p(2, "Coxinha", "Salgados", "massa de pao", 4, 5),
            p(3, "Farinha", "Ingredientes", None, 0, 5),
            p(4, "Ovo", "ingredientes ", "100% caipira", 5, 5),
            p(5, "Brinde", "Outros", None, 0, 0),
            p(6, "Refrigerante", "Bebidas", None, -1, 3),
            p(7, "COXINHA", "Salgados", "grande", 1, 8),
            p(8, "Perda", "Outros", None, -2, 0),
        ],
    )


def customers(spark):
    c = lambda i, name, created: dict(id=i, name=name, created_at=at(created))
    return table(
        spark,
        "customers",
        [
            c(1, "João", "2024-07-01T00:00:00"),
            c(2, "joao", "2024-06-30T23:59:59"),
            c(3, "JOAO ", "2023-07-10T10:00:00"),
            c(4, "Maria", "2024-07-31T23:59:59"),
        ],
    )


def orders(spark):
    o = lambda i, when, amount, status="paid", customer=1, number=None, channel="balcao": dict(
        id=i,
        order_number=number or f"BAL-2024-{i:04d}",
        customer_id=customer,
        total_amount=amount,
        status=status,
        channel=channel,
        order_date=at(when),
    )
    return table(
        spark,
        "orders",
        [
            o(1, "2024-07-17T00:00:00", "10.10", "pending"),
            o(2, "2024-07-17T23:59:59", "20.20", "preparing", 4),
            o(3, "2024-07-16T00:00:00", "12.00"),
            o(4, "2024-07-16T23:59:59", "8.00"),
            o(5, "2024-06-17T00:00:00", "5.00"),  # 30 days before
            o(6, "2024-06-16T23:59:59", "6.00"),  # 31 days before
            o(7, "2024-07-18T09:00:00", "7.00"),  # after
            o(8, "2024-07-14T12:00:00", "1.00"),  # Sunday
            o(9, "2024-07-15T00:00:00", "2.00"),  # Monday
            o(10, "2023-07-17T10:00:00", "100.00"),  # another year
            o(11, "2024-07-21T10:00:00", "3.00"),  # Sunday after
            o(12, "2024-07-20T10:00:00", "4.00"),  # Saturday
        ],
    )


def order_items(spark):
    i = lambda n, order, product, quantity, price: dict(
        id=n, order_id=order, product_id=product, quantity=quantity, unit_price=price
    )
    return table(
        spark,
        "order_items",
        [
            i(1, 1, 1, 2, "5.05"),
            i(2, 1, 2, 1, "3.00"),
            i(3, 2, 7, 50, "1.00"),
            i(4, 5, 1, 1, "5.00"),
            i(5, 6, 3, 1, "5.00"),  # too long ago to be a best-seller
            i(6, 7, 3, 1, "7.00"),
            i(7, 3, 99, 1, "7.00"),  # product is gone
            i(8, 3, 2, 1, "7.00"),
        ],
    )


def recipes(spark):
    r = lambda i, name, cat, text, notes=None: dict(
        id=i, name=name, category=cat, prep_time=10, instructions=text, notes=notes
    )
    return table(
        spark,
        "recipes",
        [
            r(1, "Bolo", "Doces", "misture tudo"),
            r(2, "Coxinha", "Salgados", "frite", "com limão"),
            r(3, "Água", "Bebidas", "sirva"),
        ],
    )


def recipe_ingredients(spark):
    g = lambda i, recipe, product: dict(
        id=i, recipe_id=recipe, product_id=product, quantity="1.50", unit="kg"
    )
    return table(
        spark,
        "recipe_ingredients",
        [g(1, 1, 3), g(2, 1, 3), g(3, 1, 6), g(4, 2, 1), g(5, 2, 5), g(6, 2, 99)],
    )


def recipe_log(spark):
    a = lambda i, recipe, action, when: dict(id=i, recipe_id=recipe, action=action, created_at=at(when))
    return table(
        spark,
        "recipe_log",
        [
            a(1, 1, "prepared", "2024-06-17T12:00:00"),  # 30 days before, to the second
            a(2, 1, "prepared", "2024-07-01T12:00:00"),
            a(3, 2, "prepared", "2024-06-17T11:59:59"),
            a(4, 3, "viewed", "2024-07-16T00:00:00"),
            a(5, 77, "prepared", "2024-07-16T00:00:00"),  # recipe is gone
        ],
    )


def task_categories(spark):
    return table(
        spark,
        "task_categories",
        [dict(id=1, name="Compras", color="#fff"), dict(id=2, name="Limpeza", color="#000")],
    )


def tasks(spark):
    t = lambda i, title, due, priority="low", status="pending", category=None, text=None: dict(
        id=i, title=title, description=text, due_date=at(due), priority=priority, status=status, category_id=category
    )
    return table(
        spark,
        "tasks",
        [
            t(1, "Comprar pão", "2024-07-17T12:00:00", "high", category=1),  # due exactly now
            t(2, "Lavar", "2024-07-17T11:59:59", "medium", "in_progress", 2, "100% limpo"),
            t(3, "Pagar", "2024-07-16T08:00:00", "low", "completed", 1),
            t(4, "Ligar", "2024-07-15T08:00:00", "urgent", category=9),
            t(5, "Vender PAO", "2024-07-20T08:00:00", "high", text="feira"),
        ],
    )


def ledger(spark):
    f = lambda i, amount, kind, cat, when, text="x": dict(
        id=i, description=text, amount=amount, type=kind, category=cat, transaction_date=day(when)
    )
    return table(
        spark,
        "financial_transactions",
        [
            f(1, "100.10", "entrada", "venda", "2024-01-31", "Venda BAL-2024-1000 (balcao)"),
            f(2, "40.00", "saida", "despesa", "2024-02-01"),
            f(3, "10.00", "saida", "impostos", "2024-02-29"),
            f(4, "0.00", "saida", "investimento", "2024-02-15"),
            f(5, "7.00", "entrada", "outros", "2024-03-01"),
            f(6, "50.00", "entrada", "venda", "2024-03-02", "Venda BAL-2024-10000 (balcao)"),
        ],
    )


def oil_disposals(spark):
    d = lambda i, amount, when: dict(id=i, product="óleo", amount=amount, disposal_date=day(when))
    return table(
        spark,
        "oil_disposals",
        [d(1, "2.50", "2024-07-01"), d(2, "1.50", "2023-07-31"), d(3, "9.00", "2024-06-30"), d(4, "1.00", "2024-07-01")],
    )
