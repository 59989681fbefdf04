"""Stock reports and product searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallybook.functions.rows import Page, page_and_total, paginate, where_all
from tallybook.functions.text import contains_any, distinct_text, fold_key, same_text

# The category recipes draw their ingredients from.
INGREDIENT_CATEGORY = "Ingredientes"


def stock_label() -> Column:
    """'out' at zero, 'low' below the minimum (negative stock too), else 'normal'."""
    stock = F.col("current_stock")
    return (
        F.when(stock == 0, "out").when(stock < F.col("minimum_stock"), "low").otherwise("normal")
    )


def stock_filter(level: str | None) -> list[Column]:
    """The search filter of a level, which is not the label.

    Negative stock is labelled low but is in no filter but none; 0 of 0 is labelled out but
    also passes 'normal'. An unknown level filters nothing.
    """
    stock, minimum = F.col("current_stock"), F.col("minimum_stock")
    levels = {
        "low": [stock < minimum, stock > 0],
        "out": [stock == 0],
        "normal": [stock >= minimum],
    }
    return levels.get(level or "", [])


def low_stock(products: DataFrame, n: int = 5) -> DataFrame:
    """Products below their minimum, the emptiest (stock over minimum) first.

    A minimum of 0 has no ratio; such products come first.
    """
    ratio = F.try_divide(F.col("current_stock"), F.col("minimum_stock"))
    return (
        products.where(F.col("current_stock") < F.col("minimum_stock"))
        .select("id", "name", "category", "current_stock", "minimum_stock", "unit")
        .orderBy(ratio.asc_nulls_first(), F.asc("id"))
        .limit(n)
    )


def ingredient_picker(products: DataFrame, category: str = INGREDIENT_CATEGORY) -> DataFrame:
    return (
        products.where(same_text("category", category))
        .select("id", "name", "category", "unit")
        .orderBy(fold_key("name"), "id")
    )


def _by_name() -> list[Column]:
    return [fold_key("name").asc(), F.asc("id")]


def _matching(
    products: DataFrame, category: str | None, stock: str | None, search: str | None
) -> DataFrame:
    conditions = stock_filter(stock)
    if category:
        conditions.append(same_text("category", category))
    if search:
        conditions.append(contains_any(["name", "description"], search))
    return where_all(products, conditions)


def product_search(
    products: DataFrame,
    category: str | None = None,
    stock: str | None = None,
    search: str | None = None,
    page: int = 1,
    limit: int = 10,
) -> DataFrame:
    """One page of the matching products by name, each with its stock label."""
    found = _matching(products, category, stock, search).withColumn("stock_status", stock_label())
    return paginate(found, _by_name(), page, limit)


def product_search_page(
    products: DataFrame,
    category: str | None = None,
    stock: str | None = None,
    search: str | None = None,
    page: int = 1,
    limit: int = 10,
) -> Page:
    """``product_search`` and ``product_search_total`` of the same filters, from one scan."""
    found = _matching(products, category, stock, search).withColumn("stock_status", stock_label())
    return page_and_total(found, _by_name(), page, limit)


def product_search_total(
    products: DataFrame,
    category: str | None = None,
    stock: str | None = None,
    search: str | None = None,
) -> DataFrame:
    return _matching(products, category, stock, search).agg(F.count(F.lit(1)).alias("total"))


def stock_counts(products: DataFrame) -> DataFrame:
    """All products, those low and those out, whatever is being searched for."""
    stock = F.col("current_stock")
    return products.agg(
        F.count(F.lit(1)).alias("total"),
        F.count(F.when((stock < F.col("minimum_stock")) & (stock > 0), 1)).alias("low"),
        F.count(F.when(stock == 0, 1)).alias("out"),
    )


def product_categories(products: DataFrame) -> DataFrame:
    return distinct_text(products, "category")


def product_lookup(products: DataFrame, ids: DataFrame) -> DataFrame:
    """The products named in ``ids`` (one ``id`` column); unknown ids are absent."""
    return products.join(ids.select("id"), "id", "left_semi")
