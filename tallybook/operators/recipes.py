"""Recipe lists, counts and documents."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, functions as F

from tallybook.functions.clock import Moment, as_datetime, ts_lit
from tallybook.functions.rows import Page, nest, page_and_total, paginate, small_page, where_all
from tallybook.functions.text import contains_any, distinct_text, fold_key, same_text

POPULAR_DAYS = 30  # Fixed value: how long a preparation counts towards popularity.


def _stocked(products: DataFrame) -> DataFrame:
    """Product names with a missing flag: stock exactly zero, negative stock is not missing."""
    return products.select(
        F.col("id").alias("product_id"),
        "name",
        (F.col("current_stock") == 0).cast("int").alias("missing"),
    )


def _matching(recipes: DataFrame, category: str | None, search: str | None) -> DataFrame:
    """Recipe text is searched in name, instructions and notes."""
    conditions = []
    if category:
        conditions.append(same_text("category", category))
    if search:
        conditions.append(contains_any(["name", "instructions", "notes"], search))
    return where_all(recipes, conditions)


def recipe_list(
    recipes: DataFrame,
    ingredients: DataFrame,
    products: DataFrame,
    category: str | None = None,
    search: str | None = None,
    page: int = 1,
    limit: int = 9,
) -> DataFrame:
    """One page of recipes by name with ingredient count and how many are out of stock.

    The page is cut first; only ingredients of its recipes are joined and counted.
    """
    wanted = paginate(_listed(recipes, category, search), _by_name(), page, limit)
    return _with_ingredient_counts(wanted, ingredients, products, limit)


def recipe_list_page(
    recipes: DataFrame,
    ingredients: DataFrame,
    products: DataFrame,
    category: str | None = None,
    search: str | None = None,
    page: int = 1,
    limit: int = 9,
) -> Page:
    """``recipe_list`` and ``recipe_list_total`` of the same filters, from one scan of the recipes."""
    found = page_and_total(_listed(recipes, category, search), _by_name(), page, limit)
    return Page(_with_ingredient_counts(found.rows, ingredients, products, limit), found.total)


def _by_name() -> list[Column]:
    return [fold_key("name").asc(), F.asc("id")]


def _listed(recipes: DataFrame, category: str | None, search: str | None) -> DataFrame:
    found = _matching(recipes, category, search)
    return found.select("id", "name", "category", "prep_time", "image_url")


def _with_ingredient_counts(
    wanted: DataFrame, ingredients: DataFrame, products: DataFrame, limit: int
) -> DataFrame:
    used = ingredients.select("recipe_id", "product_id").join(
        small_page(wanted.select(F.col("id").alias("recipe_id")), limit), "recipe_id"
    )
    counts = (
        used.join(_stocked(products), "product_id", "left")
        .groupBy(F.col("recipe_id").alias("id"))
        .agg(
            F.count(F.lit(1)).alias("ingredients_count"),
            F.coalesce(F.sum("missing"), F.lit(0)).alias("missing_ingredients"),
        )
    )
    return (
        wanted.join(small_page(counts, limit), "id", "left")
        .withColumn("ingredients_count", F.coalesce("ingredients_count", F.lit(0)))
        .withColumn("missing_ingredients", F.coalesce("missing_ingredients", F.lit(0)))
        .orderBy(*_by_name())
    )


def recipe_list_total(
    recipes: DataFrame, category: str | None = None, search: str | None = None
) -> DataFrame:
    return _matching(recipes, category, search).agg(F.count(F.lit(1)).alias("total"))


def recipe_categories(recipes: DataFrame) -> DataFrame:
    return distinct_text(recipes, "category")


def recipe_counts(
    recipes: DataFrame,
    log: DataFrame,
    ingredients: DataFrame,
    products: DataFrame,
    as_of: Moment,
    days: int = POPULAR_DAYS,
) -> DataFrame:
    """All recipes; those prepared in the last ``days`` days; those lacking an ingredient.

    The window opens at this very moment ``days`` days ago, not at midnight. Log and
    ingredients shrink to distinct recipe ids before they meet the recipes.
    """
    since = as_datetime(as_of) - timedelta(days=days)
    popular = (
        log.where((F.col("action") == "prepared") & (F.col("created_at") >= ts_lit(since)))
        .groupBy(F.col("recipe_id").alias("id"))
        .agg(F.lit(1).alias("_popular"))
    )
    empty = products.where(F.col("current_stock") == 0).select(F.col("id").alias("product_id"))
    missing = (
        ingredients.select("recipe_id", "product_id")
        .join(empty, "product_id", "left_semi")
        .groupBy(F.col("recipe_id").alias("id"))
        .agg(F.lit(1).alias("_missing"))
    )
    return (
        recipes.select("id")
        .join(popular, "id", "left")
        .join(missing, "id", "left")
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count("_popular").alias("popular"),
            F.count("_missing").alias("missing"),
        )
    )


def recipe_details(
    recipes: DataFrame,
    ingredients: DataFrame,
    products: DataFrame,
    ids: DataFrame | None = None,
    part_rows: int | None = None,
) -> DataFrame:
    """Recipes (all, or those named in ``ids``) with nested ingredients and a missing flag.

    A recipe is one document; with ``part_rows``, one of more ingredients comes as several.
    """
    used = ingredients.select("id", "recipe_id", "product_id", "quantity", "unit", "notes")
    if ids is not None:
        recipes = recipes.join(ids.select("id"), "id", "left_semi")
        used = used.join(ids.select(F.col("id").alias("recipe_id")), "recipe_id", "left_semi")
    stocked = _stocked(products)
    order = ["id", "name", "quantity", "unit", "notes", "product_id", "missing"]
    lists = nest(
        used.join(stocked, "product_id"),
        "recipe_id",
        [F.col(c) for c in order],
        "ingredients",
        part_rows=part_rows,
    )
    element = (
        "struct<id:bigint,name:string,quantity:decimal(10,2),unit:string,notes:string,"
        "product_id:bigint,missing:int>"
    )
    return recipes.join(lists, recipes["id"] == lists["recipe_id"], "left").select(
        *[recipes[c] for c in recipes.columns],
        F.coalesce(lists["part"], F.lit(0)).alias("part"),
        F.coalesce(lists["ingredients"], F.array().cast(f"array<{element}>")).alias("ingredients"),
    )
