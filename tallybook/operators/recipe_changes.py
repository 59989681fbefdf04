"""Writing recipes together with their ingredients: a recipe and its lines go in whole or not at all."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from tallybook.functions.clock import Moment, ts_lit
from tallybook.functions.rows import dense_index
from tallybook.operators.changes import next_id, replace_children, update_rows
from tallybook.sources.scratch import materialize
from tallybook.sources.tables import first_violation, typed_columns

LINE_ORDER = ("recipe_id", "line_no", "product_id", "quantity", "unit", "notes")


class RecipesWritten(NamedTuple):
    recipes: DataFrame  # the table afterwards
    ingredients: DataFrame  # the table afterwards
    accepted: DataFrame  # feed_id of what went in, with the recipe's id
    rejected: DataFrame  # feed_id, reject_reason


def insert_recipes(
    recipes: DataFrame,
    ingredients: DataFrame,
    products: DataFrame,
    feed: DataFrame,
    lines: DataFrame,
    as_of: Moment | None = None,
) -> RecipesWritten:
    """New recipes with their ingredients; ids are given in the order of ``feed_id``.

    ``feed`` has a unique ``feed_id`` and the columns of recipes, ``lines`` has ``feed_id``,
    ``line_no`` and the columns of ingredients. A recipe is rejected for its own values, else for
    its first line that does not fit or names an unknown product; nothing of it is written then.
    Lines of a recipe that is not in the feed are rejected. A recipe may have no lines.
    """
    heads, judged = _judged(feed.withColumn("id", F.lit(None).cast("long")), lines, products, as_of)
    fitting = heads.where(F.col("reject_reason").isNull())
    numbered = dense_index(fitting, [F.col("feed_id")], "_n").withColumn(
        "id", F.col("_n") + F.lit(next_id(recipes))
    )
    accepted = numbered.select("feed_id", "id")
    new_lines = _placed(judged, accepted, as_of)
    by_line = dense_index(new_lines, _line_order(), "_n").withColumn(
        "id", F.col("_n") + F.lit(next_id(ingredients))
    )
    return RecipesWritten(
        recipes.unionByName(numbered.select(*recipes.columns)),
        ingredients.unionByName(by_line.select(*ingredients.columns)),
        accepted,
        _rejected(heads, judged),
    )


def revise_recipes(
    recipes: DataFrame,
    ingredients: DataFrame,
    products: DataFrame,
    feed: DataFrame,
    lines: DataFrame,
    as_of: Moment | None = None,
) -> RecipesWritten:
    """New values and a new list of ingredients for the recipes named by ``id``.

    As ``insert_recipes``, but ``feed`` names the recipe; an unknown one is rejected. Every listed
    value is set, NULL included. Of several accepted revisions of a recipe the one with the
    largest ``feed_id`` holds, with its lines alone.
    """
    known = recipes.select("id", F.lit(True).alias("_known"))
    listed = feed.join(known, "id", "left")
    heads, judged = _judged(listed, lines, products, as_of, F.col("_known").isNull())
    fitting = heads.where(F.col("reject_reason").isNull())
    columns = [c for c in recipes.columns if c not in ("id", "created_at") and (c != "updated_at" or as_of is not None)]
    revised = update_rows(recipes, fitting, columns, seq="feed_id").rows
    last = fitting.groupBy("id").agg(F.max("feed_id").alias("feed_id")).select("feed_id", "id")
    new_lines = _placed(judged, last, as_of)
    replaced = replace_children(ingredients, "recipe_id", last.select("id"), new_lines, LINE_ORDER)
    return RecipesWritten(revised, replaced, fitting.select("feed_id", "id"), _rejected(heads, judged))


def _judged(
    feed: DataFrame, lines: DataFrame, products: DataFrame, as_of: Moment | None, unknown: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """Typed recipes with ``reject_reason``, and their typed lines, both written once."""
    known = products.select(F.col("id").alias("product_id"), F.lit(True).alias("_product"))
    # Ids come later; the declared type and the check of the other columns are needed here.
    unnumbered = lines.withColumn("id", F.lit(0)).withColumn("recipe_id", F.lit(0))
    typed = unnumbered.select("feed_id", "line_no", *typed_columns(unnumbered, "recipe_ingredients"))
    fault = F.coalesce(
        first_violation("recipe_ingredients"), F.when(F.col("_product").isNull(), F.lit("unknown:product_id"))
    )
    judged = materialize(
        typed.join(known, "product_id", "left")
        .withColumn("fault", fault)
        .drop("id", "recipe_id", "created_at", "_product"),
        "recipe-lines",
    )
    first = F.min(F.struct("line_no", "fault"))["fault"].alias("_fault")
    faults = judged.where(F.col("fault").isNotNull()).groupBy("feed_id").agg(first)
    own = F.lit(None).cast("string") if unknown is None else F.when(unknown, F.lit("unknown:recipe"))
    heads = feed.select("feed_id", *typed_columns(feed, "recipes"), own.alias("_own"))
    if as_of is not None:
        heads = heads.withColumn("created_at", ts_lit(as_of)).withColumn("updated_at", ts_lit(as_of))
    reason = F.coalesce(
        F.when(F.col("feed_id").isNull(), F.lit("missing:feed_id")), "_own", first_violation("recipes"), "_fault"
    )
    checked = heads.join(faults, "feed_id", "left").withColumn("reject_reason", reason)
    return materialize(checked.drop("_own", "_fault"), "recipes"), judged


def _line_order() -> Sequence[Column]:
    return [F.col(c) for c in LINE_ORDER]


def _placed(judged: DataFrame, accepted: DataFrame, as_of: Moment | None) -> DataFrame:
    """The lines of accepted recipes under the recipe's id."""
    stamp = ts_lit(as_of) if as_of is not None else F.lit(None).cast("timestamp_ntz")
    placed = judged.drop("fault").join(accepted.withColumnRenamed("id", "recipe_id"), "feed_id")
    return placed.drop("feed_id").withColumn("created_at", stamp)


def _rejected(heads: DataFrame, judged: DataFrame) -> DataFrame:
    """Recipes that do not fit, and the keys of lines without a recipe.

    The keys of both tables meet in one aggregate: a join would go by the size of the compressed
    files and broadcast every key of a long feed.
    """
    of_lines = judged.select("feed_id", F.lit(False).alias("_listed"))
    of_heads = heads.where(F.col("feed_id").isNotNull()).select("feed_id", F.lit(True).alias("_listed"))
    keys = of_lines.unionByName(of_heads).groupBy("feed_id").agg(F.bool_or("_listed").alias("_listed"))
    stray = keys.where(~F.col("_listed")).select("feed_id")
    return (
        heads.where(F.col("reject_reason").isNotNull())
        .select("feed_id", "reject_reason")
        .unionByName(stray.withColumn("reject_reason", F.lit("unknown:feed_id")))
    )
