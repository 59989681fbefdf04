"""Thirty-day figures from daily parts (A2, A18).

The parts of a day are written once, as its rows arrive, in the folder of its month and sorted by
day there, as a folder a day would be thousands of small files. A report reads the days of its
window and neither the log nor the orders. Late rows of an old day are one more part of it.

* Recipes prepared on a day are a set: bitmaps of 32,768 ids each, exact, put together by OR.
  A window that opens in the midst of a day also needs to know when each recipe was last prepared
  on that one day, which is kept beside the bitmaps. Both may be written twice without harm.
* Lines sold on a day are counts per product, put together by addition, so each line must be
  written once.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallybook.functions.clock import Moment, as_date, as_datetime, period_bounds, ts_lit
from tallybook.operators.recipes import POPULAR_DAYS
from tallybook.operators.sales import TOP_DAYS, best_sellers
from tallybook.sources.scratch import materialize

_LAST = "day DATE, recipe_id BIGINT, last_at TIMESTAMP_NTZ"
_SETS = "day DATE, bucket BIGINT, bits BINARY"
_LINES = "day DATE, product_id BIGINT, lines BIGINT"


def _add(parts: DataFrame, key: str, path: str) -> None:
    """Parts appended to their months; neighbours in (day, key) share a file."""
    months = parts.withColumn("month", F.trunc("day", "month"))
    ranged = months.repartitionByRange("month", "day", key).sortWithinPartitions("month", "day", key)
    ranged.write.partitionBy("month").mode("append").parquet(path)


def _days(spark: SparkSession, path: str, columns: str, start: date, end: date | None = None) -> DataFrame:
    """Parts of the days from ``start`` to ``end``, both included: the months are picked by folder,
    the days by the ranges their files keep."""
    day, month = F.col("day"), F.col("month")
    found = spark.read.schema(f"{columns}, month DATE").parquet(path)
    found = found.where((month >= F.lit(start.replace(day=1))) & (day >= F.lit(start)))
    return found if end is None else found.where((month <= F.lit(end.replace(day=1))) & (day <= F.lit(end)))


def _bits(key: str) -> Column:
    return F.bitmap_construct_agg(F.bitmap_bit_position(F.col(key))).alias("bits")


def _bucket(key: str) -> Column:
    return F.bitmap_bucket_number(F.col(key)).alias("bucket")


def add_preparations(log: DataFrame, root: str) -> None:
    """Add logged actions to the daily sets of prepared recipes. Rows without id or time are left out."""
    done = log.where((F.col("action") == "prepared") & F.col("recipe_id").isNotNull())
    last = materialize(
        done.where(F.col("created_at").isNotNull())
        .groupBy(F.to_date("created_at").alias("day"), "recipe_id")
        .agg(F.max("created_at").alias("last_at"))
    )
    _add(last, "recipe_id", f"{root}/last")
    _add(last.groupBy("day", _bucket("recipe_id")).agg(_bits("recipe_id")), "bucket", f"{root}/sets")


def prepared_since(spark: SparkSession, root: str, since: Moment) -> DataFrame:
    """(bucket, bits) of the recipes prepared at ``since`` or later."""
    first = as_date(since)
    whole = _days(spark, f"{root}/sets", _SETS, first + timedelta(days=1))
    edge = _days(spark, f"{root}/last", _LAST, first, first).where(F.col("last_at") >= ts_lit(since))
    edge = edge.groupBy(_bucket("recipe_id")).agg(_bits("recipe_id"))
    both = whole.select("bucket", "bits").unionByName(edge)
    return both.groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def recipe_counts_from_days(
    recipes: DataFrame,
    ingredients: DataFrame,
    products: DataFrame,
    root: str,
    as_of: Moment,
    days: int = POPULAR_DAYS,
) -> DataFrame:
    """``recipe_counts`` from the daily sets under ``root``: the same window, to the instant.

    Recipes, those prepared and those lacking an ingredient are sets of ids; a set counts as far
    as it meets the recipes there are.
    """
    since = as_datetime(as_of) - timedelta(days=days)
    empty = products.where(F.col("current_stock") == 0).select(F.col("id").alias("product_id"))
    lacking = (
        ingredients.where(F.col("recipe_id").isNotNull())
        .select("recipe_id", "product_id")
        .join(empty, "product_id", "left_semi")
        .groupBy(_bucket("recipe_id"))
        .agg(_bits("recipe_id"))
    )
    kinds = {"popular": prepared_since(recipes.sparkSession, root, since), "missing": lacking}
    existing = recipes.select("id").groupBy(_bucket("id")).agg(_bits("id"), F.count(F.lit(1)).alias("rows"))
    each = F.explode(F.array(*[F.lit(k) for k in kinds])).alias("kind")
    sets = existing.select(each, "bucket", "bits", "rows")
    for kind, found in kinds.items():
        sets = sets.unionByName(found.select(F.lit(kind).alias("kind"), "bucket", "bits"), allowMissingColumns=True)
    met = sets.groupBy("kind", "bucket").agg(
        F.bitmap_count(F.bitmap_and_agg("bits")).alias("ids"),
        F.count(F.lit(1)).alias("sides"),
        F.sum("rows").alias("rows"),
    )
    counted = [
        F.coalesce(F.sum(F.when((F.col("kind") == k) & (F.col("sides") == 2), F.col("ids"))), F.lit(0)).alias(k)
        for k in kinds
    ]
    total = F.coalesce(F.sum(F.when(F.col("kind") == "popular", F.col("rows"))), F.lit(0)).alias("total")
    return met.agg(total, *counted)


def add_lines(items: DataFrame, orders: DataFrame, root: str) -> None:
    """Add order lines to the daily counts per product, each once. Lines of no dated order are left out."""
    dated = orders.where(F.col("order_date").isNotNull()).select(
        F.col("id").alias("order_id"), F.to_date("order_date").alias("day")
    )
    sold = items.select("order_id", "product_id").join(dated, "order_id")
    _add(sold.groupBy("day", "product_id").agg(F.count(F.lit(1)).alias("lines")), "product_id", f"{root}/lines")


def top_products_from_days(
    products: DataFrame, root: str, as_of: Moment, days: int = TOP_DAYS, n: int = 5
) -> DataFrame:
    """``top_products`` from the daily counts under ``root``; its window opens at midnight, so days do."""
    since = as_date(period_bounds(as_of, "day")[0] - timedelta(days=days))
    per_product = (
        _days(products.sparkSession, f"{root}/lines", _LINES, since)
        .groupBy("product_id")
        .agg(F.sum("lines").alias("_lines"))
    )
    return best_sellers(per_product, products, n)
