"""Customer names kept between batches (C4), in a table bucketed by the folded name.

A batch shuffles its own names to the table's buckets; the table is read bucket by bucket and never
shuffled or aggregated again, so a batch costs what it holds, however many customers there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallybook.functions.rows import dense_index
from tallybook.functions.text import fold_key
from tallybook.operators.intake import Customers
from tallybook.sources.scratch import materialize

# Buckets of a name table; at least the number of tasks that are to read it.
BUCKETS = 64


def _append(names: DataFrame, table: str, path: str, buckets: int) -> None:
    (
        names.repartition(buckets, "_name")
        .write.format("parquet")
        .option("path", path)
        .bucketBy(buckets, "_name")
        .sortBy("_name")
        .mode("append")
        .saveAsTable(table)
    )


def keep_names(customers: DataFrame, table: str, path: str, buckets: int = BUCKETS) -> None:
    """Start the table ``table`` under ``path``: every folded name with its lowest customer id."""
    named = customers.where(F.col("name").isNotNull()).groupBy(fold_key("name").alias("_name"))
    _append(named.agg(F.min("id").alias("customer_id")), table, path, buckets)


def resolve_kept_names(
    accepted: DataFrame, table: str, first_id: int, buckets: int = BUCKETS
) -> Customers:
    """Match a batch of sales to the kept names; both results are written and stay as they are.

    Ids of new customers start at ``first_id`` and follow the first sale that names each; the
    spelling is that sale's. Sales without a name have no link, as in ``intake_resolve_customers``.
    Add ``new`` to the customers first and ``keep_new_names`` after that: a batch taken in again
    before its names are kept gives the same ids, and one taken in after that creates nobody.
    """
    spark = accepted.sparkSession
    known = spark.read.table(table)
    first = (
        accepted.where(F.col("customer").isNotNull())
        .groupBy(fold_key("customer").alias("_name"))
        .agg(F.min(F.struct("arrival_seq", "feed_id", "customer")).alias("_first"))
        .repartition(buckets, "_name")
    )
    unknown = first.join(known, "_name", "left_anti").select("_name", "_first.*")
    created = dense_index(unknown, [F.col("arrival_seq"), F.col("feed_id")], "_n").withColumn(
        "customer_id", F.col("_n") + F.lit(first_id)
    )
    feed = accepted.select("feed_id", fold_key("customer").alias("_name")).repartition(buckets, "_name")
    made = created.select("_name", F.col("customer_id").alias("_made"))
    found = F.coalesce("customer_id", "_made").alias("customer_id")
    links = feed.join(known, "_name", "left").join(made, "_name", "left").select("feed_id", found)
    return Customers(
        materialize(links.where(F.col("customer_id").isNotNull())),
        materialize(created.select(F.col("customer_id").alias("id"), F.col("customer").alias("name"))),
    )


def keep_new_names(new: DataFrame, table: str, path: str, buckets: int = BUCKETS) -> None:
    """Add the names of ``new``, as ``resolve_kept_names`` gives them, to the kept ones."""
    _append(new.select(fold_key("name").alias("_name"), F.col("id").alias("customer_id")), table, path, buckets)
