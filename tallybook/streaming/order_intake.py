"""Order intake as a stream of sale documents.

The tables on hand are a fixed base plus what each earlier batch added. A batch writes only its
own new rows, in its own folder, and reads only folders of earlier batches; run again after a
failure it finds the same tables and overwrites its folder with the same rows. Where ids and
order numbers go on is handed from batch to batch, so that orders, lines and ledger on hand are
read once, at the first batch, however large they grow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from tallybook.functions.rows import nest
from tallybook.operators.allocation import BLOCK_ORDERS
from tallybook.operators.intake import (
    PREFIXES,
    Counters,
    Intake,
    State,
    apply_new,
    counters_of,
    last_numbers,
    order_intake,
)
from tallybook.sources.scratch import deal, materialize_by
from tallybook.streaming.files import MERGE_EVERY, merge_batches, merged_upto, read_batches, write_batch

COUNTERS = "name string, year int, value bigint"
LINE_FIELDS = ("line_no", "product_id", "quantity", "unit_price", "valor")


def sale_feed_documents(
    orders_feed: DataFrame, items_feed: DataFrame, part_rows: int | None = None
) -> DataFrame:
    """Sales as documents with nested lines; with ``part_rows`` an oversized sale is several documents.

    All parts of a sale have to arrive in the same batch.
    """
    lines = nest(
        items_feed, "feed_id", [F.col(c) for c in LINE_FIELDS], "items", part_rows=part_rows
    )
    return orders_feed.join(lines, "feed_id", "left").withColumn("part", F.coalesce("part", F.lit(0)))


def flatten(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(orders_feed, items_feed) of a batch of sale documents."""
    heads = documents.where(F.col("part") == 0).drop("items", "part")
    items = documents.select("feed_id", F.inline("items"))
    return heads, items


def current_state(base: State, root: str, batch_id: int) -> State:
    """The tables as they are when batch ``batch_id`` starts."""
    if batch_id == 0:
        return base
    spark = base["products"].sparkSession
    added = {name: read_batches(spark, root, name, batch_id) for name in base}
    added["products"] = _sold(added["products"])
    return apply_new(base, added)


def _sold(products: DataFrame) -> DataFrame:
    return products.groupBy("id").agg(F.sum("sold").alias("sold"))


def _counters(base: State, root: str, batch_id: int, year: int) -> Counters:
    """The counters the batch before left; the tables' own for the first one."""
    if batch_id == 0:
        return counters_of(base, year)
    spark = base["products"].sparkSession
    left = spark.read.schema(COUNTERS).parquet(f"{root}/counters/batch={batch_id - 1}").collect()
    values = {r["name"]: r["value"] for r in left if r["year"] is None}
    numbers = {r["name"]: r["value"] for r in left if r["year"] == year}
    if not numbers:  # the first batch of another year
        numbers = last_numbers(current_state(base, root, batch_id)["orders"], year)
    return Counters(**values, numbers=numbers)


def _write_counters(start: Counters, done: Intake, year: int, root: str, batch_id: int) -> None:
    """What the next batch goes on from: a handful of rows. New rows are counted as this batch wrote them."""
    spark = done.accepted.sparkSession
    written = lambda name: spark.read.parquet(f"{root}/{name}/batch={batch_id}").count()
    prefix = F.substring_index("order_number", "-", 1).alias("prefix")
    added = {r["prefix"]: r["count"] for r in done.accepted.groupBy(prefix).count().collect()}
    orders = sum(added.values())
    numbers = {p: start.numbers.get(p, 0) + added.get(p, 0) for p in PREFIXES.values()}
    left = [
        ("customer", None, start.customer + written("customers")),
        ("order", None, start.order + orders),
        ("item", None, start.item + written("order_items")),
        ("entry", None, start.entry + orders),
        *[(prefix, year, number) for prefix, number in numbers.items()],
    ]
    write_batch(spark.createDataFrame(left, COUNTERS).coalesce(1), f"{root}/counters", batch_id)


def run_order_intake(
    documents: DataFrame,
    base: State,
    root: str,
    checkpoint: str,
    processing_year: int,
    source_tz: str = "UTC",
    block_orders: int = BLOCK_ORDERS,
    merge_every: int = MERGE_EVERY,
) -> StreamingQuery:
    """Take in what has arrived, batch by batch, under ``root``.

    Besides a folder per table there are ``accepted``, ``rejected`` and ``shortages``. Whenever
    ``merge_every`` batches lie side by side their tables are merged, so that a batch reads a
    bounded number of folders however long the stream has run.
    """

    def take_in(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if batch_id - 1 - merged_upto(spark, root, batch_id) >= merge_every:
            merge_batches(spark, root, list(base), batch_id, {"products": _sold})
        orders_feed, items_feed = flatten(materialize_by(deal(batch, "feed_id"), "feed_id", "sales"))
        start = _counters(base, root, batch_id, processing_year)
        done = order_intake(
            orders_feed,
            items_feed,
            current_state(base, root, batch_id),
            processing_year,
            source_tz,
            block_orders=block_orders,
            counters=start,
            dealt=True,
        )
        for name, rows in done.new.items():
            write_batch(rows, f"{root}/{name}", batch_id)
        write_batch(done.accepted, f"{root}/accepted", batch_id)
        write_batch(done.rejected, f"{root}/rejected", batch_id)
        write_batch(done.shortages, f"{root}/shortages", batch_id)
        _write_counters(start, done, processing_year, root, batch_id)

    return (
        documents.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(take_in)
        .trigger(availableNow=True)
        .start()
    )
