"""Sales and orders per day while orders arrive."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tallybook.streaming.files import read_batches, write_batch, write_updates

BOUNDS = "newest timestamp_ntz, rows bigint, late bigint, undated bigint"


def daily_sales(orders: DataFrame, lateness: str = "1 day") -> DataFrame:
    """(day, total, orders). Days further back than ``lateness`` behind the newest order are
    closed: a later order for them is dropped, and their state is freed.

    Event time needs a zoned timestamp; the session runs in UTC, so days stay calendar days.
    """
    return (
        orders.withColumn("_at", F.col("order_date").cast("timestamp"))
        .withWatermark("_at", lateness)
        .groupBy(F.window("_at", "1 day").alias("_window"))
        .agg(F.sum("total_amount").alias("total"), F.count(F.lit(1)).alias("orders"))
        .select(F.to_date("_window.start").alias("day"), "total", "orders")
    )


def run_daily_sales(
    orders: DataFrame, path: str, checkpoint: str, lateness: str = "1 day"
) -> StreamingQuery:
    """Keep the daily figures; read them with ``files.latest(…, ["day"])``."""
    return write_updates(daily_sales(orders, lateness), path, checkpoint)


def run_daily_sales_and_late(
    orders: DataFrame, path: str, checkpoint: str, lateness: str = "1 day"
) -> StreamingQuery:
    """Daily figures of what comes in time, and the orders that come too late, beside them.

    A day is closed once it ends ``lateness`` or more before the newest order of the batches before.
    Orders for a closed day, and orders without a date, go to ``late`` as they are; the others are
    summed per day and batch into ``days``, so a batch holds sums of open days only and what is
    closed is not touched again. ``bounds`` has, for each batch, the newest order so far and the
    rows counted on the way through. A batch that is run again finds the same bound and overwrites
    its own folders.
    """

    def take_in(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        newest = _newest(spark, path, batch_id)
        at = F.col("order_date").cast("timestamp_ntz")
        closed = F.lit(False)
        if newest is not None:
            limit = F.lit(newest).cast("timestamp_ntz") - F.expr(f"INTERVAL {lateness}")
            closed = F.date_trunc("day", at).cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY") <= limit
        late = F.coalesce(closed, F.lit(True))
        undated = at.isNull()
        seen = Observation()
        counted = batch.observe(
            seen,
            F.max(at).alias("newest"),
            F.count(F.lit(1)).alias("rows"),
            F.count_if(late | undated).alias("late"),
            F.count_if(undated).alias("undated"),
        )
        write_batch(counted.where(late | undated), f"{path}/late", batch_id)
        days = batch.where(~(late | undated)).groupBy(F.to_date(at).alias("day"))
        write_batch(
            days.agg(F.sum("total_amount").alias("total"), F.count(F.lit(1)).alias("orders")), f"{path}/days", batch_id
        )
        found = seen.get
        last = max((t for t in (newest, found["newest"]) if t is not None), default=None)
        told = spark.createDataFrame([(last, found["rows"], found["late"], found["undated"])], BOUNDS)
        write_batch(told.coalesce(1), f"{path}/bounds", batch_id)

    return (
        orders.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(take_in)
        .trigger(availableNow=True)
        .start()
    )


def _newest(spark: SparkSession, path: str, batch_id: int) -> datetime | None:
    """The newest order of the batches before, as the last of them left it."""
    if batch_id == 0:
        return None
    return spark.read.schema(BOUNDS).parquet(f"{path}/bounds/batch={batch_id - 1}").first()["newest"]


def daily_figures(spark: SparkSession, path: str, batches: int) -> DataFrame:
    """Totals of all days over the first ``batches`` batches."""
    return (
        read_batches(spark, path, "days", batches)
        .groupBy("day")
        .agg(F.sum("total").alias("total"), F.sum("orders").alias("orders"))
    )
