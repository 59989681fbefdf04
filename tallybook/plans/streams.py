"""Named queries that run a stream over a whole table to its end."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from math import ceil

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from tallybook.plans.parameters import PROCESSING_YEAR
from tallybook.plans.writes import intake_state
from tallybook.sources.bindings import SOURCE_SCHEMAS, Bindings
from tallybook.sources.scratch import materialize, scratch_path
from tallybook.plans.writes import taken_in
from tallybook.streaming.daily_sales import daily_figures, run_daily_sales, run_daily_sales_and_late
from tallybook.streaming.files import latest, merged_upto, read_batches, read_stream
from tallybook.streaming.order_intake import current_state, run_order_intake, sale_feed_documents
from tallybook.streaming.recipe_log import append_actions, count_actions


# The years of the orders, and how far back a replayed file of events may lie.
YEARS = range(1995, 2002)
REPLAY_WINDOW = "60 days"
# Batches a written log is counted in.
COUNT_BATCHES = 4


class _Arriving(Bindings):
    """The same bindings with the source tables read as streams."""

    def source(self, name: str) -> DataFrame:
        # The pattern finds a table that is one file as well as one that is a folder of files.
        return read_stream(self.spark, f"{self.sf_dir}/{name}.parquet*", SOURCE_SCHEMAS[name])


def _recipe_log(b: Bindings) -> DataFrame:
    root = scratch_path(b.spark, "recipe-log")
    append_actions(_Arriving(b.spark, b.sf_dir).recipe_feed, f"{root}/log", f"{root}/state").awaitTermination()
    return b.spark.read.parquet(f"{root}/log")


def _recipe_counts(b: Bindings) -> DataFrame:
    root = scratch_path(b.spark, "recipe-counts")
    count_actions(_Arriving(b.spark, b.sf_dir).recipe_feed, f"{root}/out", f"{root}/state").awaitTermination()
    return latest(b.spark, f"{root}/out", ["recipe_id", "action"])


def _daily_sales(b: Bindings) -> DataFrame:
    root = scratch_path(b.spark, "daily-sales")
    orders = _Arriving(b.spark, b.sf_dir).orders.select("order_date", "total_amount")
    run_daily_sales(orders, f"{root}/out", f"{root}/state").awaitTermination()
    return latest(b.spark, f"{root}/out", ["day"]).withColumn("total", F.col("total").cast("double"))


def _order_intake(b: Bindings) -> DataFrame:
    """All sales as documents, taken in by the stream; what was decided about each."""
    root = scratch_path(b.spark, "order-intake")
    sale_feed_documents(b.orders_feed, b.items_feed).write.parquet(f"{root}/feed")
    schema = b.spark.read.parquet(f"{root}/feed").schema
    documents = read_stream(b.spark, f"{root}/feed", schema)
    run_order_intake(
        documents, intake_state(b), f"{root}/out", f"{root}/state", PROCESSING_YEAR
    ).awaitTermination()
    accepted = b.spark.read.parquet(f"{root}/out/accepted").select(
        "feed_id", "order_number", F.lit(None).cast("string").alias("reject_reason")
    )
    rejected = b.spark.read.parquet(f"{root}/out/rejected").drop("batch")
    return accepted.unionByName(rejected, allowMissingColumns=True)


def _arrive(
    rows: DataFrame, folder: str, steps: Sequence[Column], take_in: Callable[[DataFrame], StreamingQuery]
) -> None:
    """A feed that arrives step by step: the rows of each, in a file a task, are taken in as one batch.

    The stream is started for every step and goes on from its checkpoint, so that a step may be as
    many files as its rows need.
    """
    path = f"{folder}/feed"
    for step in steps:
        rows.where(step).write.mode("append").parquet(path)
        take_in(read_stream(rows.sparkSession, path, rows.schema)).awaitTermination()


def _within(step: Column, steps: Sequence[int]) -> Column:
    """The step, or the nearest there is, so that every row arrives."""
    return F.greatest(F.least(F.coalesce(step, F.lit(steps[0])), F.lit(steps[-1])), F.lit(steps[0]))


def _log_replayed(b: Bindings, root: str) -> str:
    """The log of every event, in four steps by time, of which the second is sent again at the end."""
    log = f"{root}/log"
    quarter = _within(F.floor((F.dayofmonth("created_at") - 1) / F.lit(8)), range(4))
    _arrive(
        b.recipe_feed,
        root,
        [quarter == i for i in (*range(4), 1)],
        lambda arriving: append_actions(arriving, log, f"{root}/state", REPLAY_WINDOW),
    )
    return log


def _recipe_log_replayed(b: Bindings) -> DataFrame:
    return b.spark.read.parquet(_log_replayed(b, scratch_path(b.spark, "recipe-log")))


def _recipe_counts_replayed(b: Bindings) -> DataFrame:
    """Counts of the log that replays do not change, taken from it in so many batches."""
    root = scratch_path(b.spark, "recipe-counts")
    log = _log_replayed(b, root)
    # A batch writes a file a task: batches of so many files each would grow in number with the tasks.
    files = len(b.spark.read.parquet(log).inputFiles())
    logged = read_stream(b.spark, log, b.recipe_log.schema, files_per_batch=max(1, ceil(files / COUNT_BATCHES)))
    count_actions(logged, f"{root}/out", f"{root}/counted").awaitTermination()
    return latest(b.spark, f"{root}/out", ["recipe_id", "action"])


def _daily_sales_late(b: Bindings) -> DataFrame:
    """Orders in a batch a year, some of them sent with the next year's: days, and what came too late."""
    root = scratch_path(b.spark, "daily-sales")
    orders = b.orders.select("id", "order_date", "total_amount")
    year = F.year("order_date")
    sent = _within(year + F.when(F.col("id") % 50 == 0, 1).otherwise(0), YEARS)
    _arrive(
        orders,
        root,
        [sent == year for year in YEARS],
        lambda arriving: run_daily_sales_and_late(arriving, f"{root}/out", f"{root}/state"),
    )
    days = daily_figures(b.spark, f"{root}/out", len(YEARS))
    late = read_batches(b.spark, f"{root}/out", "late", len(YEARS)).groupBy(F.to_date("order_date").alias("day"))
    late = late.agg(F.sum("total_amount").alias("total"), F.count(F.lit(1)).alias("orders"))
    both = days.select(F.lit("taken").alias("kind"), "*").unionByName(late.select(F.lit("late").alias("kind"), "*"))
    return both.withColumn("total", F.col("total").cast("double"))


def _order_intake_batches(b: Bindings) -> DataFrame:
    """All sales in a batch for every two years, their tables merged on the way; every table afterwards."""
    root = scratch_path(b.spark, "order-intake")
    steps = range((len(YEARS) + 1) // 2)
    year = F.year(F.col("order_date").try_cast("timestamp_ntz"))
    pair = _within(F.floor((year - YEARS[0]) / F.lit(2)), steps)
    documents = materialize(sale_feed_documents(b.orders_feed, b.items_feed), "documents")
    base = intake_state(b)
    out = f"{root}/out"
    _arrive(
        documents,
        root,
        [pair == step for step in steps],
        lambda arriving: run_order_intake(
            arriving, base, out, f"{root}/state", PROCESSING_YEAR, merge_every=2
        ),
    )
    assert merged_upto(b.spark, out, len(steps)) >= 0
    accepted, rejected = (b.spark.read.parquet(f"{out}/{t}").drop("batch") for t in ("accepted", "rejected"))
    decided = accepted.select("feed_id", "order_number").unionByName(rejected, allowMissingColumns=True)
    return taken_in(current_state(base, out, len(steps)), decided)


QUERIES: dict[str, Callable[[Bindings], DataFrame]] = {
    "stream_recipe_log": _recipe_log,
    "stream_recipe_counts": _recipe_counts,
    "stream_daily_sales": _daily_sales,
    "stream_order_intake": _order_intake,
    "stream_recipe_log_replayed": _recipe_log_replayed,
    "stream_recipe_counts_replayed": _recipe_counts_replayed,
    "stream_daily_sales_late": _daily_sales_late,
    "stream_order_intake_batches": _order_intake_batches,
}
