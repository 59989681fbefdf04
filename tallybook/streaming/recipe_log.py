"""Recipe actions as they happen: appended to the log and counted per recipe and action."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from tallybook.schemas import RECIPE_ACTIONS
from tallybook.streaming.files import write_updates


def known_actions(actions: DataFrame) -> DataFrame:
    """Actions the log may hold; others are refused."""
    return actions.where(F.col("action").isin(*RECIPE_ACTIONS) & F.col("recipe_id").isNotNull())


def action_counts(log: DataFrame) -> DataFrame:
    return known_actions(log).groupBy("recipe_id", "action").agg(F.count(F.lit(1)).alias("times"))


def once_each(actions: DataFrame, window: str) -> DataFrame:
    """Actions without those whose ``id`` was seen before, as when a file is sent again.

    Ids are remembered between batches for as long as a replay may lag, ``window`` behind the newest
    action; an action that is itself older than that cannot be told from a replay and is left out.
    """
    return (
        actions.withColumn("_at", F.col("created_at").cast("timestamp"))
        .withWatermark("_at", window)
        .dropDuplicatesWithinWatermark(["id"])
        .drop("_at")
    )


def append_actions(actions: DataFrame, path: str, checkpoint: str, replay_window: str | None = None) -> StreamingQuery:
    """Append arriving actions to the log files; each file of input is taken exactly once.

    With ``replay_window``, so is each action by its id, in whatever file it comes again.
    """
    known = known_actions(actions)
    return (
        (once_each(known, replay_window) if replay_window else known)
        .writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )


def count_actions(actions: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the running counts; read them with ``files.latest(…, ["recipe_id", "action"])``."""
    return write_updates(action_counts(actions), path, checkpoint)
