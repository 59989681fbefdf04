"""File sources and the per-batch sink shared by the streams.

Every micro-batch writes its own ``batch=<id>`` folder and overwrites it when it is replayed
after a failure, so a batch counts once however often it runs. Folders of old batches can be
merged: the merged tables are written beside them, and a small list, written last, says up to
which batch they reach. Readers take the merged table and the folders after it.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery


def read_stream(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str,
    fmt: str = "parquet",
    files_per_batch: int | None = None,
) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def write_batch(rows: DataFrame, path: str, batch_id: int) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


# Batches that may lie side by side before they are merged.
MERGE_EVERY = 16


def merged_upto(spark: SparkSession, root: str, before: int) -> int:
    """The last batch, of those before ``before``, that the newest list names as merged; -1 if none is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/lists")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return -1
    upto = F.col("upto")
    found = spark.read.schema("upto int").parquet(f"{root}/lists").where(upto < before).agg(F.max(upto)).first()
    return -1 if found[0] is None else found[0]


def read_batches(spark: SparkSession, root: str, name: str, before: int) -> DataFrame:
    """What the batches before ``before`` wrote to one table: the merged part and the folders after it."""
    upto = merged_upto(spark, root, before)
    merged = [f"{root}/merged/{name}/{upto}"] if upto >= 0 else []
    return spark.read.parquet(*merged, *[f"{root}/{name}/batch={i}" for i in range(upto + 1, before)])


def merge_batches(
    spark: SparkSession,
    root: str,
    names: Sequence[str],
    before: int,
    combine: Mapping[str, Callable[[DataFrame], DataFrame]],
) -> None:
    """Write what the batches before ``before`` hold as one folder a table, then the list that names it.

    ``combine`` shrinks the rows of tables that allow it. Until the list is there readers keep to
    the older folders, so a merge that fails half way is simply done again.
    """
    for name in names:
        rows = combine.get(name, lambda df: df)(read_batches(spark, root, name, before))
        rows.hint("rebalance").write.mode("overwrite").parquet(f"{root}/merged/{name}/{before - 1}")
    told = spark.createDataFrame([(before - 1,)], "upto int").coalesce(1)
    told.write.mode("overwrite").parquet(f"{root}/lists/until={before - 1}")


def write_updates(updates: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Run an aggregate in update mode over what has arrived, one folder per batch."""
    return (
        updates.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(lambda rows, batch_id: write_batch(rows, path, batch_id))
        .trigger(availableNow=True)
        .start()
    )


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The last row every key was updated to."""
    updates = spark.read.parquet(path)
    values = [c for c in updates.columns if c not in (*keys, "batch")]
    return (
        updates.groupBy(*keys)
        .agg(F.max_by(F.struct(*values), "batch").alias("_last"))
        .select(*keys, "_last.*")
    )
