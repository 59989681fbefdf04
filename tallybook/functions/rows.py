"""Frame helpers: predicates, metric unions, paging, dense numbering, nesting."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

from tallybook.sources.scratch import materialize

# Rows every scan task may hand to the one task that merges a top-k. Pages further down are cut
# by row number instead.
TOP_K_ROWS = 1_000
# Rows of one page that may be sent to every task.
BROADCAST_PAGE_ROWS = 10_000


def where_all(df: DataFrame, conditions: Sequence[Column]) -> DataFrame:
    return df.where(reduce(and_, conditions)) if conditions else df


def stack_metrics(*frames: DataFrame) -> DataFrame:
    """Put rows of different tables below each other; a metric a table lacks stays NULL.

    A single aggregate over the stack then yields metrics of several tables in one row with
    one map-side combined exchange and no join.
    """
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def money(col: Column) -> Column:
    """Exact decimal sum as a plain number, 0 when there is nothing to sum."""
    return F.coalesce(F.sum(col), F.lit(0)).cast("double")


def check_page(page: int, limit: int) -> int:
    if page < 1 or limit < 1:
        raise ValueError(f"page and limit start at 1, got page={page}, limit={limit}")
    return (page - 1) * limit


def paginate(
    df: DataFrame, order_by: Sequence[Column], page: int, limit: int, key: str = "id"
) -> DataFrame:
    """Rows of one page, in order. ``order_by`` must end in the unique ``key``.

    Near pages are a top-k (each task keeps ``offset + limit`` rows). For deep pages that
    would carry most of the table into one task, so there the keys alone are numbered across
    tasks, and the rows are fetched by the keys of the page.
    """
    offset = check_page(page, limit)
    if offset + limit <= TOP_K_ROWS:
        return df.orderBy(*order_by).offset(offset).limit(limit)
    numbered = dense_index(df, order_by, "_row", keep=[key])
    wanted = numbered.where((F.col("_row") >= offset) & (F.col("_row") < offset + limit)).select(key)
    return df.join(small_page(wanted, limit), key, "left_semi").orderBy(*order_by)


class Page(NamedTuple):
    rows: DataFrame  # in order
    total: int  # rows there are on all pages


def page_and_total(
    df: DataFrame, order_by: Sequence[Column], page: int, limit: int, key: str = "id"
) -> Page:
    """One page as ``paginate`` cuts it, and how many rows there are, from one scan of ``df``.

    A near page is fetched, some thousand rows at most, and the rows that pass by on the way are
    counted as they do: each task's count is taken once, when its result is, so a task run again
    does not count twice. For a deep page the keys are numbered anyway, and the total is how many.
    """
    offset = check_page(page, limit)
    if offset + limit <= TOP_K_ROWS:
        seen = Observation()
        passing = df.observe(seen, F.count(F.lit(1)).alias("total"))
        rows = passing.orderBy(*order_by).offset(offset).limit(limit).collect()
        return Page(df.sparkSession.createDataFrame(rows, df.schema), seen.get["total"])
    numbered = dense_index(df, order_by, "_row", keep=[key])
    wanted = numbered.where((F.col("_row") >= offset) & (F.col("_row") < offset + limit)).select(key)
    rows = df.join(small_page(wanted, limit), key, "left_semi").orderBy(*order_by)
    return Page(rows, numbered.count())


def small_page(page: DataFrame, limit: int) -> DataFrame:
    """Mark a page as a broadcast side; ``limit`` is the proof of its size."""
    return F.broadcast(page) if limit <= BROADCAST_PAGE_ROWS else page


def dense_index(
    df: DataFrame,
    order_by: Sequence[Column],
    name: str,
    within: Sequence[str] = (),
    within_name: str = "",
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Number rows 0, 1, 2 … in ``order_by`` order without gathering them in one task.

    Rows are range-partitioned and sorted, and their place inside the partition is written
    out with them. The partition sizes (one row per partition) then give every partition its
    first number. ``within`` asks for a second number, counted inside each group: per group
    and partition, so that one group holding most rows is still spread over all partitions.
    ``keep`` lists the columns that are needed afterwards (default all).
    """
    columns = df.columns if keep is None else list(keep)
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    # monotonically_increasing_id() holds the partition above bit 33 and the place below it.
    staged = materialize(
        df.repartitionByRange(parts, *order_by)
        .sortWithinPartitions(*order_by)
        .select(*columns, F.monotonically_increasing_id().alias("_place"))
        .withColumn("_part", F.shiftright("_place", 33).cast("int"))
        .withColumn("_place", F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)))
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = staged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    first = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    found = staged.join(F.broadcast(first), "_part").withColumn(
        name, F.col("_first") + F.col("_place")
    )
    if within:
        keys = list(within)
        group_before = (
            Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        )
        group_first = (
            staged.groupBy(*keys, "_part")
            .agg(F.count(F.lit(1)).alias("_n"))
            .select(
                *keys, "_part", F.coalesce(F.sum("_n").over(group_before), F.lit(0)).alias("_gf")
            )
        )
        in_part = Window.partitionBy(*keys, "_part").orderBy("_place")
        found = (
            found.withColumn("_gp", F.row_number().over(in_part) - F.lit(1))
            .join(group_first, [*keys, "_part"])
            .withColumn(within_name, F.col("_gf") + F.col("_gp"))
        )
    return found.select(*columns, name, *([within_name] if within else []))


def sum_before(
    df: DataFrame, key: str, position: str, sums: Sequence[str], block_rows: int | None, wide: str | None = None
) -> DataFrame:
    """Per ``key``, what each column of ``sums`` adds up to before a row: ``<column>_before``.

    ``position`` numbers rows densely and is unique within a key. Rows are summed inside blocks
    of ``block_rows`` positions, and the blocks' own totals are summed along the key, so a key
    holding most rows is shared by many tasks. ``wide`` names a column that is true for the keys to
    be shared; with few rows to a block the totals would be as many as the rows, so the other keys
    are one block. With ``block_rows`` None every key is, so rows bucketed by it stay where they are.
    """
    if block_rows is None:
        whole = Window.partitionBy(key).orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
        return df.select("*", *[F.coalesce(F.sum(c).over(whole), F.lit(0)).alias(f"{c}_before") for c in sums])
    block = F.floor(F.col(position) / F.lit(block_rows))
    if wide:
        block = F.when(F.col(wide), block).otherwise(F.lit(0))
    blocked = df.select("*", block.alias("_block"))
    earlier_blocks = (
        Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = (
        (blocked.where(F.col(wide)) if wide else blocked)
        .groupBy(key, "_block")
        .agg(*[F.sum(c).alias(c) for c in sums])
        .select(
            key,
            "_block",
            *[F.coalesce(F.sum(c).over(earlier_blocks), F.lit(0)).alias(f"_{c}") for c in sums],
        )
    )
    earlier_rows = (
        Window.partitionBy(key, "_block")
        .orderBy(position)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    inside = [
        F.coalesce(F.sum(c).over(earlier_rows), F.lit(0)).alias(f"{c}_before") for c in sums
    ]
    return (
        blocked.select("*", *inside)
        .join(carried, [key, "_block"], "left" if wide else "inner")
        .select(
            *df.columns,
            *[(F.col(f"{c}_before") + F.coalesce(f"_{c}", F.lit(0))).alias(f"{c}_before") for c in sums],
        )
    )


def nest(
    children: DataFrame,
    key: str,
    element: Sequence[Column],
    into: str,
    tie: Sequence[str] = (),
    part_rows: int | None = None,
) -> DataFrame:
    """Children as sorted arrays of structs: ``(key, part, into)``, in the order of the struct.

    A key's children are one array, ``part`` 0, built behind a single exchange. With ``part_rows``
    they are placed within their key, by the struct and then ``tie``, and every so many make one
    part, counted from 0: parts are bounded and follow each other, and a key with most children is
    built by many tasks.
    """
    rows = children.select(key, F.struct(*element).alias("_element"), *tie)
    if part_rows is None:
        whole = F.sort_array(F.collect_list("_element")).alias(into)
        return rows.groupBy(key).agg(whole).select(key, F.lit(0).alias("part"), into)
    order = [F.col(c) for c in (key, "_element", *tie)]
    placed = dense_index(rows, order, "_n", [key], "_at", keep=[key, "_element"])
    part = F.floor(F.col("_at") / F.lit(part_rows)).cast("int").alias("part")
    array = F.sort_array(F.collect_list("_element")).alias(into)
    return placed.select(key, part, "_element").groupBy(key, "part").agg(array)
