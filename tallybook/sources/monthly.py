"""Orders, their lines and the ledger in one folder a month (S2, S3).

Orders are laid out by whether they are still open as well, as open ones are counted whatever
their date. Rows without a date go to a folder of their own. A month is written by as many tasks
as its rows need: rows are dealt out by ranges of month, date and id, so that a busy month is
shared and a quiet one does not leave a file in every task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import DateType, IntegerType, StructField, StructType

from tallybook.functions.months import MONTH_COLUMNS, month_of
from tallybook.schemas import OPEN_STATUSES, SCHEMAS

IS_OPEN = "is_open"

# Table -> the column its months are taken from.
DATED = {
    "orders": "order_date",
    "order_items": "order_date",
    "financial_transactions": "transaction_date",
}


def partition_columns(table: str) -> list[str]:
    month = MONTH_COLUMNS[DATED[table]]
    return [IS_OPEN, month] if table == "orders" else [month]


def _open_flag() -> Column:
    """1 for an order that is not done yet; a whole number, as folder names give no booleans."""
    return F.coalesce(F.col("status").isin(*OPEN_STATUSES), F.lit(False)).cast("int").alias(IS_OPEN)


def _write(df: DataFrame, folders: list[str], order: list[str], path: str, mode: str) -> None:
    (
        df.repartitionByRange(*folders, *order)
        .sortWithinPartitions(*folders, *order)
        .write.partitionBy(*folders)
        .mode(mode)
        .parquet(path)
    )


def write_by_month(df: DataFrame, table: str, path: str, mode: str = "append") -> None:
    """Orders or ledger rows added to the months they belong to, sorted by date inside a file."""
    column = DATED[table]
    flag = [_open_flag()] if table == "orders" else []
    _write(df.select("*", *flag, month_of(column)), partition_columns(table), [column, "id"], path, mode)


def write_lines_by_month(items: DataFrame, orders: DataFrame, path: str, mode: str = "append") -> None:
    """Order lines added to the month of their order; those of no known order to the undated ones."""
    months = orders.select(F.col("id").alias("order_id"), month_of("order_date"))
    found = items.join(months, "order_id", "left").select(*items.columns, MONTH_COLUMNS["order_date"])
    _write(found, partition_columns("order_items"), ["order_id"], path, mode)


def read_by_month(
    spark: SparkSession, table: str, path: str, columns: StructType | None = None
) -> DataFrame:
    """The table with its folders as further columns. ``columns`` (default: the declared ones) is
    what the files hold; it is given and not looked up, so an empty table is read as well."""
    held = SCHEMAS[table] if columns is None else columns
    kinds = [IntegerType() if c == IS_OPEN else DateType() for c in partition_columns(table)]
    folders = [StructField(c, kind) for c, kind in zip(partition_columns(table), kinds)]
    return spark.read.schema(StructType([*held.fields, *folders])).parquet(path)
