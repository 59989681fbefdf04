"""Typed reading of the back-office tables, writing of rows, snapshots and documents."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from tallybook.schemas import DEFAULTS, ENUMS, SCHEMAS


def typed_columns(df: DataFrame, table: str) -> list[Column]:
    """The declared columns taken from ``df``; a missing optional column takes its default.

    A value that cannot be cast becomes NULL, which ``violations`` then reports.
    """
    defaults = DEFAULTS.get(table, {})
    present = set(df.columns)
    picked = []
    for field in SCHEMAS[table]:
        if field.name in present:
            value = F.col(field.name).try_cast(field.dataType)
        elif field.name in defaults or field.nullable:
            value = F.lit(defaults.get(field.name)).cast(field.dataType)
        else:
            raise ValueError(f"{table}: required column {field.name!r} is missing")
        picked.append(value.alias(field.name))
    return picked


def conform(df: DataFrame, table: str) -> DataFrame:
    """Project and cast a frame to the declared columns of a table."""
    return df.select(*typed_columns(df, table))


def first_violation(table: str, columns: list[str] | None = None) -> Column:
    """Why a row does not fit the table: 'missing:<col>', 'invalid:<col>', or NULL if it does."""
    enums = ENUMS.get(table, {})
    checks: list[Column] = []
    for field in SCHEMAS[table]:
        if field.name == "id" or (columns is not None and field.name not in columns):
            continue
        value = F.col(field.name)
        if not field.nullable:
            checks.append(F.when(value.isNull(), F.lit(f"missing:{field.name}")))
        if field.name in enums:
            allowed = value.isNull() | value.isin(*enums[field.name])
            checks.append(F.when(~allowed, F.lit(f"invalid:{field.name}")))
    return F.coalesce(*checks, F.lit(None).cast("string"))


def violations(df: DataFrame, table: str) -> DataFrame:
    """Rows outside the declared schema, with the first reason."""
    return df.withColumn("reason", first_violation(table)).where(F.col("reason").isNotNull())


def read_table(
    spark: SparkSession, table: str, path: str, fmt: str = "parquet", **options: str
) -> DataFrame:
    """Read one table from Parquet, CSV or JSON files.

    Parquet carries its own types and is cast; CSV and JSON are read with the declared schema.
    """
    reader = spark.read.format(fmt).options(**options)
    if fmt in ("csv", "json"):
        reader = reader.schema(SCHEMAS[table])
    return conform(reader.load(path), table)


def read_table_jdbc(
    spark: SparkSession,
    table: str,
    url: str,
    lower: int,
    upper: int,
    partitions: int,
    **options: str,
) -> DataFrame:
    """Read one table from a database, split on ``id`` so that tasks read disjoint key ranges."""
    reader = spark.read.format("jdbc").options(
        url=url,
        dbtable=table,
        partitionColumn="id",
        lowerBound=lower,
        upperBound=upper,
        numPartitions=partitions,
    )
    return conform(reader.options(**options).load(), table)


def load_tables(
    spark: SparkSession, locations: Mapping[str, str], fmt: str = "parquet", **options: str
) -> dict[str, DataFrame]:
    return {name: read_table(spark, name, path, fmt, **options) for name, path in locations.items()}


def append_rows(rows: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Add rows to a table's files."""
    rows.write.format(fmt).mode("append").save(path)


def write_snapshot(tables: Mapping[str, DataFrame], root: str, version: str) -> dict[str, str]:
    """Write the tables as a new version beside the older ones; readers of those are undisturbed.

    Plain files have no in-place update, so a change is a new version of the table.
    """
    paths = {name: f"{root}/{name}/version={version}" for name in tables}
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(paths[name])
    return paths


def read_snapshot(spark: SparkSession, root: str, version: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{root}/{n}/version={version}") for n in names}


def to_json_documents(df: DataFrame) -> DataFrame:
    """One JSON document per row, nested arrays and explicit nulls included."""
    packed = F.struct(*[F.col(c) for c in df.columns])
    return df.select(F.to_json(packed, {"ignoreNullFields": "false"}).alias("json"))


def write_json_documents(df: DataFrame, path: str) -> None:
    df.write.option("ignoreNullFields", "false").json(path)


def read_json_documents(spark: SparkSession, path: str, columns: StructType) -> DataFrame:
    """JSON lines, nested arrays included, in the given columns; a line that does not fit is an error."""
    return spark.read.schema(columns).option("mode", "FAILFAST").json(path)


def json_values(documents: DataFrame, values: Mapping[str, tuple[str, str]], json: str = "json") -> DataFrame:
    """Values picked out of documents whose form is not declared: name -> (path, type).

    A path such as ``$.items[0].product`` that a document lacks, a value that is not of the type
    and text that is no JSON give NULL. An array may be taken whole, as ``array<variant>`` or an
    array of structs. The text is parsed once, whatever is picked.
    """
    parsed = documents.withColumn("_document", F.try_parse_json(F.col(json)))
    picked = [F.try_variant_get("_document", path, kind).alias(name) for name, (path, kind) in values.items()]
    return parsed.select(*documents.columns, *picked)
