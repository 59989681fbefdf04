"""All named queries in one place."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from tallybook.plans import layouts, report_sql, reports, streams, write_sql, writes
from tallybook.session import configure
from tallybook.sources.bindings import Bindings

QUERIES = {**reports.QUERIES, **writes.QUERIES, **streams.QUERIES, **layouts.QUERIES}
SQL = {**report_sql.SQL, **write_sql.SQL, **write_sql.STREAM_SQL, **layouts.SQL}


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES[name](Bindings(configure(spark), sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: partial(run, name) for name in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
