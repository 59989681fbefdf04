"""Used-oil recycling figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallybook.functions.clock import Moment, as_date, date_lit, period_bounds
from tallybook.functions.rows import money

# Kg of CO2 and litres of water saved per litre of oil.
CO2_PER_LITRE = 1.5
WATER_PER_LITRE = 25000


def oil_impact(disposals: DataFrame, as_of: Moment, same_year: bool = False) -> DataFrame:
    """Oil recycled in the month of ``as_of`` and what that saved.

    The month counts in every year; ``same_year`` keeps to the year of ``as_of``.
    """
    day = F.col("disposal_date")
    if same_year:
        start, end = period_bounds(as_of, "month")
        wanted = (day >= date_lit(start)) & (day < date_lit(end))
    else:
        wanted = F.month(day) == as_date(as_of).month
    return (
        disposals.where(wanted)
        .agg(money(F.col("amount")).alias("totalOil"))
        .select(
            "totalOil",
            (F.col("totalOil") * CO2_PER_LITRE).alias("co2Saved"),
            (F.col("totalOil") * WATER_PER_LITRE).alias("waterSaved"),
        )
    )


def recent_disposals(disposals: DataFrame, n: int = 10) -> DataFrame:
    return (
        disposals.select(
            "id", "product", F.col("amount").cast("double").alias("amount"), "disposal_date", "notes"
        )
        .orderBy(F.desc("disposal_date"), F.desc("id"))
        .limit(n)
    )
