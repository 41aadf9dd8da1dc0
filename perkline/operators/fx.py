"""Conversion of signed amounts at the rate of a date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def convert_signed(df: DataFrame, rates: DataFrame, currency: str, on_date: str, amount: str, negate: Column, out: str = "amount_usd", rate: str = "usd_rate", rate_date: str = "rate_date", rate_currency: str = "currency", places: int = 2) -> DataFrame:
    """Adds `rate` and `out` = round(amount * rate, with its sign turned where `negate` holds). A missing rate or
    amount gives NULL. `rates` must have one row per currency and date; Spark broadcasts it when it is small."""
    r = rates.select(F.col(rate_currency).alias("_c"), F.col(rate_date).alias("_d"), F.col(rate))
    met = df.join(r, (F.col(currency) == F.col("_c")) & (F.col(on_date) == F.col("_d")), "left").drop("_c", "_d")
    converted = F.col(amount) * F.col(rate)
    return met.withColumn(out, F.round(F.when(negate, -converted).otherwise(converted), places))
