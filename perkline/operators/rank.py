"""Shares, ranks and the top row per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perkline.functions.clean import ratio


def share_of(df: DataFrame, part: Sequence[str], measure: str, out: str, scale: float = 100.0, places: int | None = 2) -> DataFrame:
    """Adds each row's share of its partition's sum; NULL where that is 0. For aggregated frames: one row per group."""
    return df.withColumn(out, ratio(measure, F.sum(measure).over(Window.partitionBy(*part)), scale, places))


def rank_by(df: DataFrame, part: Sequence[str], order: Sequence[Column], out: str) -> DataFrame:
    """Adds the rank with gaps after ties."""
    return df.withColumn(out, F.rank().over(Window.partitionBy(*part).orderBy(*order)))


def top1_by(df: DataFrame, part: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row per group; end the order with a tie-breaker."""
    w = Window.partitionBy(*part).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
