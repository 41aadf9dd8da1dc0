"""Ordered validation with one reason per row, and the split into valid and rejected rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_failing(rules: Sequence[tuple[str, Column]]) -> Column:
    """The name of the first rule whose condition holds; NULL if none does. An unknown condition does not count, so
    rules must be written to be true on NULL where that is meant."""
    reason = F
    for name, condition in rules:
        reason = reason.when(condition, F.lit(name))
    return reason.otherwise(F.lit(None).cast("string"))


def tag_rejects(df: DataFrame, rules: Sequence[tuple[str, Column]], reason: str = "_reject_reason") -> DataFrame:
    return df.withColumn(reason, first_failing(rules)).withColumn("_is_valid", F.col(reason).isNull())


def split_valid(df: DataFrame, reason: str = "_reject_reason") -> tuple[DataFrame, DataFrame]:
    """(valid rows without the helper columns, rejected rows with their reason); together they are the input."""
    return df.where(F.col(reason).isNull()).drop(reason, "_is_valid"), df.where(F.col(reason).isNotNull()).drop("_is_valid")


def reason_histogram(rejected: DataFrame, reason: str = "_reject_reason") -> DataFrame:
    return rejected.groupBy(reason).count().orderBy(F.col("count").desc(), reason)
