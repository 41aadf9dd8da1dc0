"""Joins of facts to dimensions that hold for a time, and to the best of several rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def asof_join(facts: DataFrame, dim: DataFrame, key: str, at: str, start: str, end: str, take: Sequence[str]) -> DataFrame:
    """Left join to the version of `key` in force at `at` (both ends inclusive). With disjoint intervals the number of
    facts does not change. The equality on the key makes it a hash or merge join; the interval is its residual."""
    d = dim.select(F.col(key).alias("_key"), F.col(start).alias("_from"), F.col(end).alias("_to"), *take)
    return facts.join(d, (F.col(key) == F.col("_key")) & F.col(at).between(F.col("_from"), F.col("_to")), "left").drop("_key", "_from", "_to")


def best_match(facts: DataFrame, rules: DataFrame, on: Sequence[str], at: str, start: str, end: str, highest: str, tie: str, take: Sequence[str]) -> DataFrame:
    """Left join to one rule per fact: among those equal on `on` and in force at `at` (NULL end: open; NULL start:
    never), the one with the highest `highest` (NULLs last), then the smallest `tie`.

    The rules of a key are gathered into one sorted array, so facts meet at most one row and are neither multiplied
    nor shuffled again to pick the winner; the array of a key is as long as the key has rules."""
    order = F.struct(F.col(highest).isNull().alias("none"), (-F.col(highest)).alias("down"), F.col(tie).alias("tie"), F.col(start).alias("since"), F.col(end).alias("till"), *[F.col(c).alias(f"v_{c}") for c in take])
    packed = rules.where(F.col(start).isNotNull()).groupBy(*[F.col(c).alias(f"_on{i}") for i, c in enumerate(on)]).agg(F.array_sort(F.collect_list(order)).alias("_rules"))
    equal: Column = F.lit(True)
    for i, c in enumerate(on):
        equal = equal & (F.col(c) == F.col(f"_on{i}"))
    met = facts.join(packed, equal, "left")
    live = F.filter("_rules", lambda r: (F.col(at) >= r["since"]) & (r["till"].isNull() | (F.col(at) <= r["till"])))
    best = met.withColumn("_best", F.try_element_at(live, F.lit(1)))
    return best.select(*[F.col(f"`{c}`") for c in facts.columns], *[F.col("_best")[f"v_{c}"].alias(c) for c in take])


def orphans(df: DataFrame, column: str, ref: DataFrame, ref_column: str) -> DataFrame:
    """Distinct non-null values of `column` that `ref_column` does not have."""
    return df.select(F.col(column).alias("value")).where("value is not null").distinct().join(ref.select(F.col(ref_column).alias("value")).distinct(), "value", "left_anti")
