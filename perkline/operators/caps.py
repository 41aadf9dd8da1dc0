"""Allocation of amounts up to a cap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def allocate_capped(df: DataFrame, part: Sequence[str], order: Sequence[str | Column], amount: str, cap: str, applies: Column, out: str = "bonus_eligible_usd", clamp_negative: bool = True) -> DataFrame:
    """Adds `out`: how much of each amount still fits under the cap of its partition, in order.

    Where `applies` does not hold: 0. Without a cap: the amount. Else the remainder: the row that crosses the cap gets
    what is left, later rows 0. With `clamp_negative`, negative amounts neither use nor free room; without, they free
    it. Rows need a total `order`. Only rows with a cap take part in the running sum, so uncapped ones cannot make a
    partition large."""
    counted = F.col(amount)
    counted = F.greatest(counted, F.lit(0).cast(df.schema[amount].dataType)) if clamp_negative else counted
    capped = applies & F.col(cap).isNotNull()
    # rows that need no running sum go to partitions of their own row, not to one of their key
    spread = F.when(capped, F.lit(0)).otherwise(F.xxhash64(*[F.col(c) if isinstance(c, str) else c for c in order]))
    before = Window.partitionBy(*part, "_spread").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    used = df.withColumn("_spread", spread).withColumn("_used", F.coalesce(F.sum(counted).over(before), F.lit(0)))
    zero = F.lit(0).cast(df.schema[amount].dataType)
    room = F.greatest(zero, F.least(F.col(amount), F.col(cap) - F.col("_used")))
    return used.withColumn(out, F.when(~applies, zero).when(F.col(cap).isNull(), F.col(amount)).otherwise(room)).drop("_spread", "_used")
