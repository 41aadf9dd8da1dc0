"""One row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perkline.functions.clean import as_col


def latest_by(df: DataFrame, keys: Sequence[str | Column], newest_first: Sequence[Column], keep_null_keys: bool = False) -> DataFrame:
    """The first row of each key in the given order, which should be unique within a key.

    Rows with a NULL key part are dropped, or kept one and all with `keep_null_keys` (so that validation can name
    them). `row_number() = 1` lets Spark cut each map task's groups to one row before the shuffle."""
    cols = [as_col(k) for k in keys]
    whole = F.lit(True)
    for c in cols:
        whole = whole & c.isNotNull()
    named = [c.alias(f"_k{i}") for i, c in enumerate(cols)]
    ranked = df.where(whole).select("*", *named)
    order = Window.partitionBy(*[f"_k{i}" for i in range(len(cols))]).orderBy(*newest_first)
    one = ranked.withColumn("_n", F.row_number().over(order)).where("_n = 1").select(*df.columns)
    return one.unionByName(df.where(~whole)) if keep_null_keys else one
