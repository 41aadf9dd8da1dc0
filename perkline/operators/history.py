"""Type-2 history from periodic snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perkline.functions.clean import FAR_FUTURE


def versions(snapshots: DataFrame, key: str, as_of: str, tracked: Sequence[str]) -> DataFrame:
    """One row per stretch of snapshots with equal tracked values: key, version_no, tracked..., valid_from, valid_to
    (inclusive; far future if open), is_current, last_seen_date.

    `snapshots` has one row per key and date. Values are compared as they are, NULL equal to NULL; a return to an
    earlier value is a new version; a missing day opens none. One shuffle on the key serves all windows and the
    aggregation that follows them."""
    along = Window.partitionBy(key).orderBy(as_of)
    state = F.struct(*tracked)
    seen = snapshots.select(key, as_of, *tracked).withColumn("_before", F.lag(state).over(along)).withColumn("_first", F.row_number().over(along) == 1)
    changed = F.when(F.col("_first") | ~F.col("_before").eqNullSafe(state), 1).otherwise(0)
    numbered = seen.withColumn("version_no", F.sum(changed).over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    held = numbered.groupBy(key, "version_no").agg(*[F.any_value(c).alias(c) for c in tracked], F.min(as_of).alias("valid_from"), F.max(as_of).alias("last_seen_date"))
    nxt = F.lead("valid_from").over(Window.partitionBy(key).orderBy("version_no"))
    bounded = held.withColumn("_next", nxt)
    return bounded.select(
        key, "version_no", *tracked, "valid_from",
        F.coalesce(F.date_sub("_next", 1), F.lit(FAR_FUTURE).cast("date")).alias("valid_to"),
        F.col("_next").isNull().alias("is_current"), "last_seen_date",
    )


def digest(*cols: str) -> Column:
    """md5 over the columns' text, NULL as empty, joined by two bars."""
    return F.md5(F.concat_ws("||", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]).cast("binary"))
