"""Incremental landing of the transaction feed: an extension beside the daily batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from perkline.sources.schemas import CORRUPT, FEEDS
from perkline.sources.storage import join_uri


def stream_transactions(spark: SparkSession, landing: str, late: str = "2 days", files_per_trigger: int = 1000) -> DataFrame:
    """New landing files as a stream of parseable rows, re-deliveries within `late` of a row's own time dropped.

    State is one entry per identifier for the span of the watermark, not for all time."""
    feed = FEEDS["transactions"]
    raw = spark.readStream.schema(feed.schema).option("maxFilesPerTrigger", files_per_trigger).option("columnNameOfCorruptRecord", CORRUPT).json(join_uri(landing, "transactions"))
    rows = raw.where(F.col(CORRUPT).isNull() & F.col("txn_id").isNotNull()).drop(CORRUPT)
    rows = rows.select(*[c for c in feed.schema.names if c != CORRUPT]).withColumn("event_time", F.col("txn_ts").try_cast("timestamp"))
    return rows.withWatermark("event_time", late).dropDuplicatesWithinWatermark(["txn_id"])


def land_available(rows: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Appends what has landed since the last run to `table`, partitioned by day, and stops."""
    dated = rows.withColumn("ingest_date", F.to_date("event_time"))
    return dated.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).partitionBy("ingest_date").trigger(availableNow=True).start()
