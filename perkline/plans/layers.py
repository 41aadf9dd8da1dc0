"""The three stages of a run: read, compute, publish, check, report."""

from __future__ import annotations

from datetime import UTC, date, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perkline.operators.validate import reason_histogram, split_valid
from perkline.plans import gold, silver
from perkline.quality import gate
from perkline.settings import Settings
from perkline.sources.schemas import CORRUPT, FEEDS
from perkline.sources.storage import Published, append_manifest, join_uri, new_batch_id, publish, quarantine, read_feed, read_table, with_lineage

PARTITIONS = {"bronze.transactions": ["ingest_date"], "silver.transactions": ["ingest_date"], "gold.transaction_rewards": ["month"]}
QUARANTINED = (CORRUPT, "_batch_id", "_source_file", "_ingested_at")


def _lookup(spark: SparkSession, s: Settings):
    return lambda name: read_table(spark, s.warehouse, *name.split(".", 1))


def _publish(spark: SparkSession, s: Settings, name: str, df: DataFrame, incremental: bool = False) -> Published:
    layer, table = name.split(".", 1)
    return publish(df, join_uri(s.warehouse, layer, table), PARTITIONS.get(name, ()), incremental, gate(name, s.checks(name), s.reports, _lookup(spark, s), s.default_severity))


def _manifest(s: Settings, stage: str, day: str, began: datetime, tables: list[dict[str, Any]]) -> dict[str, Any]:
    record = {"stage": stage, "logical_date": day, "started_at": began.isoformat(), "finished_at": datetime.now(UTC).isoformat(), "environment": s.environment, "tables": tables}
    append_manifest(s.reports, day, record)
    return record


def run_bronze(spark: SparkSession, s: Settings, day: str | None = None) -> dict[str, Any]:
    """Lands every feed as it is, with lineage; malformed lines go to quarantine. A rerun of a day replaces the day."""
    day, began, batch = day or date.today().isoformat(), datetime.now(UTC), new_batch_id()
    told = []
    for name in s.tables("bronze"):
        feed = FEEDS[name]
        raw = with_lineage(read_feed(spark, s.landing, name, day), name, batch)
        if feed.daily:
            raw = raw.withColumn("ingest_date", F.lit(day).cast("date"))
        raw = raw.persist()  # read by the split, the gate and the counts; Spark refuses queries over the corrupt column alone
        try:
            good, broken = raw, 0
            if CORRUPT in raw.columns:
                good, bad = raw.where(F.col(CORRUPT).isNull()), raw.where(F.col(CORRUPT).isNotNull())
                # by logical day, so that a rerun replaces what it had rejected before
                broken = quarantine(bad.select(*QUARANTINED).withColumn("logical_date", F.lit(day)), s.quarantine_path(f"bronze_{name}"), "logical_date")
            gate(f"bronze.{name}", s.checks(f"bronze.{name}"), s.reports, _lookup(spark, s), s.default_severity)(raw)
            rows = publish(good, join_uri(s.warehouse, "bronze", name), PARTITIONS.get(f"bronze.{name}", ()), incremental=feed.daily).rows
            told.append({"table": f"bronze.{name}", "rows": rows, "quarantined": broken})
        finally:
            raw.unpersist()
    return _manifest(s, "bronze", day, began, told)


def run_silver(spark: SparkSession, s: Settings, day: str | None = None) -> dict[str, Any]:
    """Rebuilds the conformed tables from all of bronze; rejected transactions go to quarantine with their reason."""
    day, began = day or date.today().isoformat(), datetime.now(UTC)
    raw = lambda t: read_table(spark, s.warehouse, "bronze", t)
    told = []
    for name, build in (("fx_rates", silver.fx_rates), ("merchants", silver.merchants), ("reward_rules", silver.reward_rules), ("cards", silver.cards)):
        told.append({"table": f"silver.{name}", "rows": _publish(spark, s, f"silver.{name}", build(raw(name))).rows})
    tagged = silver.transactions(raw("transactions"), read_table(spark, s.warehouse, "silver", "fx_rates")).persist()
    try:
        valid, rejected = split_valid(tagged)
        publish(rejected, s.quarantine_path("silver_transactions"), ["_reject_reason"])
        reasons = {r["_reject_reason"]: r["count"] for r in reason_histogram(rejected).collect()}
        rows = _publish(spark, s, "silver.transactions", valid).rows
        told.append({"table": "silver.transactions", "rows": rows, "rejected": sum(reasons.values()), "reasons": reasons})
    finally:
        tagged.unpersist()
    return _manifest(s, "silver", day, began, told)


def run_gold(spark: SparkSession, s: Settings, day: str | None = None) -> dict[str, Any]:
    """Rebuilds the marts; the reward fact is written once and read by the three others."""
    day, began = day or date.today().isoformat(), datetime.now(UTC)
    table = lambda layer, t: read_table(spark, s.warehouse, layer, t)
    steps = {
        "transaction_rewards": lambda: gold.transaction_rewards(*(table("silver", t) for t in ("transactions", "merchants", "cards", "reward_rules")), negatives_free_room=bool(s.raw.get("rewards", {}).get("negatives_free_room", False))),
        "card_roi_monthly": lambda: gold.card_roi_monthly(table("gold", "transaction_rewards"), table("silver", "transactions")),
        "merchant_category_spend": lambda: gold.merchant_category_spend(table("gold", "transaction_rewards")),
        "member_rewards_summary": lambda: gold.member_rewards_summary(table("gold", "transaction_rewards"), table("gold", "card_roi_monthly")),
    }
    told = []
    for name in s.tables("gold"):
        told.append({"table": f"gold.{name}", "rows": _publish(spark, s, f"gold.{name}", steps[name]()).rows})
    return _manifest(s, "gold", day, began, told)


STAGES = {"bronze": run_bronze, "silver": run_silver, "gold": run_gold}
