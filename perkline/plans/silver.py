"""Conformed tables from raw ones. Each function takes and returns frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perkline.functions.clean import tidy, tidy_columns, typed
from perkline.operators.dedup import latest_by
from perkline.operators.fx import convert_signed
from perkline.operators.history import digest, versions
from perkline.operators.validate import tag_rejects
from perkline.sources.schemas import TRACKED

STATUSES = ("settled", "refunded")


def _newest(df: DataFrame, *extra: str):
    """The newest delivery first, then by file as far as the frame has these columns, then by the named ones, so that
    deliveries of one batch tie no more."""
    have = [c for c in ("_ingested_at", "_source_file") if c in df.columns]
    return [F.col(c).desc() for c in have] + [F.col(c).desc_nulls_last() for c in extra]


def fx_rates(raw: DataFrame) -> DataFrame:
    rows = raw.withColumn("currency", tidy("currency", "upper")).withColumn("usd_rate", typed("usd_rate", "double"))
    return latest_by(rows, ["rate_date", "currency"], _newest(rows, "usd_rate")).select("rate_date", "currency", "usd_rate")


def merchants(raw: DataFrame) -> DataFrame:
    rows = tidy_columns(raw, {"merchant_name": "title", "mcc": "code4", "category": "lower", "country": "upper"})
    return latest_by(rows, ["merchant_id"], _newest(rows, "merchant_name", "category")).select("merchant_id", "merchant_name", "mcc", "category", "country")


def reward_rules(raw: DataFrame) -> DataFrame:
    kinds = {"multiplier": "double", "monthly_cap_usd": "double", "effective_from": "date", "effective_to": "date"}
    rows = raw.where("card_id is not null").withColumn("category", tidy("category", "lower")).withColumns({c: typed(c, k) for c, k in kinds.items()})
    return latest_by(rows, ["rule_id"], _newest(rows, *kinds)).select("rule_id", "card_id", "category", *kinds)


def cards(raw: DataFrame) -> DataFrame:
    """Versions of each card from its daily snapshots."""
    rows = tidy_columns(raw, {"product_name": "plain", "issuer": "plain", "network": "lower"}).withColumns({c: typed(c, "double") for c in TRACKED[3:]})
    daily = latest_by(rows, ["card_id", "snapshot_date"], _newest(rows, *TRACKED))
    held = versions(daily, "card_id", "snapshot_date", TRACKED)
    return held.select(
        F.md5(F.concat_ws("||", "card_id", F.col("valid_from").cast("string")).cast("binary")).alias("card_sk"), "card_id", *TRACKED, "version_no",
        digest(*TRACKED).alias("attr_hash"), "valid_from", "valid_to", "is_current", "last_seen_date",
    )


def transactions(raw: DataFrame, rates: DataFrame) -> DataFrame:
    """All deliveries reduced to one row each and converted, with `_reject_reason` (NULL: valid) and `_is_valid`.

    Rows without an identifier are not reduced: each is rejected on its own, so none is lost unseen."""
    one = latest_by(raw, ["txn_id"], _newest(raw, "txn_ts", "amount", "status"), keep_null_keys=True)
    clean = tidy_columns(one, {"mcc": "code4", "currency": "upper", "status": "lower", "channel": "lower"})
    clean = clean.withColumns({"amount": typed("amount", "double"), "txn_ts": typed("txn_ts", "timestamp"), "is_refund": F.coalesce("is_refund", F.lit(False))})
    clean = clean.withColumn("txn_date", F.col("txn_ts").cast("date"))
    valued = convert_signed(clean, rates, "currency", "txn_date", "amount", F.col("is_refund"))
    tagged = tag_rejects(
        valued,
        [
            ("missing_txn_id", F.col("txn_id").isNull()),
            ("missing_entity_key", F.col("member_id").isNull() | F.col("card_id").isNull()),
            ("missing_amount", F.col("amount").isNull()),
            ("unparseable_timestamp", F.col("txn_ts").isNull()),
            ("unknown_currency", F.col("usd_rate").isNull()),
            ("missing_status", F.col("status").isNull()),
            ("unknown_status", ~F.col("status").isin(*STATUSES)),
        ],
    )
    return tagged.select(
        "txn_id", "member_id", "card_id", "merchant_id", "mcc", "amount", "currency", "usd_rate", "amount_usd", "txn_ts", "txn_date", "status", "is_refund",
        "channel", "source_system", "ingest_date", "_batch_id", "_ingested_at", "_reject_reason", "_is_valid",
    )
