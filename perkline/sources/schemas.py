"""Declared schemas of the landing feeds. Nothing is inferred."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql.types import StructType

CORRUPT = "_corrupt_record"


@dataclass(frozen=True)
class Feed:
    """A landing feed: its format, columns, natural key, and whether each day lands in a directory of its own."""

    name: str
    format: str
    ddl: str
    key: tuple[str, ...]
    daily: bool = False

    @property
    def schema(self) -> StructType:
        extra = f", {CORRUPT} string" if self.format == "json" else ""
        return StructType.fromDDL(self.ddl + extra)


# Names and types of the feeds' columns.
FEEDS = {
    f.name: f
    for f in (
        Feed("transactions", "json", "txn_id string, member_id string, card_id string, merchant_id string, mcc string, amount double, currency string, txn_ts string, status string, is_refund boolean, channel string, source_system string", ("txn_id",), daily=True),
        Feed("cards", "csv", "card_id string, product_name string, issuer string, network string, annual_fee_usd double, base_earn_rate double, point_value_cents double, snapshot_date date", ("card_id",)),
        Feed("merchants", "csv", "merchant_id string, merchant_name string, mcc string, category string, country string", ("merchant_id",)),
        Feed("reward_rules", "json", "rule_id string, card_id string, category string, multiplier double, monthly_cap_usd double, effective_from string, effective_to string", ("rule_id",)),
        Feed("fx_rates", "csv", "rate_date date, currency string, usd_rate double", ("rate_date", "currency")),
    )
}
TRACKED = ("product_name", "issuer", "network", "annual_fee_usd", "base_earn_rate", "point_value_cents")
