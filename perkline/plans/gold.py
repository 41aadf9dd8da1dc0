"""Rewards and marts from conformed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perkline.functions.clean import cents, month_of, ratio
from perkline.operators.caps import allocate_capped
from perkline.operators.match import asof_join, best_match
from perkline.operators.rank import rank_by, share_of, top1_by

BASE_RULE = "BASE_EARN"
#: Lifetime spend from which a tier holds, highest first.
TIERS = ((20000, "platinum"), (8000, "gold"), (2000, "silver"))
REWARD_COLUMNS = (
    "txn_id", "member_id", "card_id", "card_sk", "product_name", "issuer", "network", "merchant_id", "merchant_name", "category", "mcc", "country", "channel", "txn_ts",
    "txn_date", "month", "amount_usd", "rule_id", "base_earn_rate", "applied_multiplier", "bonus_eligible_usd", "points_earned", "point_value_cents", "reward_value_usd", "annual_fee_usd",
)


def transaction_rewards(transactions: DataFrame, merchants: DataFrame, cards: DataFrame, rules: DataFrame, negatives_free_room: bool = False) -> DataFrame:
    """Points of every settled transaction: base rate on the amount, bonus multiplier on what fits under the cap.

    With `negatives_free_room`, a negative amount gives room under the cap back to later ones."""
    settled = transactions.where(F.col("status") == "settled").withColumn("month", month_of("txn_ts"))
    shops = merchants.select(F.col("merchant_id").alias("_shop"), "merchant_name", "category", "country")
    rich = settled.join(shops, F.col("merchant_id") == F.col("_shop"), "left").drop("_shop")
    terms = ["card_sk", "product_name", "issuer", "network", "annual_fee_usd", "base_earn_rate", "point_value_cents"]
    rich = asof_join(rich, cards, "card_id", "txn_date", "valid_from", "valid_to", terms)
    rich = rich.withColumns({c: F.coalesce(c, F.lit(1.0)) for c in ("base_earn_rate", "point_value_cents")})
    ruled = best_match(rich, rules, ["card_id", "category"], "txn_date", "effective_from", "effective_to", "multiplier", "rule_id", ["rule_id", "multiplier", "monthly_cap_usd"])
    shared = allocate_capped(ruled, ["member_id", "card_id", "month", "rule_id"], ["txn_ts", "txn_id"], "amount_usd", "monthly_cap_usd", F.col("rule_id").isNotNull(), clamp_negative=not negatives_free_room)
    return scored(shared).select(*REWARD_COLUMNS)


def scored(df: DataFrame) -> DataFrame:
    """Multiplier, points and their value, from amount, base rate, eligible part and rule."""
    applied = F.coalesce("multiplier", "base_earn_rate")
    points = F.col("amount_usd") * F.col("base_earn_rate") + F.col("bonus_eligible_usd") * (applied - F.col("base_earn_rate"))
    out = df.withColumn("applied_multiplier", applied).withColumn("points_earned", cents(points))
    return out.withColumns({"rule_id": F.coalesce("rule_id", F.lit(BASE_RULE)), "bonus_eligible_usd": cents("bonus_eligible_usd"), "reward_value_usd": cents(F.col("points_earned") * F.col("point_value_cents") / 100)})


def card_roi_monthly(rewards: DataFrame, transactions: DataFrame) -> DataFrame:
    """Rewards against the fee, by member, card and month. Months with refunds alone have no row."""
    by = ["member_id", "card_id", "month"]
    earned = rewards.groupBy(*by).agg(
        *[F.max(c).alias(c) for c in ("product_name", "issuer", "annual_fee_usd")], F.count("*").alias("txn_count"), F.countDistinct("merchant_id").alias("merchant_count"),
        F.sum("amount_usd").alias("spend"), F.sum("points_earned").alias("points"), F.sum("reward_value_usd").alias("value"),
        F.sum(F.when(F.col("rule_id") != BASE_RULE, F.col("amount_usd")).otherwise(0)).alias("bonus"),
    )
    back = transactions.where(F.col("status") == "refunded").groupBy("member_id", "card_id", month_of("txn_ts").alias("month")).agg(F.sum("amount_usd").alias("back"))
    both = earned.join(back, by, "left").withColumns({"back": F.coalesce("back", F.lit(0)), "annual_fee_usd": F.coalesce("annual_fee_usd", F.lit(0.0))})
    told = both.select(
        "member_id", "card_id", "product_name", "issuer", "month", "txn_count", "merchant_count", cents("spend").alias("spend_usd"), cents("back").alias("refund_usd"),
        cents(F.col("spend") + F.col("back")).alias("net_spend_usd"), cents("bonus").alias("bonus_category_spend_usd"), cents("points").alias("points_earned"),
        cents("value").alias("reward_value_usd"), "annual_fee_usd", cents(F.col("annual_fee_usd") / 12).alias("monthly_fee_usd"),
    )
    told = told.withColumn("net_value_usd", cents(F.col("reward_value_usd") - F.col("monthly_fee_usd")))
    told = told.withColumns(
        {
            "roi_ratio": F.when(F.col("monthly_fee_usd") > 0, ratio("reward_value_usd", "monthly_fee_usd", 1, 3)),
            "effective_return_pct": ratio("reward_value_usd", "spend_usd", 100, 3),
            "bonus_spend_share_pct": ratio("bonus_category_spend_usd", "spend_usd", 100, 2),
            "fee_verdict": F.when((F.col("net_value_usd") >= 0) | (F.col("monthly_fee_usd") == 0), "keep").otherwise("review"),
        }
    )
    return rank_by(told, ["month"], [F.col("net_value_usd").desc()], "month_value_rank")


def merchant_category_spend(rewards: DataFrame) -> DataFrame:
    """Spend by month and category; share and rank come from the aggregated rows."""
    sums = rewards.where("category is not null").groupBy("month", "category").agg(
        F.count("*").alias("txn_count"), F.countDistinct("member_id").alias("member_count"), F.countDistinct("merchant_id").alias("merchant_count"),
        F.sum("amount_usd").alias("spend"), F.sum("points_earned").alias("points"), F.sum("reward_value_usd").alias("value"),
    )
    ranked = rank_by(share_of(sums, ["month"], "spend", "pct_of_month_spend"), ["month"], [F.col("spend").desc()], "spend_rank")
    return ranked.select(
        "month", "category", "txn_count", "member_count", "merchant_count", cents("spend").alias("spend_usd"), ratio("spend", "txn_count", 1, 2).alias("avg_ticket_usd"),
        cents("points").alias("points_earned"), cents("value").alias("reward_value_usd"), ratio("value", "spend", 100, 3).alias("effective_return_pct"), "pct_of_month_spend", "spend_rank",
    )


def top_category(rewards: DataFrame) -> DataFrame:
    sums = rewards.where("category is not null").groupBy("member_id", "category").agg(F.sum("amount_usd").alias("spend"))
    best = top1_by(sums, ["member_id"], [F.col("spend").desc(), F.col("category")])
    return best.select("member_id", F.col("category").alias("top_category"), cents("spend").alias("top_category_spend_usd"))


def best_card(roi: DataFrame) -> DataFrame:
    """The card that brought most over all months; its name is that of the last month."""
    sums = roi.groupBy("member_id", "card_id").agg(F.sum("net_value_usd").alias("net"), F.max_by("product_name", "month").alias("product"))
    best = top1_by(sums, ["member_id"], [F.col("net").desc(), F.col("card_id")])
    return best.select("member_id", F.col("card_id").alias("best_card_id"), F.col("product").alias("best_card_product"), cents("net").alias("best_card_net_value_usd"))


def member_rewards_summary(rewards: DataFrame, roi: DataFrame) -> DataFrame:
    whole = rewards.groupBy("member_id").agg(
        F.count("*").alias("txn_count"), F.countDistinct("card_id").alias("card_count"), F.countDistinct("month").alias("active_months"),
        cents(F.sum("amount_usd")).alias("lifetime_spend_usd"), cents(F.sum("points_earned")).alias("lifetime_points"), cents(F.sum("reward_value_usd")).alias("lifetime_reward_usd"),
        F.min("txn_date").alias("first_txn_date"), F.max("txn_date").alias("last_txn_date"),
    ).withColumn("effective_return_pct", ratio("lifetime_reward_usd", "lifetime_spend_usd", 100, 3))
    tier = F
    for least, name in TIERS:
        tier = tier.when(F.col("lifetime_spend_usd") >= least, name)
    return whole.join(top_category(rewards), "member_id", "left").join(best_card(roi), "member_id", "left").withColumn("value_tier", tier.otherwise("bronze"))
