"""Queries that run the engine itself (`silver`, `gold`, the sources and sinks) over feeds made from the driver's tables.

Amounts are whole multiples of eight and rates multiples of a quarter, so sums of doubles are exact; the feeds hold every
fault that a rule names."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perkline.operators.validate import split_valid
from perkline.plans import gold, silver
from perkline.plans.canonical import AS_OF, _inline, _t
from perkline.quality import evaluate
from perkline.sources.schemas import CORRUPT, FEEDS
from perkline.sources.storage import join_uri, publish, quarantine, read_feed, read_table, register_views, remove, run_sql, with_lineage

CURRENCIES = (("usd", "1.0"), ("eur", "1.25"), ("gbp", "1.5"), ("inr", "0.25"))
FIRST_DAY, LAST_DAY = "1995-01-01", "2001-12-31"


def _days(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT explode(sequence(DATE '{FIRST_DAY}', DATE '{LAST_DAY}')) AS rate_date")


def raw_rates(spark: SparkSession) -> DataFrame:
    """A rate for each day and currency; on each third day a lower one is delivered too."""
    known = _inline(spark, list(CURRENCIES), "code, rate")
    rows = _days(spark).join(F.broadcast(known)).select("rate_date", F.concat(F.lit(" "), "code").alias("currency"), F.col("rate").alias("usd_rate"))
    again = rows.where(F.dayofyear("rate_date") % 3 == 0).withColumn("usd_rate", F.lit("0.125"))
    return rows.unionByName(again)


def raw_cards(spark: SparkSession, d: str) -> DataFrame:
    """Events as daily snapshots of cards, a quarter apart; several a day, with values that come back."""
    n = F.dayofmonth("ts")
    return _t(spark, d, "events").select(
        F.concat(F.lit("c"), "user_id").alias("card_id"), F.concat(F.lit(" "), "event_type", F.lit(" ")).alias("product_name"), F.when(F.col("user_id") % 4 != 0, F.concat(F.lit("bank "), F.col("user_id") % 3)).alias("issuer"),
        F.upper(F.substring("event_type", 1, 2)).alias("network"), ((F.col("user_id") % 3) * 60).cast("string").alias("annual_fee_usd"), F.when(F.col("user_id") % 2 == 0, "1.0").otherwise("1.5").alias("base_earn_rate"),
        F.when(n % 2 == 0, "4").otherwise("8").alias("point_value_cents"), F.date_add(F.lit(FIRST_DAY).cast("date"), (n - 1) * 90).alias("snapshot_date"),
    )


def raw_merchants(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "part").select(F.concat(F.lit("m"), "p_partkey").alias("merchant_id"), F.concat(F.lit(" "), "p_name").alias("merchant_name"), F.col("p_size").cast("string").alias("mcc"), F.when(F.col("p_partkey") % 10 != 0, F.concat("p_type", F.lit(" "))).alias("category"), F.lower(F.substring("p_brand", 1, 2)).alias("country"))


def raw_rules(spark: SparkSession) -> DataFrame:
    """Overlapping rules of 150 cards: without multiplier, cap, end, or start."""
    i = F.col("id")
    kinds = F.array(*[F.lit(x) for x in ("ECONOMY", "STANDARD", "PROMO", "MEDIUM", "LARGE", "SMALL")])
    return spark.range(900).select(
        F.concat(F.lit("r"), i).alias("rule_id"), F.when(i % 50 != 49, F.concat(F.lit("c"), i % 150)).alias("card_id"), F.concat(F.lit(" "), F.element_at(kinds, (i % 7 % 6 + 1).cast("int"))).alias("category"),
        F.when(i % 11 != 0, (1 + (i % 7) * 0.5).cast("string")).alias("multiplier"), F.when(i % 3 != 0, (1600 * (1 + i % 5)).cast("string")).alias("monthly_cap_usd"),
        F.when(i % 13 != 0, "1995-03-01").otherwise(F.when(i % 2 == 0, "never")).alias("effective_from"), F.when(i % 4 == 0, "1998-06-30").alias("effective_to"),
    )


def raw_transactions(spark: SparkSession, d: str) -> DataFrame:
    """Line items as deliveries, with every fault that silver names; repeated keys are re-deliveries."""
    li, o = _t(spark, d, "lineitem"), _t(spark, d, "orders").select("o_orderkey", "o_custkey")
    k, day = F.col("l_orderkey"), F.date_format("l_shipdate", "yyyy-MM-dd")
    codes = F.array(*[F.lit(c) for c, _ in CURRENCIES], F.lit("xau"))
    status = F.when(k % 79 == 3, F.lit(None)).when(k % 73 == 4, "Odd").when(F.col("l_returnflag") == "R", " REFUNDED").otherwise("settled ")
    return li.join(o, k == F.col("o_orderkey")).select(
        F.when(k % 97 != 0, F.concat_ws("-", k, F.col("l_linenumber"))).alias("txn_id"), F.when(k % 89 != 1, F.concat(F.lit("u"), F.col("o_custkey"))).alias("member_id"), F.concat(F.lit("c"), F.col("l_suppkey") % 50).alias("card_id"),
        F.concat(F.lit("m"), "l_partkey").alias("merchant_id"), (F.col("l_partkey") % 1000).cast("string").alias("mcc"), F.when(F.col("l_quantity") != 1, F.floor(F.col("l_extendedprice") / 8) * 8.0).alias("amount"),
        F.concat(F.lit(" "), F.element_at(codes, (F.col("l_suppkey") % 17 % 5 + 1).cast("int")), F.lit(" ")).alias("currency"), F.when(k % 83 == 2, "soon").otherwise(F.concat(day, F.lit("T0"), F.col("l_linenumber"), F.lit(":30:00"))).alias("txn_ts"),
        status.alias("status"), F.when(F.col("l_returnflag") == "R", True).alias("is_refund"), F.lit(" Web").alias("channel"), F.lit("x").alias("source_system"), F.col("l_shipdate").cast("date").alias("ingest_date"),
        F.lit("b").alias("_batch_id"), F.col("l_shipdate").alias("_ingested_at"), F.concat(F.lpad(F.col("l_partkey").cast("string"), 9, "0"), F.lpad(F.col("l_suppkey").cast("string"), 9, "0"), F.format_string("%013.2f", "l_extendedprice"), F.format_string("%08.2f", "l_quantity")).alias("_source_file"),
    )


def _transactions(spark: SparkSession, d: str) -> DataFrame:
    return silver.transactions(raw_transactions(spark, d), silver.fx_rates(raw_rates(spark)))


def _rewards(spark: SparkSession, d: str, valid: DataFrame) -> DataFrame:
    return gold.transaction_rewards(valid, silver.merchants(raw_merchants(spark, d)), silver.cards(raw_cards(spark, d)), silver.reward_rules(raw_rules(spark)))


def _marts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(rewards, valid transactions), the former written down once, as the gold stage does."""
    valid, _ = split_valid(_transactions(spark, d))
    home = scratch(spark)
    publish(_rewards(spark, d, valid), join_uri(home, "gold", "rewards"))
    return read_table(spark, home, "gold", "rewards"), valid


def scratch(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which the executors share; where that is unset, a local one."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="perkline-")
    home = join_uri(root, f"perkline-{uuid.uuid4().hex}")
    _HOMES.append((spark, home))
    return home


_HOMES: list[tuple[SparkSession, str]] = []


@atexit.register
def _clean() -> None:
    for spark, home in _HOMES:
        try:
            if spark.sparkContext._jsc is not None:
                remove(spark, home)
        except Exception:  # the JVM may be gone already
            pass


def q31_engine_card_history(spark, d):
    return silver.cards(raw_cards(spark, d))


def q32_engine_transactions(spark, d):
    out = _transactions(spark, d)
    return out.select("txn_id", "member_id", "card_id", "merchant_id", "mcc", "amount", "currency", "usd_rate", "amount_usd", F.date_format("txn_ts", "yyyy-MM-dd HH:mm").alias("stamp"), "txn_date", "status", "is_refund", "channel", F.col("_reject_reason").alias("reason"), F.col("_is_valid").alias("valid"))


def q33_engine_merchants(spark, d):
    return silver.merchants(raw_merchants(spark, d))


def q34_engine_rewards(spark, d):
    valid, _ = split_valid(_transactions(spark, d))
    out = _rewards(spark, d, valid)
    return out.select("txn_id", "member_id", "card_id", "card_sk", "product_name", "category", "month", "amount_usd", "rule_id", "base_earn_rate", "applied_multiplier", "bonus_eligible_usd", "points_earned", "reward_value_usd", "annual_fee_usd")


def q35_engine_card_roi(spark, d):
    rewards, valid = _marts(spark, d)
    return gold.card_roi_monthly(rewards, valid).withColumn("month_value_rank", F.col("month_value_rank").cast("long"))


def q36_engine_category_spend(spark, d):
    """With the average ticket and the return ratio."""
    return gold.merchant_category_spend(_marts(spark, d)[0]).withColumn("spend_rank", F.col("spend_rank").cast("long"))


def q37_engine_member_summary(spark, d):
    rewards, valid = _marts(spark, d)
    return gold.member_rewards_summary(rewards, gold.card_roi_monthly(rewards, valid))


def q38_json_feed(spark, d):
    """Lines of a daily JSON feed, each twentieth torn, landed by day; one day is read with the declared schema, the
    torn lines go to quarantine by batch, twice, and what is there then is told beside the good rows."""
    home = scratch(spark)
    names = [c for c in FEEDS["transactions"].schema.names if c != CORRUPT]
    rows = raw_transactions(spark, d).withColumn("n", F.substring("merchant_id", 2, 20).cast("long") % 20)
    line = F.to_json(F.struct(*names))
    lines = rows.select(F.when(F.col("n") == 0, F.substring(line, 1, 25)).otherwise(line).alias("value"), F.year("ingest_date").alias("ingest_date"))
    lines.write.partitionBy("ingest_date").text(join_uri(home, "landing", "transactions"))
    landed = with_lineage(read_feed(spark, join_uri(home, "landing"), "transactions", "1997"), "transactions", "b1").cache()
    bad = landed.where(F.col(CORRUPT).isNotNull()).select(F.col(CORRUPT).alias("line"), "_batch_id")
    for _ in range(2):
        quarantine(bad, join_uri(home, "quarantine"), "_batch_id")
    kept = spark.read.parquet(join_uri(home, "quarantine")).agg(F.count("*").alias("n"), F.max(F.length("line")).cast("long").alias("m"))
    good = landed.where(F.col(CORRUPT).isNull()).groupBy("status").agg(F.count("*").alias("n"), F.count("amount").alias("m"))
    out = good.select(F.coalesce("status", F.lit("none")).alias("kind"), "n", "m").unionByName(kept.select(F.lit("quarantined").alias("kind"), "n", "m"))
    told = [tuple(r) for r in out.collect()]  # a status each
    landed.unpersist()
    return spark.createDataFrame(told, "kind string, n long, m long")


def q39_csv_feed(spark, d):
    """A CSV feed with quotes, commas and blanks, read with the declared schema."""
    home = scratch(spark)
    rows = raw_merchants(spark, d).withColumn("merchant_name", F.concat("merchant_name", F.lit(', "the" '), "mcc"))
    rows.select(*FEEDS["merchants"].schema.names).write.option("header", True).option("escape", '"').option("emptyValue", "").option("ignoreTrailingWhiteSpace", False).option("ignoreLeadingWhiteSpace", False).csv(join_uri(home, "merchants"))
    return read_feed(spark, home, "merchants")


def q40_partition_rerun(spark, d):
    """Orders published by status, then one status again with other rows: only that partition changes; read as a view
    with a bound parameter."""
    home = scratch(spark)
    orders = _t(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("customer"), "o_orderstatus")
    path = join_uri(home, "silver", "orders")
    publish(orders, path, ["o_orderstatus"])
    publish(orders.where("o_orderstatus = 'F' and o_orderkey % 2 = 0").withColumn("customer", -F.col("customer")), path, ["o_orderstatus"], incremental=True)
    register_views(spark, home, "silver", ["orders", "absent"])
    return run_sql(spark, "SELECT o_orderkey, customer, o_orderstatus FROM silver_orders WHERE o_orderkey >= :least", least=10)


def q41_check_suite(spark, d):
    """Several checks of one table at once, of all kinds."""
    specs = [
        {"type": "row_count_min", "value": 10}, {"type": "not_null", "column": "member_id"}, {"type": "unique", "column": "txn_id", "where": "txn_id IS NOT NULL", "severity": "warn"}, {"type": "accepted_values", "column": "status", "values": ["settled ", " REFUNDED"], "severity": "warn"},
        {"type": "range", "column": "amount", "min": 800, "max": 80000, "severity": "warn"}, {"type": "freshness_days_max", "column": "txn_ts", "value": 30}, {"type": "unique_composite", "columns": ["txn_id", "merchant_id"], "where": "txn_id IS NOT NULL"},
        {"type": "referential_integrity", "column": "card_id", "ref_table": "silver.cards", "ref_column": "card_id"},
    ]
    cards = raw_cards(spark, d).where("card_id != 'c7'")
    got = evaluate(raw_transactions(spark, d), "bronze.transactions", specs, lambda name: cards, now=datetime.fromisoformat(AS_OF))
    return spark.createDataFrame([(o.type, o.target, o.severity, o.passed, float(o.observed)) for o in got], "check_type string, target string, severity string, passed boolean, observed double")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in list(globals().values()) if callable(f) and getattr(f, "__name__", "")[:1] == "q" and f.__name__[1:3].isdigit()}
