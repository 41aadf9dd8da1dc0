"""The driver's tables seen as card-loyalty data, and the queries over them.

Each query applies the library's operators; its SQL twin in `SQL` says the same in another engine's dialect. Money is
decimal here, so both sides round alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from perkline.contracts import compare, parse_contract
from perkline.functions.clean import month_of, ratio, tidy, typed
from perkline.operators.caps import allocate_capped
from perkline.operators.dedup import latest_by
from perkline.operators.fx import convert_signed
from perkline.operators.history import versions
from perkline.operators.match import asof_join, best_match
from perkline.operators.rank import rank_by, share_of, top1_by
from perkline.operators.validate import reason_histogram, split_valid, tag_rejects
from perkline.quality import evaluate

#: Earning rules: (rule_id, card_id, category, multiplier, monthly cap, from, to). They overlap; one has no multiplier,
#: one no end, one is over, one has no start.
RULES = (
    ("R01", 0, "economy", "3.0", "50000", "1995-01-01", None),
    ("R02", 0, "economy", "2.0", None, "1995-01-01", None),
    ("R03", 1, "standard", "2.5", "20000", "1995-01-01", "1999-12-31"),
    ("R04", 1, "standard", None, "20000", "1995-01-01", None),
    ("R05", 2, "promo", "5.0", "10000", "1990-01-01", "1994-12-31"),
    ("R06", 2, "promo", "1.5", None, "1996-01-01", None),
    ("R07", 3, "medium", "4.0", "30000", None, None),
    ("R08", 3, "medium", "2.0", "30000", "1995-06-01", "2000-06-30"),
    ("R09", 4, "large", "3.0", "15000", "1995-01-01", None),
    ("R10", 5, "small", "0.5", None, "1995-01-01", None),
)
#: Dollars for one unit of the currency of each region and in each odd and even year; the last region has none.
RATES = {"AFRICA": ("1.0000", "1.0000"), "AMERICA": ("0.8000", "0.8250"), "ASIA": ("1.2500", "1.2000"), "EUROPE": ("1.1000", "1.0800")}
AS_OF = "2024-03-01"
MONEY = "decimal(18,2)"


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _inline(spark: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    """A table in the query's text: the planner knows its size, which it does not of rows sent from Python."""
    cell = lambda x: "CAST(NULL AS STRING)" if x is None else repr(x)
    return spark.sql(f"SELECT * FROM VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)} AS t({names})")


def rules(spark: SparkSession) -> DataFrame:
    raw = _inline(spark, list(RULES), "rule_id, rule_card, category, multiplier, cap, since, till")
    return raw.select("rule_id", F.col("rule_card").cast("long").alias("card_id"), "category", F.col("multiplier").cast("decimal(6,2)").alias("multiplier"), F.col("cap").cast(MONEY).alias("cap"), F.col("since").cast("date").alias("since"), F.col("till").cast("date").alias("till"))


def rates(spark: SparkSession) -> DataFrame:
    rows = [(c, y, r[y % 2]) for c, r in RATES.items() for y in range(1990, 2010)]
    return _inline(spark, rows, "rate_currency, rate_year, rate").withColumn("usd_rate", F.col("rate").cast("decimal(10,4)")).drop("rate")


def deliveries(spark: SparkSession, d: str) -> DataFrame:
    """Line items as transaction deliveries: repeated keys are re-deliveries."""
    li, o = _t(spark, d, "lineitem"), _t(spark, d, "orders").select("o_orderkey", "o_custkey")
    amount = (F.col("l_extendedprice").cast("decimal(12,2)") * (1 - F.col("l_discount").cast("decimal(4,2)"))).cast("decimal(18,4)")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        "l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), F.col("o_custkey").alias("member_id"), (F.col("l_suppkey") % 12).alias("card_id"), F.col("l_suppkey").alias("suppkey"),
        F.col("l_partkey").alias("merchant_id"), F.when(F.col("l_quantity") != 1, F.round(amount, 2).cast(MONEY)).alias("amount"), F.col("l_shipdate").cast("date").alias("txn_date"), (F.col("l_returnflag") == "R").alias("is_refund"),
    )


KEY = ["l_orderkey", "l_linenumber"]


def transactions(spark: SparkSession, d: str) -> DataFrame:
    """One row per key, converted and tagged with the first failing rule."""
    newest = [F.col(c).desc_nulls_last() for c in ("txn_date", "merchant_id", "suppkey")]
    one = latest_by(deliveries(spark, d), KEY, newest)
    place = _t(spark, d, "supplier").join(_t(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(_t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    one = one.join(place.select("s_suppkey", F.upper(F.trim("r_name")).alias("currency")), F.col("suppkey") == F.col("s_suppkey"), "left").drop("s_suppkey").withColumn("year", F.year("txn_date"))
    valued = convert_signed(one, rates(spark), "currency", "year", "amount", F.col("is_refund"), rate_date="rate_year", rate_currency="rate_currency")
    valued = valued.withColumn("amount_usd", F.col("amount_usd").cast(MONEY))
    return tag_rejects(valued, [("missing_amount", F.col("amount").isNull()), ("unknown_currency", F.col("usd_rate").isNull()), ("late", F.col("txn_date") > F.lit("2001-06-30").cast("date"))])


def valid(spark: SparkSession, d: str, refunds: bool) -> DataFrame:
    """Valid transactions with their month; refunds only if asked for."""
    rows, _ = split_valid(transactions(spark, d))
    return (rows if refunds else rows.where(~F.col("is_refund"))).withColumn("month", month_of("txn_date"))


def matched(spark: SparkSession, d: str, refunds: bool = False) -> DataFrame:
    shops = _t(spark, d, "part").select("p_partkey", F.lower(F.trim("p_type")).alias("category"))
    rich = valid(spark, d, refunds).join(shops, F.col("merchant_id") == F.col("p_partkey"), "left").drop("p_partkey")
    return best_match(rich, rules(spark), ["card_id", "category"], "txn_date", "since", "till", "multiplier", "rule_id", ["rule_id", "multiplier", "cap"])


def capped(spark: SparkSession, d: str, refunds: bool = False) -> DataFrame:
    earns = F.col("rule_id").isNotNull() & ~F.col("is_refund")
    return allocate_capped(matched(spark, d, refunds), ["member_id", "card_id", "month", "rule_id"], ["txn_date", *KEY], "amount_usd", "cap", earns, "eligible")


def fact(spark: SparkSession, d: str, refunds: bool = False) -> DataFrame:
    """Points and value; the base rate follows the card."""
    base = F.when(F.col("card_id") % 3 == 0, F.lit("1.00")).otherwise(F.lit("1.50")).cast("decimal(4,2)")
    points = F.col("amount_usd") * F.col("base") + F.col("eligible") * (F.coalesce(F.col("multiplier"), F.col("base").cast("decimal(6,2)")) - F.col("base"))
    out = capped(spark, d, refunds).withColumn("eligible", F.col("eligible").cast(MONEY)).withColumn("base", base).withColumn("points", F.round(points.cast("decimal(26,4)"), 2).cast(MONEY))
    return out.withColumn("value", F.round(F.col("points") * F.lit("0.0125").cast("decimal(6,4)"), 2).cast(MONEY))


def monthly_fee(card: str = "card_id") -> Column:
    return F.round((F.col(card) * 50).cast("decimal(12,2)") / 12, 2).cast(MONEY)


def roi(spark: SparkSession, d: str) -> DataFrame:
    """Earned and refunded sides from one pass over the facts."""
    own = ~F.col("is_refund")
    total = lambda c, where: F.coalesce(F.sum(F.when(where, F.col(c))), F.lit(0).cast(MONEY)).cast(MONEY)
    both = fact(spark, d, refunds=True).groupBy("member_id", "card_id", "month").agg(
        F.count_if(own).alias("txn_count"), F.countDistinct(F.when(own, F.col("merchant_id"))).alias("merchant_count"), total("amount_usd", own).alias("spend"), total("value", own).alias("value"),
        total("amount_usd", own & F.col("rule_id").isNotNull()).alias("bonus_spend"), total("amount_usd", ~own).alias("refund"),
    ).where("txn_count > 0")
    both = both.withColumn("net_spend", (F.col("spend") + F.col("refund")).cast(MONEY)).withColumn("fee", monthly_fee()).withColumn("net_value", (F.col("value") - F.col("fee")).cast(MONEY))
    both = both.withColumn("verdict", F.when((F.col("net_value") >= 0) | (F.col("fee") == 0), "keep").otherwise("review"))
    return rank_by(both, ["month"], [F.col("net_value").desc()], "value_rank").withColumn("value_rank", F.col("value_rank").cast("long"))


def _doubles(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("double").alias(c) if t.startswith("decimal") else F.col(c) for c, t in df.dtypes])


def event_versions(spark: SparkSession, d: str) -> DataFrame:
    """The last event type of each user and day, as daily snapshots of an attribute, turned into versions."""
    e = _t(spark, d, "events").withColumn("day", F.col("ts").cast("date"))
    daily = latest_by(e, ["user_id", "day"], [F.col("ts").desc(), F.col("event_id").desc()])
    return versions(daily, "user_id", "day", ["event_type"])


def _checked(df: DataFrame, specs: list[dict], lookup=None) -> DataFrame:
    from datetime import datetime

    spark = df.sparkSession
    got = evaluate(df, "t", specs, lookup, now=datetime.fromisoformat(AS_OF))
    return spark.createDataFrame([(o.type, o.passed, float(o.observed)) for o in got], "check_type string, passed boolean, observed double")


def q01_typed_scan(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(14,2)").cast("double").alias("price"), F.col("o_orderdate").cast("date").alias("day"), F.trim("o_orderstatus").alias("status"))


def q02_normalize_strings(spark, d):
    return _t(spark, d, "part").select("p_partkey", tidy("p_name", "upper").alias("name"), tidy("p_type", "lower").alias("category"), tidy(F.col("p_size").cast("string"), "code4").alias("code"))


def q03_try_cast(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", typed(F.substring("o_orderpriority", 1, 1), "int").cast("long").alias("level"), typed("o_orderpriority", "int").cast("long").alias("whole"), typed("o_orderstatus", "double").alias("none"))


def q04_dedup_latest(spark, d):
    li = _t(spark, d, "lineitem")
    return latest_by(li, KEY, [F.col(c).desc() for c in ("l_shipdate", "l_partkey", "l_suppkey")]).select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_partkey", "l_suppkey", F.col("l_shipdate").cast("date").alias("day"))


def q05_fx_signed(spark, d):
    return _doubles(transactions(spark, d).select(*KEY, "currency", "amount", "usd_rate", "amount_usd"))


def q06_reject_reason(spark, d):
    return transactions(spark, d).groupBy(F.coalesce("_reject_reason", F.lit("valid")).alias("reason")).agg(F.count("*").alias("n"))


def q07_valid_partition(spark, d):
    valid, _ = split_valid(transactions(spark, d))
    return _doubles(valid.select(*KEY, "member_id", "card_id", "amount_usd", "is_refund"))


def q08_scd2_versions(spark, d):
    return event_versions(spark, d)


def q09_scd2_current(spark, d):
    return event_versions(spark, d).where("is_current").select("user_id", "version_no", "event_type", "valid_from")


def q10_asof_enrich(spark, d):
    facts = _t(spark, d, "events").where("event_type = 'purchase'").select("event_id", "user_id", F.col("ts").cast("date").alias("day"))
    dim = event_versions(spark, d).withColumnRenamed("event_type", "state")
    return asof_join(facts, dim, "user_id", "day", "valid_from", "valid_to", ["state", "version_no"])


def q11_best_rule(spark, d):
    return _doubles(matched(spark, d).select(*KEY, "category", F.coalesce("rule_id", F.lit("BASE_EARN")).alias("rule_id"), "multiplier", "cap"))


def q12_capped_running(spark, d):
    return _doubles(capped(spark, d).select(*KEY, "rule_id", "amount_usd", "eligible"))


def q13_points_fact(spark, d):
    return _doubles(fact(spark, d).select(*KEY, "member_id", "card_id", "month", "amount_usd", "base", "eligible", "points", "value"))


def q14_roi_monthly(spark, d):
    out = roi(spark, d)
    return _doubles(out.withColumn("return_pct", ratio("value", "spend", 100, 3)).withColumn("roi", F.when(F.col("fee") > 0, ratio("value", "fee", 1, 3))))


def q15_category_share(spark, d):
    sums = fact(spark, d).where("category is not null").groupBy("month", "category").agg(F.count("*").alias("txn_count"), F.countDistinct("member_id").alias("member_count"), F.countDistinct("merchant_id").alias("merchant_count"), F.sum("amount_usd").cast(MONEY).alias("spend"), F.sum("value").cast(MONEY).alias("value"))
    out = rank_by(share_of(sums, ["month"], "spend", "pct", places=2), ["month"], [F.col("spend").desc()], "spend_rank")
    return _doubles(out.withColumn("spend_rank", F.col("spend_rank").cast("long")))


def q16_member_summary(spark, d):
    """One pass over the facts: they are summed by member, card, month and category, and one more shuffle, by member,
    serves the sums by category and by card and the summary itself."""
    sums = fact(spark, d).groupBy("member_id", "card_id", "month", "category").agg(F.count("*").alias("n"), F.sum("amount_usd").cast(MONEY).alias("spend"), F.sum("value").cast(MONEY).alias("value"), F.min("txn_date").alias("first"), F.max("txn_date").alias("last"))
    by_category, by_card = Window.partitionBy("member_id", "category"), Window.partitionBy("member_id", "card_id")
    own = sums.repartition("member_id").withColumn("category_spend", F.sum("spend").over(by_category).cast(MONEY))
    net = F.sum("value").over(by_card) - monthly_fee() * F.size(F.collect_set("month").over(by_card))
    own = own.withColumn("card_net", net.cast(MONEY))
    best = lambda keep, by, name: F.min(F.when(keep, F.struct((-F.col(by)).alias("down"), F.col(name).alias("name")))).alias(name)
    count = lambda c: F.size(F.collect_set(c)).cast("long")
    out = own.groupBy("member_id").agg(
        F.sum("n").alias("txn_count"), count("card_id").alias("card_count"), count("month").alias("active_months"), F.sum("spend").cast(MONEY).alias("spend"), F.sum("value").cast(MONEY).alias("value"), F.min("first").alias("first_day"), F.max("last").alias("last_day"),
        best(F.col("category").isNotNull(), "category_spend", "category"), best(F.lit(True), "card_net", "card_id"),
    )
    tier = F.when(F.col("spend") >= 2000000, "platinum").when(F.col("spend") >= 800000, "gold").when(F.col("spend") >= 200000, "silver").otherwise("bronze")
    tops = {"top_category": F.col("category.name"), "category_spend": -F.col("category.down"), "best_card": F.col("card_id.name"), "card_net": -F.col("card_id.down")}
    return _doubles(out.withColumns(tops).drop("category", "card_id").withColumn("return_pct", ratio("value", "spend", 100, 3)).withColumn("tier", tier))


def q17_top_category(spark, d):
    sums = fact(spark, d).where("category is not null").groupBy("member_id", "category").agg(F.sum("amount_usd").cast(MONEY).alias("category_spend"))
    return _doubles(top1_by(sums, ["member_id"], [F.col("category_spend").desc(), F.col("category")]).withColumnRenamed("category", "top_category"))


def q18_best_card(spark, d):
    """The fee is due for each month with a fact, so months are counted, not listed."""
    sums = fact(spark, d).groupBy("member_id", "card_id").agg((F.sum("value") - monthly_fee() * F.countDistinct("month")).cast(MONEY).alias("card_net"))
    return _doubles(top1_by(sums, ["member_id"], [F.col("card_net").desc(), F.col("card_id")]).withColumnRenamed("card_id", "best_card"))


def q19_check_row_count(spark, d):
    return _checked(_t(spark, d, "lineitem"), [{"type": "row_count_min", "value": 1000, "where": "l_returnflag = 'R'"}])


def q20_check_not_null(spark, d):
    return _checked(_t(spark, d, "orders"), [{"type": "not_null", "column": "o_orderdate"}])


def q21_check_unique(spark, d):
    return _checked(_t(spark, d, "lineitem"), [{"type": "unique", "column": "l_orderkey", "severity": "warn"}])


def q22_check_unique_composite(spark, d):
    return _checked(_t(spark, d, "lineitem"), [{"type": "unique_composite", "columns": KEY, "severity": "warn"}])


def q23_check_accepted_values(spark, d):
    return _checked(_t(spark, d, "lineitem"), [{"type": "accepted_values", "column": "l_returnflag", "values": ["A", "N"]}])


def q24_check_range(spark, d):
    return _checked(_t(spark, d, "lineitem"), [{"type": "range", "column": "l_quantity", "max": 40}])


def q25_check_corrupt_ratio(spark, d):
    df = _t(spark, d, "orders").withColumn("_corrupt_record", F.when(F.col("o_orderkey") % 50 == 0, "broken"))
    return _checked(df, [{"type": "corrupt_ratio_max", "value": 0.02}])


def q26_check_freshness(spark, d):
    return _checked(_t(spark, d, "events"), [{"type": "freshness_days_max", "column": "ts", "value": 45}])


def q27_check_referential(spark, d):
    known = _t(spark, d, "orders").where("o_orderstatus = 'F'")
    return _checked(_t(spark, d, "lineitem"), [{"type": "referential_integrity", "column": "l_orderkey", "ref_table": "silver.orders", "ref_column": "o_orderkey"}], lambda name: known)


def q28_reject_histogram(spark, d):
    _, rejected = split_valid(transactions(spark, d))
    return reason_histogram(rejected).select(F.col("_reject_reason").alias("reason"), F.col("count").alias("n"))


def q29_schema_drift(spark, d):
    """A contract for orders with one renamed and one retyped column: what the written table shows."""
    c = parse_contract({"layer": "silver", "table": "orders", "owner": "x", "grain": ["o_orderkey"], "columns": [{"name": "o_orderkey", "type": "bigint"}, {"name": "customer", "type": "bigint"}, {"name": "o_totalprice", "type": "decimal(14,2)"}, {"name": "o_orderstatus", "type": "string"}]})
    drift = compare(c, _t(spark, d, "orders").schema)
    rows = [("missing", x, "") for x in drift.missing] + [("undeclared", x, "") for x in drift.undeclared] + [("mismatch", n, f"{w} {h}") for n, w, h in drift.mismatched]
    return spark.createDataFrame(rows, "kind string, name string, types string")


def q30_corrupt_split(spark, d):
    """JSON lines from events, each tenth cut short: parsed rows and broken lines by the declared schema."""
    e = _t(spark, d, "events")
    line = F.to_json(F.struct("event_id", "user_id", "event_type"))
    lines = e.select("event_id", F.when(F.col("event_id") % 10 == 0, F.substring(line, 1, 20)).otherwise(line).alias("line"))
    parsed = lines.select(F.from_json("line", "event_id long, user_id long, event_type string, _corrupt_record string", {"mode": "PERMISSIVE"}).alias("r"))
    return parsed.groupBy(F.coalesce(F.col("r.event_type"), F.lit("broken")).alias("kind")).agg(F.count("*").alias("n"), F.count("r._corrupt_record").alias("broken"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in list(globals().values()) if callable(f) and getattr(f, "__name__", "")[:1] == "q" and f.__name__[1:3].isdigit()}
