"""SQL twins of the queries in `engine`."""

from __future__ import annotations

from perkline.plans.canonical import AS_OF
from perkline.plans.engine import CURRENCIES, FIRST_DAY, LAST_DAY


def _r(x: str, places: int = 2) -> str:
    """Half up on the shortest decimal of a double, as Spark rounds."""
    return f"round(({x})::DOUBLE::VARCHAR::DECIMAL(38,16), {places})::DOUBLE"


_RATES = f"""rates AS (
  SELECT rate_date, code AS currency, rate AS usd_rate FROM (SELECT unnest(generate_series(DATE '{FIRST_DAY}', DATE '{LAST_DAY}', INTERVAL 1 DAY))::DATE AS rate_date), (VALUES {", ".join(f"('{c.upper()}', {r}::DOUBLE)" for c, r in CURRENCIES)}) v(code, rate))"""
_TXN = f"""{_RATES},
raw AS (
  SELECT CASE WHEN l_orderkey % 97 <> 0 THEN l_orderkey || '-' || l_linenumber END AS txn_id, CASE WHEN l_orderkey % 89 <> 1 THEN 'u' || o_custkey END AS member_id, 'c' || l_suppkey % 50 AS card_id, 'm' || l_partkey AS merchant_id,
    lpad((l_partkey % 1000)::VARCHAR, 4, '0') AS mcc, CASE WHEN l_quantity <> 1 THEN floor(l_extendedprice / 8) * 8.0::DOUBLE END AS amount,
    (['USD', 'EUR', 'GBP', 'INR', 'XAU'])[l_suppkey % 17 % 5 + 1] AS currency, CASE WHEN l_orderkey % 83 <> 2 THEN strftime(l_shipdate, '%Y-%m-%d') || ' 0' || l_linenumber || ':30' END AS stamp,
    CASE WHEN l_orderkey % 79 = 3 THEN NULL WHEN l_orderkey % 73 = 4 THEN 'odd' WHEN l_returnflag = 'R' THEN 'refunded' ELSE 'settled' END AS status, l_returnflag = 'R' AS is_refund, l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_quantity
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
one AS (
  SELECT * EXCLUDE (n), stamp[1:10]::DATE AS txn_date FROM (SELECT *, row_number() OVER (PARTITION BY txn_id ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC, l_quantity DESC) AS n FROM raw WHERE txn_id IS NOT NULL) WHERE n = 1
  UNION ALL SELECT *, stamp[1:10]::DATE FROM raw WHERE txn_id IS NULL),
txn AS (
  SELECT o.*, usd_rate, CASE WHEN is_refund THEN -(amount * usd_rate) ELSE amount * usd_rate END AS amount_usd,
    CASE WHEN txn_id IS NULL THEN 'missing_txn_id' WHEN member_id IS NULL THEN 'missing_entity_key' WHEN amount IS NULL THEN 'missing_amount' WHEN stamp IS NULL THEN 'unparseable_timestamp' WHEN usd_rate IS NULL THEN 'unknown_currency'
      WHEN status IS NULL THEN 'missing_status' WHEN status NOT IN ('settled', 'refunded') THEN 'unknown_status' END AS reason
  FROM one o LEFT JOIN rates r ON r.currency = o.currency AND r.rate_date = o.txn_date)"""
_CARDS = f"""snap AS (
  SELECT 'c' || user_id AS card_id, event_type AS product_name, CASE WHEN user_id % 4 <> 0 THEN 'bank ' || user_id % 3 END AS issuer, event_type[1:2] AS network, ((user_id % 3) * 60)::DOUBLE AS annual_fee_usd, CASE WHEN user_id % 2 = 0 THEN 1.0 ELSE 1.5 END::DOUBLE AS base_earn_rate,
    CASE WHEN day(ts) % 2 = 0 THEN 4 ELSE 8 END::DOUBLE AS point_value_cents, DATE '{FIRST_DAY}' + (day(ts)::INT - 1) * 90 AS snapshot_date FROM events),
daily AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY card_id, snapshot_date ORDER BY product_name DESC, network DESC) AS n FROM snap) WHERE n = 1),
state AS (SELECT *, concat_ws('||', product_name, coalesce(issuer, ''), network, annual_fee_usd::VARCHAR, base_earn_rate::VARCHAR, point_value_cents::VARCHAR) AS whole FROM daily),
flagged AS (SELECT *, coalesce((whole <> lag(whole) OVER (PARTITION BY card_id ORDER BY snapshot_date))::INT, 1) AS new FROM state),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY card_id ORDER BY snapshot_date ROWS UNBOUNDED PRECEDING) AS version_no FROM flagged),
held AS (
  SELECT card_id, version_no::BIGINT AS version_no, any_value(product_name) AS product_name, any_value(issuer) AS issuer, any_value(network) AS network, any_value(annual_fee_usd) AS annual_fee_usd, any_value(base_earn_rate) AS base_earn_rate, any_value(point_value_cents) AS point_value_cents,
    md5(any_value(whole)) AS attr_hash, min(snapshot_date) AS valid_from, max(snapshot_date) AS last_seen_date FROM numbered GROUP BY card_id, version_no),
cards AS (
  SELECT md5(card_id || '||' || valid_from) AS card_sk, *, coalesce(lead(valid_from) OVER w - 1, DATE '9999-12-31') AS valid_to, lead(valid_from) OVER w IS NULL AS is_current FROM held WINDOW w AS (PARTITION BY card_id ORDER BY version_no))"""
_SHOPS = """shops AS (
  SELECT 'm' || p_partkey AS merchant_id, list_aggregate(list_transform(string_split(lower(p_name), ' '), lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ') AS merchant_name, lpad(p_size::VARCHAR, 4, '0') AS mcc,
    CASE WHEN p_partkey % 10 <> 0 THEN lower(p_type) END AS category, upper(p_brand[1:2]) AS country FROM part)"""
_RULES = """rules AS (
  SELECT 'r' || i AS rule_id, 'c' || i % 150 AS card_id, (['economy', 'standard', 'promo', 'medium', 'large', 'small'])[i % 7 % 6 + 1] AS category, CASE WHEN i % 11 <> 0 THEN 1 + (i % 7) * 0.5 END::DOUBLE AS multiplier,
    CASE WHEN i % 3 <> 0 THEN 1600 * (1 + i % 5) END::DOUBLE AS cap, DATE '1995-03-01' AS since, CASE WHEN i % 4 = 0 THEN DATE '1998-06-30' END AS till
  FROM range(900) t(i) WHERE i % 50 <> 49 AND i % 13 <> 0)"""
_REWARDS = f"""{_TXN}, {_CARDS}, {_SHOPS}, {_RULES},
rich AS (
  SELECT t.txn_id, t.member_id, t.card_id, t.merchant_id, t.stamp, t.txn_date, t.amount_usd, stamp[1:7] AS month, s.category, c.card_sk, c.product_name, c.issuer, c.annual_fee_usd, coalesce(c.base_earn_rate, 1) AS base, coalesce(c.point_value_cents, 1) AS worth
  FROM txn t LEFT JOIN shops s USING (merchant_id) LEFT JOIN cards c ON c.card_id = t.card_id AND t.txn_date BETWEEN c.valid_from AND c.valid_to WHERE reason IS NULL AND status = 'settled'),
ruled AS (
  SELECT * FROM (SELECT r.*, u.rule_id AS rule, u.multiplier, u.cap, row_number() OVER (PARTITION BY txn_id ORDER BY u.multiplier DESC NULLS LAST, u.rule_id NULLS LAST) AS k
    FROM rich r LEFT JOIN rules u ON u.card_id = r.card_id AND u.category = r.category AND r.txn_date >= u.since AND (u.till IS NULL OR r.txn_date <= u.till)) WHERE k = 1),
shared AS (
  SELECT *, CASE WHEN rule IS NULL THEN 0 WHEN cap IS NULL THEN amount_usd ELSE greatest(0, least(amount_usd, cap - (sum(greatest(amount_usd, 0)) OVER (PARTITION BY member_id, card_id, month, rule ORDER BY stamp, txn_id ROWS UNBOUNDED PRECEDING) - greatest(amount_usd, 0)))) END::DOUBLE AS eligible FROM ruled),
rewards AS (
  SELECT *, {_r("points * worth / 100")} AS value FROM (SELECT *, coalesce(rule, 'BASE_EARN') AS rule_id, coalesce(multiplier, base) AS applied, {_r("amount_usd * base + eligible * (coalesce(multiplier, base) - base)")} AS points FROM shared))"""
_ROI = f"""{_REWARDS},
earned AS (
  SELECT member_id, card_id, month, max(product_name) AS product_name, max(issuer) AS issuer, max(annual_fee_usd) AS fee, count(*) AS txn_count, count(DISTINCT merchant_id) AS merchant_count, sum(amount_usd) AS spend, sum(points) AS points, sum(value) AS value,
    sum(CASE WHEN rule_id <> 'BASE_EARN' THEN amount_usd ELSE 0 END) AS bonus FROM rewards GROUP BY member_id, card_id, month),
back AS (SELECT member_id, card_id, stamp[1:7] AS month, sum(amount_usd) AS back FROM txn WHERE reason IS NULL AND status = 'refunded' GROUP BY 1, 2, 3),
told AS (
  SELECT e.member_id, e.card_id, product_name, issuer, e.month, txn_count, merchant_count, {_r("spend")} AS spend_usd, {_r("coalesce(back, 0)")} AS refund_usd, {_r("spend + coalesce(back, 0)")} AS net_spend_usd, {_r("bonus")} AS bonus_category_spend_usd, {_r("points")} AS points_earned,
    {_r("value")} AS reward_value_usd, coalesce(fee, 0)::DOUBLE AS annual_fee_usd, {_r("coalesce(fee, 0) / 12")} AS monthly_fee_usd FROM earned e LEFT JOIN back b ON b.member_id = e.member_id AND b.card_id = e.card_id AND b.month = e.month),
netted AS (SELECT *, {_r("reward_value_usd - monthly_fee_usd")} AS net_value_usd FROM told),
roi AS (
  SELECT *, CASE WHEN monthly_fee_usd > 0 THEN {_r("reward_value_usd / monthly_fee_usd", 3)} END AS roi_ratio, {_r("100 * reward_value_usd / nullif(spend_usd, 0)", 3)} AS effective_return_pct, {_r("100 * bonus_category_spend_usd / nullif(spend_usd, 0)")} AS bonus_spend_share_pct,
    CASE WHEN net_value_usd >= 0 OR monthly_fee_usd = 0 THEN 'keep' ELSE 'review' END AS fee_verdict, rank() OVER (PARTITION BY month ORDER BY net_value_usd DESC) AS month_value_rank FROM netted)"""

SQL = {
    "q31_engine_card_history": f"WITH {_CARDS} SELECT card_sk, card_id, product_name, issuer, network, annual_fee_usd, base_earn_rate, point_value_cents, version_no, attr_hash, valid_from, valid_to, is_current, last_seen_date FROM cards",
    "q32_engine_transactions": f"WITH {_TXN} SELECT txn_id, member_id, card_id, merchant_id, mcc, amount, currency, usd_rate, amount_usd, stamp, txn_date, status, is_refund, 'web' AS channel, reason, reason IS NULL AS valid FROM txn",
    "q33_engine_merchants": f"WITH {_SHOPS} SELECT * FROM shops",
    "q34_engine_rewards": f"WITH {_REWARDS} SELECT txn_id, member_id, card_id, card_sk, product_name, category, month, amount_usd, rule_id, base AS base_earn_rate, applied AS applied_multiplier, eligible AS bonus_eligible_usd, points AS points_earned, value AS reward_value_usd, annual_fee_usd FROM rewards",
    "q35_engine_card_roi": f"WITH {_ROI} SELECT * FROM roi",
    "q36_engine_category_spend": f"""WITH {_REWARDS}, sums AS (
      SELECT month, category, count(*) AS txn_count, count(DISTINCT member_id) AS member_count, count(DISTINCT merchant_id) AS merchant_count, sum(amount_usd) AS spend, sum(points) AS points, sum(value) AS value FROM rewards WHERE category IS NOT NULL GROUP BY month, category)
      SELECT month, category, txn_count, member_count, merchant_count, {_r("spend")} AS spend_usd, {_r("spend / txn_count")} AS avg_ticket_usd, {_r("points")} AS points_earned, {_r("value")} AS reward_value_usd, {_r("100 * value / nullif(spend, 0)", 3)} AS effective_return_pct,
        {_r("100 * spend / nullif(sum(spend) OVER (PARTITION BY month), 0)")} AS pct_of_month_spend, rank() OVER (PARTITION BY month ORDER BY spend DESC) AS spend_rank FROM sums""",
    "q37_engine_member_summary": f"""WITH {_ROI}, whole AS (
      SELECT member_id, count(*) AS txn_count, count(DISTINCT card_id) AS card_count, count(DISTINCT month) AS active_months, {_r("sum(amount_usd)")} AS lifetime_spend_usd, {_r("sum(points)")} AS lifetime_points, {_r("sum(value)")} AS lifetime_reward_usd, min(txn_date) AS first_txn_date, max(txn_date) AS last_txn_date FROM rewards GROUP BY member_id),
      cats AS (SELECT member_id, category, sum(amount_usd) AS spend, row_number() OVER (PARTITION BY member_id ORDER BY sum(amount_usd) DESC, category) AS n FROM rewards WHERE category IS NOT NULL GROUP BY member_id, category),
      nets AS (SELECT member_id, card_id, {_r("sum(net_value_usd)")} AS net, arg_max(product_name, month) AS product, row_number() OVER (PARTITION BY member_id ORDER BY {_r("sum(net_value_usd)")} DESC, card_id) AS n FROM roi GROUP BY member_id, card_id)
      SELECT w.*, {_r("100 * lifetime_reward_usd / nullif(lifetime_spend_usd, 0)", 3)} AS effective_return_pct, c.category AS top_category, {_r("c.spend")} AS top_category_spend_usd, x.card_id AS best_card_id, x.product AS best_card_product, x.net AS best_card_net_value_usd,
        CASE WHEN lifetime_spend_usd >= 20000 THEN 'platinum' WHEN lifetime_spend_usd >= 8000 THEN 'gold' WHEN lifetime_spend_usd >= 2000 THEN 'silver' ELSE 'bronze' END AS value_tier
      FROM whole w LEFT JOIN cats c ON c.member_id = w.member_id AND c.n = 1 LEFT JOIN nets x ON x.member_id = w.member_id AND x.n = 1""",
    "q38_json_feed": f"""WITH {_TXN}, t AS (SELECT *, CASE WHEN l_orderkey % 79 = 3 THEN 'none' WHEN l_orderkey % 73 = 4 THEN 'Odd' WHEN l_returnflag = 'R' THEN ' REFUNDED' ELSE 'settled ' END AS kind, floor(l_extendedprice / 8) * 8 AS whole, l_partkey % 20 = 0 AS torn
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE year(l_shipdate) = 1997)
      SELECT kind, count(*) AS n, count(*) FILTER (l_quantity <> 1) AS m FROM t WHERE NOT torn GROUP BY kind UNION ALL SELECT 'quarantined', count(*), 25 FROM t WHERE torn""",
    "q39_csv_feed": """SELECT 'm' || p_partkey AS merchant_id, ' ' || p_name || ', "the" ' || p_size AS merchant_name, p_size::VARCHAR AS mcc, CASE WHEN p_partkey % 10 <> 0 THEN p_type || ' ' END AS category, lower(p_brand[1:2]) AS country FROM part""",
    "q40_partition_rerun": "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN -o_custkey ELSE o_custkey END AS customer, o_orderstatus FROM orders WHERE o_orderkey >= 10 AND (o_orderstatus <> 'F' OR o_orderkey % 2 = 0)",
    "q41_check_suite": f"""WITH {_TXN}, t AS (SELECT * FROM raw), k AS (SELECT 'c' || user_id AS card_id FROM events WHERE user_id <> 7)
      SELECT check_type, target, severity, passed, observed::DOUBLE AS observed FROM (
        SELECT 'row_count_min' AS check_type, '*' AS target, 'fail' AS severity, count(*) >= 10 AS passed, count(*) AS observed FROM t
        UNION ALL SELECT 'not_null', 'member_id', 'fail', count(*) = count(member_id), count(*) - count(member_id) FROM t
        UNION ALL SELECT 'unique', 'txn_id', 'warn', count(txn_id) = count(DISTINCT txn_id), count(txn_id) - count(DISTINCT txn_id) FROM t
        UNION ALL SELECT 'accepted_values', 'status', 'warn', count(*) FILTER (status = 'odd') = 0, count(*) FILTER (status = 'odd') FROM t
        UNION ALL SELECT 'range', 'amount', 'warn', count(*) FILTER (amount < 800 OR amount > 80000) = 0, count(*) FILTER (amount < 800 OR amount > 80000) FROM t
        UNION ALL SELECT 'freshness_days_max', 'txn_ts', 'fail', date_diff('day', max(stamp[1:10])::DATE, DATE '{AS_OF}') <= 30, date_diff('day', max(stamp[1:10])::DATE, DATE '{AS_OF}') FROM t
        UNION ALL SELECT 'unique_composite', 'txn_id,merchant_id', 'fail', count(*) = count(DISTINCT (txn_id, merchant_id)), count(*) - count(DISTINCT (txn_id, merchant_id)) FROM t WHERE txn_id IS NOT NULL
        UNION ALL SELECT 'referential_integrity', 'card_id', 'fail', count(DISTINCT card_id) = 0, count(DISTINCT card_id) FROM t WHERE card_id NOT IN (SELECT card_id FROM k))""",
}
