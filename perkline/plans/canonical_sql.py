"""SQL twins of the queries in `canonical`, written against the driver's tables."""

from __future__ import annotations

from perkline.plans.canonical import AS_OF, RATES, RULES


def _text(x: str | None) -> str:
    return "NULL" if x is None else f"'{x}'"


_RULES = "rules(rule_id, card_id, category, multiplier, cap, since, till) AS (SELECT c0, c1::BIGINT, c2, c3::DECIMAL(6,2), c4::DECIMAL(18,2), c5::DATE, c6::DATE FROM (VALUES " + ", ".join(f"({_text(r[0])}, {r[1]}, {', '.join(_text(x) for x in r[2:])})" for r in RULES) + ") v(c0, c1, c2, c3, c4, c5, c6))"
_RATES = "rates(currency, year, usd_rate) AS (SELECT c0, c1, c2::DECIMAL(10,4) FROM (VALUES " + ", ".join(f"('{c}', {y}, '{r[y % 2]}')" for c, r in RATES.items() for y in range(1990, 2010)) + ") v(c0, c1, c2))"
_TXN = f"""{_RATES},
deliveries AS (
  SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, o_custkey AS member_id, l_suppkey % 12 AS card_id, l_suppkey, l_partkey AS merchant_id,
    CASE WHEN l_quantity <> 1 THEN round((l_extendedprice::DECIMAL(12,2) * (1 - l_discount::DECIMAL(4,2)))::DECIMAL(18,4), 2)::DECIMAL(18,2) END AS amount,
    l_shipdate::DATE AS txn_date, l_returnflag = 'R' AS is_refund,
    row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC) AS n
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
valued AS (
  SELECT t.* EXCLUDE (n), upper(trim(r_name)) AS currency, usd_rate, round((amount * usd_rate)::DECIMAL(30,6) * CASE WHEN is_refund THEN -1 ELSE 1 END, 2)::DECIMAL(18,2) AS amount_usd
  FROM (SELECT * FROM deliveries WHERE n = 1) t
  LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN rates x ON x.currency = upper(trim(r_name)) AND x.year = year(txn_date)),
txn AS (
  SELECT *, CASE WHEN amount IS NULL THEN 'missing_amount' WHEN usd_rate IS NULL THEN 'unknown_currency' WHEN txn_date > DATE '2001-06-30' THEN 'late' END AS reason FROM valued)"""
_MATCHED = f"""{_TXN}, {_RULES},
settled AS (
  SELECT t.*, strftime(txn_date, '%Y-%m') AS month, lower(trim(p_type)) AS category FROM txn t LEFT JOIN part ON merchant_id = p_partkey WHERE reason IS NULL AND NOT is_refund),
matched AS (
  SELECT * EXCLUDE (k) FROM (
    SELECT s.*, r.rule_id, r.multiplier, r.cap, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY r.multiplier DESC NULLS LAST, r.rule_id NULLS LAST) AS k
    FROM settled s LEFT JOIN rules r ON r.card_id = s.card_id AND r.category = s.category AND s.txn_date >= r.since AND (r.till IS NULL OR s.txn_date <= r.till)) WHERE k = 1)"""
_CAPPED = f"""{_MATCHED},
capped AS (
  SELECT *, CASE WHEN rule_id IS NULL THEN 0 WHEN cap IS NULL THEN amount_usd ELSE greatest(0, least(amount_usd, cap - (running - greatest(amount_usd, 0)))) END::DECIMAL(18,2) AS eligible
  FROM (SELECT *, sum(greatest(amount_usd, 0)) OVER (PARTITION BY member_id, card_id, month, rule_id ORDER BY txn_date, l_orderkey, l_linenumber ROWS UNBOUNDED PRECEDING) AS running FROM matched))"""
_FACT = f"""{_CAPPED},
fact AS (
  SELECT *, round(points * 0.0125::DECIMAL(6,4), 2)::DECIMAL(18,2) AS value FROM (
    SELECT *, round((amount_usd * base + eligible * (coalesce(multiplier, base) - base))::DECIMAL(26,4), 2)::DECIMAL(18,2) AS points
    FROM (SELECT *, (CASE WHEN card_id % 3 = 0 THEN '1.00' ELSE '1.50' END)::DECIMAL(4,2) AS base FROM capped)))"""
_ROI = f"""{_FACT},
earned AS (
  SELECT member_id, card_id, month, count(*) AS txn_count, count(DISTINCT merchant_id) AS merchant_count, sum(amount_usd) AS spend, sum(value) AS value,
    sum(CASE WHEN rule_id IS NOT NULL THEN amount_usd ELSE 0 END) AS bonus_spend FROM fact GROUP BY ALL),
back AS (SELECT member_id, card_id, strftime(txn_date, '%Y-%m') AS month, sum(amount_usd) AS refund FROM txn WHERE reason IS NULL AND is_refund GROUP BY ALL),
roi AS (
  SELECT *, CASE WHEN net_value >= 0 OR fee = 0 THEN 'keep' ELSE 'review' END AS verdict, rank() OVER (PARTITION BY month ORDER BY net_value DESC) AS value_rank FROM (
    SELECT *, value - fee AS net_value FROM (
      SELECT e.*, coalesce(refund, 0)::DECIMAL(18,2) AS refund, spend + coalesce(refund, 0)::DECIMAL(18,2) AS net_spend, round(e.card_id * 50 / 12.0, 2)::DECIMAL(18,2) AS fee
      FROM earned e LEFT JOIN back b USING (member_id, card_id, month))))"""
_TOP_CATEGORY = """top_category AS (
  SELECT member_id, category AS top_category, spend::DOUBLE AS category_spend FROM (
    SELECT member_id, category, sum(amount_usd) AS spend, row_number() OVER (PARTITION BY member_id ORDER BY sum(amount_usd) DESC, category) AS n FROM fact WHERE category IS NOT NULL GROUP BY member_id, category) WHERE n = 1)"""
_BEST_CARD = """best_card AS (
  SELECT member_id, card_id AS best_card, net::DOUBLE AS card_net FROM (
    SELECT member_id, card_id, sum(net_value) AS net, row_number() OVER (PARTITION BY member_id ORDER BY sum(net_value) DESC, card_id) AS n FROM roi GROUP BY member_id, card_id) WHERE n = 1)"""
_VERSIONS = """daily AS (SELECT user_id, day, event_type FROM (SELECT *, ts::DATE AS day, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1),
flagged AS (SELECT *, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM daily WINDOW w AS (PARTITION BY user_id ORDER BY day)),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY day ROWS UNBOUNDED PRECEDING) AS version_no FROM flagged),
held AS (SELECT user_id, version_no::BIGINT AS version_no, max(event_type) AS event_type, min(day) AS valid_from, max(day) AS last_seen_date FROM numbered GROUP BY user_id, version_no),
versions AS (
  SELECT user_id, version_no, event_type, valid_from, coalesce((lead(valid_from) OVER w - INTERVAL 1 DAY)::DATE, DATE '9999-12-31') AS valid_to, lead(valid_from) OVER w IS NULL AS is_current, last_seen_date
  FROM held WINDOW w AS (PARTITION BY user_id ORDER BY version_no))"""


def _check(kind: str, passed: str, observed: str, source: str) -> str:
    return f"SELECT '{kind}' AS check_type, {passed} AS passed, ({observed})::DOUBLE AS observed FROM (SELECT {source})"


SQL = {
    "q01_typed_scan": "SELECT o_orderkey, o_totalprice::DECIMAL(14,2)::DOUBLE AS price, o_orderdate::DATE AS day, trim(o_orderstatus) AS status FROM orders",
    "q02_normalize_strings": "SELECT p_partkey, upper(trim(p_name)) AS name, lower(trim(p_type)) AS category, lpad(trim(p_size::VARCHAR), 4, '0') AS code FROM part",
    "q03_try_cast": "SELECT o_orderkey, try_cast(substr(o_orderpriority, 1, 1) AS INT)::BIGINT AS level, try_cast(o_orderpriority AS INT)::BIGINT AS whole, try_cast(o_orderstatus AS DOUBLE) AS none FROM orders",
    "q04_dedup_latest": "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, l_suppkey, l_shipdate::DATE AS day FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC) AS n FROM lineitem) WHERE n = 1",
    "q05_fx_signed": f"WITH {_TXN} SELECT l_orderkey, l_linenumber, currency, amount::DOUBLE AS amount, usd_rate::DOUBLE AS usd_rate, amount_usd::DOUBLE AS amount_usd FROM txn",
    "q06_reject_reason": f"WITH {_TXN} SELECT coalesce(reason, 'valid') AS reason, count(*) AS n FROM txn GROUP BY 1",
    "q07_valid_partition": f"WITH {_TXN} SELECT l_orderkey, l_linenumber, member_id, card_id, amount_usd::DOUBLE AS amount_usd, is_refund FROM txn WHERE reason IS NULL",
    "q08_scd2_versions": f"WITH {_VERSIONS} SELECT * FROM versions",
    "q09_scd2_current": f"WITH {_VERSIONS} SELECT user_id, version_no, event_type, valid_from FROM versions WHERE is_current",
    "q10_asof_enrich": f"WITH {_VERSIONS} SELECT e.event_id, e.user_id, e.ts::DATE AS day, v.event_type AS state, v.version_no FROM events e LEFT JOIN versions v ON v.user_id = e.user_id AND e.ts::DATE BETWEEN v.valid_from AND v.valid_to WHERE e.event_type = 'purchase'",
    "q11_best_rule": f"WITH {_MATCHED} SELECT l_orderkey, l_linenumber, category, coalesce(rule_id, 'BASE_EARN') AS rule_id, multiplier::DOUBLE AS multiplier, cap::DOUBLE AS cap FROM matched",
    "q12_capped_running": f"WITH {_CAPPED} SELECT l_orderkey, l_linenumber, rule_id, amount_usd::DOUBLE AS amount_usd, eligible::DOUBLE AS eligible FROM capped",
    "q13_points_fact": f"WITH {_FACT} SELECT l_orderkey, l_linenumber, member_id, card_id, month, amount_usd::DOUBLE AS amount_usd, base::DOUBLE AS base, eligible::DOUBLE AS eligible, points::DOUBLE AS points, value::DOUBLE AS value FROM fact",
    "q14_roi_monthly": f"""WITH {_ROI} SELECT member_id, card_id, month, txn_count, merchant_count, spend::DOUBLE AS spend, value::DOUBLE AS value, bonus_spend::DOUBLE AS bonus_spend, refund::DOUBLE AS refund, net_spend::DOUBLE AS net_spend,
      fee::DOUBLE AS fee, net_value::DOUBLE AS net_value, verdict, value_rank, round(100 * value::DOUBLE / nullif(spend::DOUBLE, 0), 3) AS return_pct, CASE WHEN fee > 0 THEN round(value::DOUBLE / fee::DOUBLE, 3) END AS roi FROM roi""",
    "q15_category_share": f"""WITH {_FACT}, sums AS (
      SELECT month, category, count(*) AS txn_count, count(DISTINCT member_id) AS member_count, count(DISTINCT merchant_id) AS merchant_count, sum(amount_usd) AS spend, sum(value) AS value FROM fact WHERE category IS NOT NULL GROUP BY month, category)
      SELECT month, category, txn_count, member_count, merchant_count, spend::DOUBLE AS spend, value::DOUBLE AS value, round(100 * spend::DOUBLE / nullif((sum(spend) OVER (PARTITION BY month))::DOUBLE, 0), 2) AS pct, rank() OVER (PARTITION BY month ORDER BY spend DESC) AS spend_rank FROM sums""",
    "q16_member_summary": f"""WITH {_ROI}, {_TOP_CATEGORY}, {_BEST_CARD}, whole AS (
      SELECT member_id, count(*) AS txn_count, count(DISTINCT card_id) AS card_count, count(DISTINCT month) AS active_months, sum(amount_usd) AS spend, sum(value) AS value, min(txn_date) AS first_day, max(txn_date) AS last_day FROM fact GROUP BY member_id)
      SELECT w.* REPLACE (spend::DOUBLE AS spend, value::DOUBLE AS value), top_category, category_spend, best_card, card_net, round(100 * value::DOUBLE / nullif(spend::DOUBLE, 0), 3) AS return_pct,
        CASE WHEN spend >= 2000000 THEN 'platinum' WHEN spend >= 800000 THEN 'gold' WHEN spend >= 200000 THEN 'silver' ELSE 'bronze' END AS tier
      FROM whole w LEFT JOIN top_category USING (member_id) LEFT JOIN best_card USING (member_id)""",
    "q17_top_category": f"WITH {_FACT}, {_TOP_CATEGORY} SELECT * FROM top_category",
    "q18_best_card": f"WITH {_ROI}, {_BEST_CARD} SELECT * FROM best_card",
    "q19_check_row_count": _check("row_count_min", "n >= 1000", "n", "count(*) AS n FROM lineitem WHERE l_returnflag = 'R'"),
    "q20_check_not_null": _check("not_null", "n = 0", "n", "count(*) - count(o_orderdate) AS n FROM orders"),
    "q21_check_unique": _check("unique", "n = 0", "n", "count(*) - count(DISTINCT l_orderkey) AS n FROM lineitem"),
    "q22_check_unique_composite": _check("unique_composite", "n = 0", "n", "sum(c - 1) AS n FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey, l_linenumber)"),
    "q23_check_accepted_values": _check("accepted_values", "n = 0", "n", "count(*) AS n FROM lineitem WHERE l_returnflag NOT IN ('A', 'N')"),
    "q24_check_range": _check("range", "n = 0", "n", "count(*) AS n FROM lineitem WHERE l_quantity > 40"),
    "q25_check_corrupt_ratio": _check("corrupt_ratio_max", "n <= 0.02", "n", "round(count(*) FILTER (o_orderkey % 50 = 0) / count(*)::DOUBLE, 4) AS n FROM orders"),
    "q26_check_freshness": _check("freshness_days_max", "n <= 45", "n", f"date_diff('day', max(ts)::DATE, DATE '{AS_OF}') AS n FROM events"),
    "q27_check_referential": _check("referential_integrity", "n = 0", "n", "count(DISTINCT l_orderkey) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')"),
    "q28_reject_histogram": f"WITH {_TXN} SELECT reason, count(*) AS n FROM txn WHERE reason IS NOT NULL GROUP BY reason",
    "q29_schema_drift": """WITH have AS (SELECT column_name AS name, lower(data_type) AS type FROM information_schema.columns WHERE table_name = 'orders'),
      want(name, type) AS (VALUES ('o_orderkey', 'bigint'), ('customer', 'bigint'), ('o_totalprice', 'decimal(14,2)'), ('o_orderstatus', 'varchar'))
      SELECT CASE WHEN h.name IS NULL THEN 'missing' WHEN w.name IS NULL THEN 'undeclared' ELSE 'mismatch' END AS kind, coalesce(w.name, h.name) AS name, CASE WHEN w.name IS NULL OR h.name IS NULL THEN '' ELSE w.type || ' ' || h.type END AS types
      FROM want w FULL JOIN have h ON w.name = h.name WHERE w.type IS DISTINCT FROM h.type""",
    "q30_corrupt_split": "SELECT CASE WHEN event_id % 10 = 0 THEN 'broken' ELSE event_type END AS kind, count(*) AS n, count(*) FILTER (event_id % 10 = 0) AS broken FROM events GROUP BY 1",
}
