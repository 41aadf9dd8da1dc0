-- Database and gold tables, as rendered from the contracts.
CREATE DATABASE IF NOT EXISTS {database};

CREATE TABLE IF NOT EXISTS {database}.card_roi_monthly (
  member_id STRING NOT NULL,
  card_id STRING NOT NULL,
  product_name STRING,
  issuer STRING,
  month STRING NOT NULL,
  txn_count BIGINT,
  merchant_count BIGINT,
  spend_usd DOUBLE,
  refund_usd DOUBLE COMMENT 'Zero or negative',
  net_spend_usd DOUBLE,
  bonus_category_spend_usd DOUBLE,
  points_earned DOUBLE,
  reward_value_usd DOUBLE,
  annual_fee_usd DOUBLE COMMENT 'Highest fee among the versions used in the month',
  monthly_fee_usd DOUBLE,
  net_value_usd DOUBLE,
  roi_ratio DOUBLE COMMENT 'Null without a fee',
  effective_return_pct DOUBLE,
  bonus_spend_share_pct DOUBLE,
  fee_verdict STRING,
  month_value_rank INT
)
USING parquet
COMMENT 'What a card earned its holder in a month against the month of its fee'
LOCATION '{warehouse}/gold/card_roi_monthly'
TBLPROPERTIES ('owner_team' = 'data-engineering', 'grain' = 'member_id,card_id,month', 'pii_columns' = 'member_id');

CREATE TABLE IF NOT EXISTS {database}.member_rewards_summary (
  member_id STRING NOT NULL,
  txn_count BIGINT,
  card_count BIGINT,
  active_months BIGINT,
  lifetime_spend_usd DOUBLE,
  lifetime_points DOUBLE,
  lifetime_reward_usd DOUBLE,
  first_txn_date DATE,
  last_txn_date DATE,
  effective_return_pct DOUBLE,
  top_category STRING,
  top_category_spend_usd DOUBLE,
  best_card_id STRING,
  best_card_product STRING,
  best_card_net_value_usd DOUBLE,
  value_tier STRING
)
USING parquet
COMMENT 'One row per member: totals, best category, best card, tier'
LOCATION '{warehouse}/gold/member_rewards_summary'
TBLPROPERTIES ('owner_team' = 'data-engineering', 'grain' = 'member_id', 'pii_columns' = 'member_id');

CREATE TABLE IF NOT EXISTS {database}.merchant_category_spend (
  month STRING NOT NULL,
  category STRING NOT NULL,
  txn_count BIGINT,
  member_count BIGINT,
  merchant_count BIGINT,
  spend_usd DOUBLE,
  avg_ticket_usd DOUBLE,
  points_earned DOUBLE,
  reward_value_usd DOUBLE,
  effective_return_pct DOUBLE,
  pct_of_month_spend DOUBLE,
  spend_rank INT
)
USING parquet
COMMENT 'Spend by month and category, with shares and ranks'
LOCATION '{warehouse}/gold/merchant_category_spend'
TBLPROPERTIES ('owner_team' = 'data-engineering', 'grain' = 'month,category');

CREATE TABLE IF NOT EXISTS {database}.transaction_rewards (
  txn_id STRING NOT NULL,
  member_id STRING NOT NULL,
  card_id STRING NOT NULL,
  card_sk STRING COMMENT 'Version of the card in force on the day',
  product_name STRING,
  issuer STRING,
  network STRING,
  merchant_id STRING,
  merchant_name STRING,
  category STRING,
  mcc STRING,
  country STRING,
  channel STRING,
  txn_ts TIMESTAMP,
  txn_date DATE,
  amount_usd DOUBLE,
  rule_id STRING COMMENT 'Rule that earned the bonus, or BASE_EARN',
  base_earn_rate DOUBLE,
  applied_multiplier DOUBLE,
  bonus_eligible_usd DOUBLE COMMENT 'Part of the amount below the monthly cap',
  points_earned DOUBLE,
  point_value_cents DOUBLE,
  reward_value_usd DOUBLE,
  annual_fee_usd DOUBLE,
  month STRING NOT NULL COMMENT 'yyyy-MM'
)
USING parquet
PARTITIONED BY (month)
COMMENT 'Points and their value for each settled transaction'
LOCATION '{warehouse}/gold/transaction_rewards'
TBLPROPERTIES ('owner_team' = 'data-engineering', 'grain' = 'txn_id', 'pii_columns' = 'member_id');
