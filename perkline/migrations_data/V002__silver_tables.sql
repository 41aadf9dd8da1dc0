-- Silver tables for analysts, as rendered from the contracts.
CREATE TABLE IF NOT EXISTS {database}.silver_cards (
  card_sk STRING NOT NULL COMMENT 'Key of the version',
  card_id STRING NOT NULL COMMENT 'Key of the card',
  product_name STRING,
  issuer STRING,
  network STRING,
  annual_fee_usd DOUBLE,
  base_earn_rate DOUBLE COMMENT 'Points for a dollar',
  point_value_cents DOUBLE,
  version_no BIGINT,
  attr_hash STRING COMMENT 'Digest of the tracked columns',
  valid_from DATE NOT NULL,
  valid_to DATE NOT NULL COMMENT 'Inclusive; 9999-12-31 while open',
  is_current BOOLEAN NOT NULL,
  last_seen_date DATE
)
USING parquet
COMMENT 'Versions of card products with the days they were in force'
LOCATION '{warehouse}/silver/cards'
TBLPROPERTIES ('owner_team' = 'data-engineering', 'grain' = 'card_sk');

CREATE TABLE IF NOT EXISTS {database}.silver_transactions (
  txn_id STRING NOT NULL COMMENT 'Identifier of the transaction',
  member_id STRING NOT NULL COMMENT 'Card holder',
  card_id STRING NOT NULL COMMENT 'Card product',
  merchant_id STRING,
  mcc STRING COMMENT 'Four-digit merchant category code',
  amount DOUBLE COMMENT 'Amount in its own currency',
  currency STRING,
  usd_rate DOUBLE COMMENT 'Dollars for one unit on the day',
  amount_usd DOUBLE COMMENT 'Negative for refunds',
  txn_ts TIMESTAMP,
  txn_date DATE,
  status STRING,
  is_refund BOOLEAN,
  channel STRING,
  source_system STRING,
  _batch_id STRING COMMENT 'Ingestion batch',
  _ingested_at TIMESTAMP,
  ingest_date DATE NOT NULL COMMENT 'Day the row landed'
)
USING parquet
PARTITIONED BY (ingest_date)
COMMENT 'Valid card transactions, one row each, amounts in dollars at the rate of their day'
LOCATION '{warehouse}/silver/transactions'
TBLPROPERTIES ('owner_team' = 'data-engineering', 'grain' = 'txn_id', 'pii_columns' = 'member_id');
