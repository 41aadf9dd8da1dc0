import json
import random
from datetime import date, datetime, timedelta
from pathlib import Path

import pytest
import yaml
from pyspark.sql import functions as F

from perkline.contracts import check_drift, load_contracts
from perkline.plans import gold, silver
from perkline.plans.layers import run_bronze, run_gold, run_silver
from perkline.quality import DataQualityError
from perkline.settings import CONF_DIR, Settings
from perkline.sources import seed, storage
from perkline.sources.storage import publish, read_feed, read_table, register_views, run_sql

NOON, LATER = datetime(2026, 9, 1, 12), datetime(2026, 9, 1, 13)
RAW = "txn_id string, member_id string, card_id string, merchant_id string, mcc string, amount double, currency string, txn_ts string, status string, is_refund boolean, channel string, source_system string, ingest_date date, _batch_id string, _source_file string, _ingested_at timestamp"


def raw(txn, member, amount, ccy, hour, status="settled", refund=False, batch="b1", at=NOON, merchant="R1"):
    return (txn, member, "C1", merchant, "5812", amount, ccy, hour if hour is None or "T" in hour else f"2026-09-01T{hour}:00:00", status, refund, "online", "core", date(2026, 9, 1), batch, batch.replace("b", "f"), at)


@pytest.fixture
def tagged(frame):
    rates = frame("rate_date date, currency string, usd_rate double", (date(2026, 9, 1), "USD", 1.0), (date(2026, 9, 1), "EUR", 1.10))
    rows = [
        raw("T1", "M1", 100.0, "USD", "10"), raw("T1", "M1", 100.0, "USD", "10", batch="b2", at=LATER), raw("T2", "M1", 50.0, " eur ", "11"), raw("T3", "M2", 20.0, "USD", "12", "refunded", True),
        raw("T4", "M2", 10.0, "XBT", "13"), raw("T5", "M2", None, "USD", "14"), raw("T6", "M2", 1.0, "USD", "Tnever"), raw("T7", None, 1.0, "USD", "10"), raw(None, "M1", 1.0, "USD", "10"),
        raw(None, "M2", 2.0, "USD", "10"), raw("T8", "M1", 1.0, "USD", "10", None), raw("T9", "M1", 1.0, "USD", "10", "odd"),
    ]
    return {(r.txn_id, r.member_id): r for r in silver.transactions(frame(RAW, *rows), rates).collect()}


def test_transactions_are_reduced_converted_and_tagged(tagged):
    assert tagged["T1", "M1"]._batch_id == "b2"
    assert {k[0]: r.amount_usd for k, r in tagged.items() if r._is_valid} == {"T1": 100.0, "T2": 55.0, "T3": -20.0}
    why = {k[0]: r._reject_reason for k, r in tagged.items() if k[0] and not r._is_valid}
    assert why == {"T4": "unknown_currency", "T5": "missing_amount", "T6": "unparseable_timestamp", "T7": "missing_entity_key", "T8": "missing_status", "T9": "unknown_status"}
    assert sum(r._reject_reason == "missing_txn_id" for r in tagged.values()) == 2  # each is kept, none is lost unseen


def test_card_history(frame):
    ddl = "card_id string, product_name string, issuer string, network string, annual_fee_usd double, base_earn_rate double, point_value_cents double, snapshot_date date, _ingested_at timestamp"
    row = lambda c, fee, base, d: (c, " Summit ", "Bank", "VISA", fee, base, 1.5, date(2026, 9, d), NOON)
    out = silver.cards(frame(ddl, row("C1", 250.0, 2.0, 1), row("C1", 250.0, 2.0, 2), row("C1", 300.0, 2.25, 3), row("C2", 0.0, 1.0, 1), row("C2", 0.0, 1.0, 3), row(None, 1.0, 1.0, 1))).orderBy("card_id", "version_no").collect()
    assert [(r.card_id, str(r.valid_from), str(r.valid_to), r.is_current, r.annual_fee_usd) for r in out] == [
        ("C1", "2026-09-01", "2026-09-02", False, 250.0), ("C1", "2026-09-03", "9999-12-31", True, 300.0), ("C2", "2026-09-01", "9999-12-31", True, 0.0),
    ]
    assert len({r.card_sk for r in out}) == 3 and out[0].network == "visa" and out[0].product_name == "Summit"


TXNS = "txn_id string, member_id string, card_id string, merchant_id string, mcc string, amount double, currency string, usd_rate double, amount_usd double, txn_ts timestamp, txn_date date, status string, is_refund boolean, channel string, source_system string, ingest_date date, _batch_id string, _ingested_at timestamp"
CARDS = "card_sk string, card_id string, product_name string, issuer string, network string, annual_fee_usd double, base_earn_rate double, point_value_cents double, valid_from date, valid_to date"
RULES = "rule_id string, card_id string, category string, multiplier double, monthly_cap_usd double, effective_from date, effective_to date"
SHOPS = "merchant_id string, merchant_name string, mcc string, category string, country string"


def world(seed):
    """Whole-dollar transactions of three members over two months, with versions of cards and overlapping rules."""
    rng = random.Random(seed)
    shops = [(f"s{i}", f"Shop {i}", "1111", ("ferry", "books", None)[i % 3], "NO") for i in range(6)]
    cards = [(f"{c}{v}", c, f"{c} v{v}", "Alder", "ring", fee, base, worth, since, till) for c, v, fee, base, worth, since, till in (
        ("blue", 1, 36.0, 1.0, 2.0, date(2025, 3, 1), date(2025, 4, 9)), ("blue", 2, 60.0, 2.0, 2.0, date(2025, 4, 10), date(9999, 12, 31)), ("red", 1, 0.0, 1.5, 1.0, date(2025, 3, 15), date(9999, 12, 31)))]
    rules = [("r1", "blue", "ferry", 4.0, 90.0, date(2025, 1, 1), None), ("r2", "blue", "ferry", 3.0, None, date(2025, 1, 1), None), ("r3", "blue", "books", 2.5, 40.0, date(2025, 4, 1), date(2025, 4, 20)), ("r4", "red", "books", 5.0, None, date(2025, 1, 1), None), ("r5", "red", "books", 5.0, 10.0, date(2025, 1, 1), None), ("r6", "red", "ferry", None, 20.0, date(2025, 1, 1), None)]
    txns = []
    for i in range(160):
        at = datetime(2025, 3, 1) + timedelta(minutes=rng.randrange(60 * 24 * 60))
        back = rng.random() < 0.15
        amount = float(2 * rng.randrange(1, 30)) * (-1 if back or rng.random() < 0.05 else 1)
        txns.append((f"t{i}", rng.choice("abc"), rng.choice(["blue", "red", "gone"]), rng.choice(shops)[0], "1111", abs(amount), "USD", 1.0, amount, at, at.date(), "refunded" if back else "settled", back, "web", "x", at.date(), "b", NOON))
    return txns, shops, cards, rules


def brute_rewards(txns, shops, cards, rules, clamp):
    """txn_id -> (rule, base rate, eligible, points, value), each transaction on its own."""
    category, out, used = {s[0]: s[3] for s in shops}, {}, {}
    for t in sorted(txns, key=lambda t: (t[9], t[0])):
        if t[11] != "settled":
            continue
        day, amount = t[10], t[8]
        version = next((c for c in cards if c[1] == t[2] and c[8] <= day <= c[9]), None)
        base, worth = (version[6], version[7]) if version else (1.0, 1.0)
        live = [r for r in rules if r[1] == t[2] and r[2] == category[t[3]] and r[5] <= day and (r[6] is None or day <= r[6])]
        rule = min(live, key=lambda r: (r[3] is None, -(r[3] or 0), r[0]), default=None)
        eligible = 0.0
        if rule:
            key = (t[1], t[2], day.strftime("%Y-%m"), rule[0])
            eligible = amount if rule[4] is None else max(0.0, min(amount, rule[4] - used.get(key, 0.0)))
            used[key] = used.get(key, 0.0) + (max(amount, 0.0) if clamp else amount)
        points = round(amount * base + eligible * ((rule[3] if rule and rule[3] is not None else base) - base), 2)
        out[t[0]] = (rule[0] if rule else "BASE_EARN", base, eligible, points, round(points * worth / 100, 2), version[5] if version else None)
    return out


@pytest.mark.parametrize("clamp", [True, False])
def test_rewards_and_marts_against_brute_force(frame, clamp):
    txns, shops, cards, rules = world(19)
    tx = frame(TXNS, *txns)
    rewards = gold.transaction_rewards(tx, frame(SHOPS, *shops), frame(CARDS, *cards), frame(RULES, *rules), negatives_free_room=not clamp).cache()
    want = brute_rewards(txns, shops, cards, rules, clamp)
    assert {r.txn_id: (r.rule_id, r.base_earn_rate, r.bonus_eligible_usd, r.points_earned, r.reward_value_usd, r.annual_fee_usd) for r in rewards.collect()} == want
    by_id = {t[0]: t for t in txns}

    def total(of, key):
        out = {}
        for t, v in of:
            out[key(by_id[t])] = out.get(key(by_id[t]), 0.0) + v
        return out

    month = lambda t: (t[1], t[2], t[10].strftime("%Y-%m"))
    spend, value = total([(t, by_id[t][8]) for t in want], month), total([(t, w[4]) for t, w in want.items()], month)
    back = total([(t[0], t[8]) for t in txns if t[11] == "refunded"], month)
    fee = {}
    for t, w in want.items():
        fee[month(by_id[t])] = max(fee.get(month(by_id[t]), 0.0), w[5] or 0.0)
    roi = gold.card_roi_monthly(rewards, tx)
    rows = roi.collect()
    assert len(rows) == len(spend)
    net = {k: round(value[k] - round(fee[k] / 12, 2), 2) for k in spend}
    for r in rows:
        k = (r.member_id, r.card_id, r.month)
        assert (r.spend_usd, r.refund_usd, r.net_spend_usd, r.reward_value_usd, r.net_value_usd) == pytest.approx((spend[k], back.get(k, 0.0), spend[k] + back.get(k, 0.0), value[k], net[k]))
        assert r.month_value_rank == 1 + sum(v > net[k] + 1e-9 for q, v in net.items() if q[2] == r.month) and r.fee_verdict == ("keep" if net[k] >= 0 or fee[k] == 0 else "review")
        assert r.roi_ratio is None if not fee[k] else r.roi_ratio == pytest.approx(round(value[k] / round(fee[k] / 12, 2), 3))
    category = {s[0]: s[3] for s in shops}
    per = total([(t, by_id[t][8]) for t in want if category[by_id[t][3]]], lambda t: (t[10].strftime("%Y-%m"), category[t[3]]))
    for r in gold.merchant_category_spend(rewards).collect():
        whole = sum(v for k, v in per.items() if k[0] == r.month)
        assert r.spend_usd == pytest.approx(per[r.month, r.category]) and r.pct_of_month_spend == pytest.approx(round(100 * r.spend_usd / whole, 2)) and r.avg_ticket_usd == pytest.approx(round(r.spend_usd / r.txn_count, 2))
    cats = total([(t, by_id[t][8]) for t in want if category[by_id[t][3]]], lambda t: (t[1], category[t[3]]))
    for r in gold.member_rewards_summary(rewards, roi).collect():
        mine = {k[1]: v for k, v in cats.items() if k[0] == r.member_id}
        best = min(mine, key=lambda k: (-mine[k], k))
        held = {}
        for (m, c, _), v in net.items():
            if m == r.member_id:
                held[c] = held.get(c, 0.0) + v
        assert (r.top_category, r.top_category_spend_usd) == (best, pytest.approx(mine[best])) and r.best_card_id == min(held, key=lambda k: (-round(held[k], 6), k))
        assert r.best_card_net_value_usd == pytest.approx(held[r.best_card_id]) and r.lifetime_spend_usd == pytest.approx(sum(v for k, v in spend.items() if k[0] == r.member_id))


@pytest.fixture
def settings(tmp_path):
    base = yaml.safe_load((CONF_DIR / "perkline.yaml").read_text())
    base["paths"] = {"landing": str(tmp_path / "landing"), "warehouse": str(tmp_path / "wh")}
    return Settings("test", base, yaml.safe_load((CONF_DIR / "expectations.yaml").read_text()))


def test_a_whole_run_and_a_rerun(spark, settings, tmp_path):
    small = {"members": 20, "cards": 4, "merchants": 10, "transactions_per_day": 200, "days": 2}
    end = date(2026, 9, 20)
    seed.generate(settings.landing, end, small)
    first = Path(settings.landing, "transactions", "ingest_date=2026-09-19", "lines.json").read_text()
    seed.generate(settings.landing, end, small)
    assert Path(settings.landing, "transactions", "ingest_date=2026-09-19", "lines.json").read_text() == first

    def run():
        for day in ("2026-09-19", "2026-09-20"):
            bronze = run_bronze(spark, settings, day)
        return bronze, run_silver(spark, settings, "2026-09-20"), run_gold(spark, settings, "2026-09-20")

    count = lambda layer, t: read_table(spark, settings.warehouse, layer, t).count()
    bronze, told, _ = run()
    assert bronze["tables"][0]["quarantined"] == seed.BROKEN
    valid, kept = count("silver", "transactions"), spark.read.parquet(settings.quarantine_path("bronze_transactions")).count()
    assert valid + told["tables"][-1]["rejected"] == 400 and kept == 2 * seed.BROKEN
    gold_rows = {t: count("gold", t) for t in settings.tables("gold")}
    run()
    assert count("silver", "transactions") == valid and spark.read.parquet(settings.quarantine_path("bronze_transactions")).count() == kept
    assert {t: count("gold", t) for t in settings.tables("gold")} == gold_rows
    assert all(d.checked and d.clean for d in check_drift(spark, settings.warehouse, load_contracts()))
    assert register_views(spark, settings.warehouse, "gold", ["transaction_rewards", "nothing"]) == ["gold_transaction_rewards"]
    assert run_sql(spark, "SELECT count(*) FROM gold_transaction_rewards WHERE month = :m", m="2026-09").first()[0] == gold_rows["transaction_rewards"]
    report = json.loads((tmp_path / "wh" / "_quality" / "silver.transactions.json").read_text())
    assert len(report["results"]) == 7 and (tmp_path / "wh" / "_runs" / "2026-09-20.jsonl").read_text().count("\n") == 6


def test_a_failed_gate_leaves_the_table_and_full_publish_drops_old_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    publish(spark.createDataFrame([(1, "a"), (2, "b")], "v int, p string"), path, ["p"])

    def refuse(df):
        raise DataQualityError("no")

    with pytest.raises(DataQualityError):
        publish(spark.createDataFrame([(9, "a")], "v int, p string"), path, ["p"], gate=refuse)
    assert spark.read.parquet(path).count() == 2
    publish(spark.createDataFrame([(3, "a")], "v int, p string"), path, ["p"], incremental=True)
    assert sorted(r.v for r in spark.read.parquet(path).collect()) == [2, 3]
    publish(spark.createDataFrame([(4, "a")], "v int, p string"), path, ["p"])
    assert [r.v for r in spark.read.parquet(path).collect()] == [4]
    assert [p.name for p in tmp_path.iterdir()] == ["t"]


def test_a_crash_between_two_moves_loses_nothing(spark, tmp_path, monkeypatch):
    path, whole = str(tmp_path / "wh" / "silver" / "t"), storage._rename
    rows = lambda *r: spark.createDataFrame(list(r), "v int, p string")
    published = publish(rows((1, "a"), (2, "b")), path, ["p"])
    assert published.rows == 2
    for incremental in (False, True):
        monkeypatch.setattr(storage, "_rename", lambda s, src, dst: (_ for _ in ()).throw(KeyboardInterrupt) if ".staging-" in src else whole(s, src, dst))
        with pytest.raises(KeyboardInterrupt):
            publish(rows((9, "a")), path, ["p"], incremental=incremental)
        monkeypatch.setattr(storage, "_rename", whole)
        assert sorted(r.v for r in read_table(spark, str(tmp_path / "wh"), "silver", "t").collect()) == [1, 2]
    publish(rows((3, "a")), path, ["p"], incremental=True)
    assert sorted(r.v for r in spark.read.parquet(path).collect()) == [2, 3] and [p.name for p in (tmp_path / "wh" / "silver").iterdir()] == ["t"]
    assert not [p for p in (tmp_path / "wh" / "silver" / "t").iterdir() if p.name.startswith("_old")]


def test_csv_feed_keeps_quotes(spark, tmp_path):
    folder = tmp_path / "merchants"
    folder.mkdir()
    (folder / "m.csv").write_text('merchant_id,merchant_name,mcc,category,country\nM1,"A ""b"", c",12,X,us\n')
    assert read_feed(spark, str(tmp_path), "merchants").first().merchant_name == 'A "b", c'


def test_feeds_are_made_in_local_folders_only(tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    for place in ("s3a://bucket/landing", "hdfs://host/landing", "gs://x"):
        with pytest.raises(ValueError, match="local"):
            seed.generate(place, date(2026, 9, 20), {"days": 1})
    assert not list(tmp_path.iterdir())
    told = seed.generate(f"file://{tmp_path}/in", date(2026, 9, 20), {"days": 2, "transactions_per_day": 30})
    assert sorted(p.name for p in (tmp_path / "in").iterdir()) == sorted(told)
    assert sum(1 for p in (tmp_path / "in" / "transactions").rglob("*.json") for _ in p.open()) == told["transactions"] + 2 * seed.BROKEN


def test_streaming_drops_late_copies(spark, tmp_path):
    from perkline.streaming.bronze import land_available, stream_transactions

    seed.generate(str(tmp_path / "landing"), date(2026, 9, 20), {"transactions_per_day": 50, "days": 2, "members": 5})
    for _ in range(2):
        land_available(stream_transactions(spark, str(tmp_path / "landing")), str(tmp_path / "t"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "t"))
    assert got.count() == got.select("txn_id").distinct().count() == 100 and got.where(F.col("ingest_date").isNull()).count() == 0
