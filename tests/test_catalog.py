from pathlib import Path

import pytest

from perkline import cli, migrations
from perkline.contracts import Contract, ContractError, check_drift, compare, find_contract, load_contracts, parse_contract, render_ddl, sql_literal
from perkline.migrations import MigrationError, discover, migrate, pending, split_statements
from perkline.settings import load_settings, merged

DEMO = {"table": "demo", "layer": "gold", "owner": "team", "grain": ["id"], "columns": [{"name": "id", "type": "string", "nullable": False}, {"name": "amount", "type": "double", "description": "month's \\ spend"}]}


def test_contracts_that_contradict_themselves():
    for change in ({"owner": ""}, {"grain": ["x"]}, {"partitioned_by": ["x"]}, {"columns": DEMO["columns"] * 2}, {"columns": [{"name": "id"}]}):
        with pytest.raises(ContractError):
            parse_contract(DEMO | change)


def test_shipped_contracts():
    found = load_contracts()
    assert [c.full_name for c in found] == sorted(c.full_name for c in found) and len(found) == 6
    assert find_contract("gold.card_roi_monthly").grain == ("member_id", "card_id", "month")
    assert "member_id" in find_contract("silver.transactions").pii
    with pytest.raises(ContractError):
        find_contract("gold.nothing")


def test_ddl():
    ddl = render_ddl(parse_contract(DEMO | {"partitioned_by": ["id"]}), "db", "s3a://w/h")
    assert "id STRING NOT NULL" in ddl and "PARTITIONED BY (id)" in ddl and "LOCATION 's3a://w/h/gold/demo'" in ddl
    assert r"COMMENT 'month\'s \\ spend'" in ddl and "'owner_team' = 'team'" in ddl
    assert "{database}.silver_cards" in render_ddl(find_contract("silver.cards"))
    assert sql_literal("a\nb") == "'a b'"


def test_shipped_scripts_are_what_the_contracts_say():
    text = "\n".join(m.sql for m in discover())
    for c in load_contracts():
        assert render_ddl(c) in text


def test_drift(spark, tmp_path):
    c = parse_contract(DEMO)
    at = lambda name: str(tmp_path / name)
    assert [(d.checked, d.clean) for d in check_drift(spark, at("none"), [c])] == [(False, True)]
    for name, row, ddl in (("ok", ("a", 1.0), "amount double, id string"), ("renamed", ("a", 1.0), "id string, gross double"), ("typed", ("a", 1), "id string, amount long")):
        row = row[::-1] if name == "ok" else row
        spark.createDataFrame([row], ddl).write.parquet(at(f"{name}/gold/demo"))
    drift = {n: check_drift(spark, at(n), [c])[0] for n in ("ok", "renamed", "typed")}
    assert drift["ok"].clean
    assert (drift["renamed"].missing, drift["renamed"].undeclared) == (("amount",), ("gross",))
    assert drift["typed"].mismatched == (("amount", "double", "bigint"),)
    assert isinstance(c, Contract) and compare(c, c.struct()).clean


def test_split():
    assert len(split_statements("CREATE TABLE a (x INT) COMMENT 'one; two'; CREATE TABLE b (y INT)")) == 2
    assert split_statements("-- note; here\nSELECT 1 /* a; b */") == ["SELECT 1"]
    assert split_statements("SELECT 'it''s; fine'; SELECT 2;") == ["SELECT 'it''s; fine'", "SELECT 2"]
    assert split_statements(r"SELECT 'month\'s; x'; SELECT 2") == [r"SELECT 'month\'s; x'", "SELECT 2"]


def write(folder: Path, name: str, sql: str) -> None:
    (folder / name).write_text(sql)


def test_discovery(tmp_path):
    for n in (10, 9, 2):
        write(tmp_path, f"V{n}__s{n}.sql", "SELECT 1")
    assert [m.version for m in discover(tmp_path)] == [2, 9, 10]
    write(tmp_path, "V002__again.sql", "SELECT 1")
    with pytest.raises(MigrationError, match="twice"):
        discover(tmp_path)
    (tmp_path / "V002__again.sql").unlink()
    write(tmp_path, "first.sql", "SELECT 1")
    with pytest.raises(MigrationError, match="expected"):
        discover(tmp_path)


def test_apply_once_and_refuse_edits(spark, tmp_path):
    scripts, wh = tmp_path / "ddl", str(tmp_path / "wh")
    scripts.mkdir()
    write(scripts, "V001__db.sql", "CREATE DATABASE IF NOT EXISTS {database}; -- {other} stays")
    assert [m.version for m in migrate(spark, wh, "perk_test", folder=scripts, dry_run=True)] == [1]
    assert [m.version for m in migrate(spark, wh, "perk_test", "test", scripts)] == [1]
    write(scripts, "V002__view.sql", "CREATE OR REPLACE TEMP VIEW mig AS SELECT '{other}' AS x")
    assert [m.version for m in migrate(spark, wh, "perk_test", "test", scripts)] == [2]
    assert migrate(spark, wh, "perk_test", "test", scripts) == [] and spark.table("mig").first().x == "{other}"
    ledger = spark.read.parquet(migrations.ledger_path(wh)).orderBy("version").collect()
    assert [(r.version, r.environment, len(r.checksum)) for r in ledger] == [(1, "test", 16), (2, "test", 16)]
    write(scripts, "V001__db.sql", "SELECT 2")
    with pytest.raises(MigrationError, match="changed"):
        pending(discover(scripts), migrations.applied(spark, wh))
    spark.sql("DROP DATABASE perk_test CASCADE")


def test_settings(tmp_path):
    assert merged({"a": {"b": 1, "c": [1]}, "d": 2}, {"a": {"c": [2]}}) == {"a": {"b": 1, "c": [2]}, "d": 2}
    s = load_settings(environ={"RP_WAREHOUSE_PATH": "/w", "SPARK_SHUFFLE_PARTITIONS": "3"})
    assert (s.warehouse, s.reports, s.raw["spark"]["shuffle_partitions"], s.environment) == ("/w", "/w", 3, "local")
    prod = load_settings(environ={"RP_ENV": "prod"})
    assert prod.warehouse.startswith("s3a://") and not prod.reports.startswith("s3a") and prod.database == "loyalty_prod"
    assert prod.raw["spark"]["configs"]["spark.sql.session.timeZone"] == "UTC"
    with pytest.raises(ValueError):
        _ = load_settings(environ={"RP_WAREHOUSE_PATH": "s3a://b/w"}).reports
    with pytest.raises(FileNotFoundError):
        load_settings(environ={"RP_ENV": "nowhere"})


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setenv("RP_LANDING_PATH", str(tmp_path / "landing"))
    monkeypatch.setenv("RP_WAREHOUSE_PATH", str(tmp_path / "wh"))
    assert cli.main(["config"]) == 0 and "warehouse" in capsys.readouterr().out
    assert cli.main(["schema", "list"]) == 0 and cli.main(["schema", "render", "--table", "gold.card_roi_monthly"]) == 0
    assert "CREATE TABLE" in capsys.readouterr().out
    assert cli.main(["schema", "check", "--table", "gold.nothing"]) == 4
    assert cli.main(["schema", "check"]) == 0  # nothing is written yet
    spark.createDataFrame([("a",)], "member_id string").write.parquet(str(tmp_path / "wh/gold/card_roi_monthly"))
    assert cli.main(["schema", "check", "--table", "gold.card_roi_monthly"]) == 5
    (tmp_path / "landing" / "transactions" / "ingest_date=2026-09-20").mkdir(parents=True)
    (tmp_path / "landing" / "transactions" / "ingest_date=2026-09-20" / "t.json").write_text("")
    assert cli.main(["bronze", "--date", "2026-09-20"]) == 2  # an empty feed breaks row_count_min
