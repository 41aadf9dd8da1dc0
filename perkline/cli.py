"""Command line: perkline <command>. Exit codes: 0 done, 2 data quality, 3 migration, 4 no such contract, 5 drift."""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys
from collections.abc import Callable, Sequence
from datetime import date, timedelta

import yaml

from perkline import contracts, migrations
from perkline.plans.layers import STAGES
from perkline.quality import DataQualityError
from perkline.session import build_session
from perkline.settings import Settings, load_settings
from perkline.sources import seed
from perkline.sources.storage import read_table, table_exists

OK, QUALITY, MIGRATION, UNKNOWN, DRIFT = 0, 2, 3, 4, 5


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="perkline", description=__doc__)
    top.add_argument("--config", help="settings file")
    top.add_argument("--log-level", default=os.environ.get("RP_LOG_LEVEL", "INFO"))
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, *options: tuple, text: str) -> None:
        c = sub.add_parser(name, help=text)
        for flag, extra in options:
            c.add_argument(flag, **extra)

    day, feed = ("--date", {"help": "logical date, YYYY-MM-DD"}), ("--seed", {"action": "store_true", "help": "make the landing zone first"})
    command("seed", ("--end", {"help": "last day"}), text="make a synthetic landing zone")
    for stage in STAGES:
        command(stage, day, text=f"run the {stage} stage")
    command("run-all", day, feed, text="all stages")
    command("backfill", ("--days", {"type": int, "default": 14}), ("--end", {}), feed, text="bronze day by day, then silver and gold")
    command("config", text="print the settings in force")
    command("schema", ("action", {"choices": ["check", "render", "list"]}), ("--table", {"help": "<layer>.<table>"}), ("--resolved", {"action": "store_true", "help": "fill in database and warehouse"}), text="table contracts")
    command("migrate", ("--dry-run", {"action": "store_true"}), ("--repair-only", {"action": "store_true"}), text="apply DDL scripts")
    command("preview", ("--limit", {"type": int, "default": 10}), text="show the gold tables")
    return top


def _say(x: object) -> None:
    print(json.dumps(x, indent=2, default=str))


def _seed(s: Settings, end: str | None) -> None:
    _say({"seeded": seed.generate(s.landing, date.fromisoformat(end) if end else date.today(), s.raw.get("seed"))})


def _schema(args: argparse.Namespace, s: Settings) -> int:
    try:
        chosen = [contracts.find_contract(args.table)] if args.table else contracts.load_contracts()
    except contracts.ContractError as e:
        print(e, file=sys.stderr)
        return UNKNOWN
    if args.action == "list":
        _say([{"table": c.full_name, "owner": c.owner, "grain": list(c.grain), "columns": len(c.columns), "pii": c.pii} for c in chosen])
    elif args.action == "render":
        print("\n\n".join(contracts.render_ddl(c, *((s.database, s.warehouse) if args.resolved else ())) for c in chosen))
    else:
        found = contracts.check_drift(build_session(s), s.warehouse, chosen)
        _say([{"table": d.full_name, "status": "SKIP" if not d.checked else "OK" if d.clean else "DRIFT", "missing": d.missing, "undeclared": d.undeclared, "mismatched": d.mismatched} for d in found])
        return OK if all(d.clean for d in found) else DRIFT
    return OK


def _migrate(args: argparse.Namespace, s: Settings) -> int:
    spark = build_session(s)
    done = []
    if not args.repair_only:
        done = migrations.migrate(spark, s.warehouse, s.database, s.environment, dry_run=args.dry_run)
    repaired = [] if args.dry_run else migrations.repair_partitions(spark, s.database)
    _say({"pending" if args.dry_run else "applied": [f"V{m.version:03d}__{m.name}" for m in done], "repaired": repaired})
    return OK


def _preview(args: argparse.Namespace, s: Settings) -> int:
    spark = build_session(s)
    for t in s.tables("gold"):
        if table_exists(spark, s.warehouse, "gold", t):
            print(f"gold.{t}")
            read_table(spark, s.warehouse, "gold", t).show(args.limit, truncate=False)
    return OK


def _run(args: argparse.Namespace, s: Settings) -> int:
    if getattr(args, "seed", False):
        _seed(s, getattr(args, "end", None) or getattr(args, "date", None))
    spark = build_session(s)
    if args.command == "backfill":
        end = date.fromisoformat(args.end) if args.end else date.today()
        for back in range(args.days - 1, -1, -1):
            _say(STAGES["bronze"](spark, s, (end - timedelta(days=back)).isoformat()))
        for stage in ("silver", "gold"):
            _say(STAGES[stage](spark, s, end.isoformat()))
    else:
        for stage in STAGES if args.command == "run-all" else [args.command]:
            _say(STAGES[stage](spark, s, args.date))
    return OK


def main(argv: Sequence[str] | None = None) -> int:
    args = parser().parse_args(argv)
    logging.basicConfig(level=args.log_level.upper(), format="%(asctime)s %(levelname)s %(name)s %(message)s")
    s = load_settings(args.config)
    commands: dict[str, Callable[[argparse.Namespace, Settings], int]] = {"schema": _schema, "migrate": _migrate, "preview": _preview}
    try:
        if args.command == "config":
            print(yaml.safe_dump({"environment": s.environment, "reports": s.reports} | s.raw, sort_keys=True), end="")
            return OK
        if args.command == "seed":
            _seed(s, args.end)
            return OK
        return commands.get(args.command, _run)(args, s)
    except DataQualityError as e:
        logging.error("%s", e)
        return QUALITY
    except migrations.MigrationError as e:
        logging.error("%s", e)
        return MIGRATION
    except contracts.ContractError as e:
        logging.error("%s", e)
        return UNKNOWN


if __name__ == "__main__":
    sys.exit(main())
