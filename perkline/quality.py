"""Declarative expectations, evaluated in as few passes as possible.

A specification is a mapping with `type`, its arguments, and optionally `where` (a SQL predicate that scopes the check)
and `severity` (fail or warn). All checks but the distinct ones and referential integrity are conditional aggregates,
so one aggregate over the table answers them together; each distinct check and each reference adds one job.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import asdict, dataclass
from datetime import UTC, datetime
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perkline.operators.match import orphans
from perkline.sources.schemas import CORRUPT

#: Arguments that each type needs; `range` needs one bound at least.
NEEDS = {
    "row_count_min": {"value"}, "not_null": {"column"}, "unique": {"column"}, "unique_composite": {"columns"},
    "accepted_values": {"column", "values"}, "range": {"column"}, "corrupt_ratio_max": {"value"},
    "freshness_days_max": {"column", "value"}, "referential_integrity": {"column", "ref_table", "ref_column"},
}
SEVERITIES = ("fail", "warn")


class DataQualityError(RuntimeError):
    """At least one expectation of severity fail did not hold."""


class SpecError(ValueError):
    """A specification that cannot be evaluated."""


@dataclass(frozen=True)
class Outcome:
    table: str
    type: str
    target: str
    severity: str
    passed: bool
    observed: Any


def check_spec(spec: Mapping[str, Any], default_severity: str = "fail") -> str:
    """Raises SpecError for a malformed specification; returns its severity."""
    kind = spec.get("type")
    if kind not in NEEDS:
        raise SpecError(f"unknown expectation type: {kind!r}")
    if missing := NEEDS[kind] - spec.keys():
        raise SpecError(f"{kind} lacks {', '.join(sorted(missing))}")
    if kind == "range" and not {"min", "max"} & spec.keys():
        raise SpecError("range needs min or max")
    severity = spec.get("severity", default_severity)
    if severity not in SEVERITIES:
        raise SpecError(f"unknown severity: {severity!r}")
    return severity


def _aggregates(spec: Mapping[str, Any], has: set[str], now: datetime) -> dict[str, Column] | None:
    """Named aggregates of a single-pass check, None for the others."""
    scope = F.expr(spec["where"]) if spec.get("where") else F.lit(True)
    kind = spec["type"]
    count = lambda cond: F.count_if(scope & cond)
    if kind == "row_count_min":
        return {"n": F.count_if(scope)}
    if kind == "not_null":
        return {"n": count(F.col(spec["column"]).isNull())}
    if kind == "accepted_values":
        c = F.col(spec["column"])
        return {"n": count(c.isNotNull() & ~c.isin(list(spec["values"])))}
    if kind == "range":
        c, off = F.col(spec["column"]), F.lit(False)
        if spec.get("min") is not None:
            off = off | (c < spec["min"])
        if spec.get("max") is not None:
            off = off | (c > spec["max"])
        return {"n": count(F.coalesce(off, F.lit(False)))}
    if kind == "corrupt_ratio_max":
        bad = F.col(CORRUPT).isNotNull() if CORRUPT in has else F.lit(False)
        return {"n": count(bad), "of": F.count_if(scope)}
    if kind == "freshness_days_max":
        newest = F.max(F.when(scope, F.col(spec["column"]).try_cast("timestamp")))
        return {"n": F.datediff(F.lit(now).cast("timestamp").cast("date"), newest.cast("date"))}
    return None


def _judge(spec: Mapping[str, Any], got: Mapping[str, Any]) -> tuple[bool, Any]:
    kind, n = spec["type"], got["n"]
    if kind == "row_count_min":
        return n >= spec["value"], n
    if kind == "corrupt_ratio_max":
        share = round(n / got["of"], 4) if got["of"] else 0.0
        return share <= spec["value"], share
    if kind == "freshness_days_max":
        return n is not None and n <= spec["value"], n
    return n == 0, n


def evaluate(df: DataFrame, table: str, specs: Sequence[Mapping[str, Any]], lookup: Callable[[str], DataFrame] | None = None, default_severity: str = "fail", now: datetime | None = None) -> list[Outcome]:
    """The outcomes of all specifications, in their order. `lookup` gives the frame of a <layer>.<table> reference.
    The frame's caching is left as it is."""
    severities = [check_spec(s, default_severity) for s in specs]
    now = now or datetime.now(UTC).replace(tzinfo=None)
    single = {i: a for i, s in enumerate(specs) if (a := _aggregates(s, set(df.columns), now)) is not None}
    row = df.agg(*[a.alias(f"c{i}_{k}") for i, named in single.items() for k, a in named.items()]).first() if single else None
    out = []
    for i, (spec, severity) in enumerate(zip(specs, severities, strict=True)):
        kind = spec["type"]
        target = spec.get("column") or ",".join(spec.get("columns", ())) or "*"
        if i in single:
            passed, observed = _judge(spec, {k: row[f"c{i}_{k}"] for k in single[i]})
        else:
            scoped = df.where(spec["where"]) if spec.get("where") else df
            if kind == "referential_integrity":
                if lookup is None:
                    raise SpecError("referential_integrity needs a lookup of tables")
                n = orphans(scoped, spec["column"], lookup(spec["ref_table"]), spec["ref_column"]).count()
            else:
                # surplus rows of repeated keys; NULL is a value like any other
                keys = [spec["column"]] if kind == "unique" else list(spec["columns"])
                n = scoped.groupBy(*keys).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0))).first()[0]
            passed, observed = n == 0, n
        out.append(Outcome(table, kind, target, severity, bool(passed), observed))
    return out


def write_report(reports: str, table: str, outcomes: Sequence[Outcome]) -> Path:
    path = Path(reports) / "_quality" / f"{table}.json"
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps({"table": table, "checked_at": datetime.now(UTC).isoformat(), "results": [asdict(o) for o in outcomes]}, indent=2, default=str))
    return path


def enforce(outcomes: Sequence[Outcome]) -> None:
    """Raises for failed expectations of severity fail."""
    broken = [o for o in outcomes if not o.passed and o.severity == "fail"]
    if broken:
        raise DataQualityError("; ".join(f"{o.table}: {o.type}({o.target}) observed {o.observed}" for o in broken))


def gate(table: str, specs: Sequence[Mapping[str, Any]], reports: str | None = None, lookup: Callable[[str], DataFrame] | None = None, default_severity: str = "fail") -> Callable[[DataFrame], list[Outcome]]:
    """A gate for `publish`: evaluates, reports, then raises if need be."""

    def run(df: DataFrame) -> list[Outcome]:
        outcomes = evaluate(df, table, specs, lookup, default_severity) if specs else []
        if reports and outcomes:
            write_report(reports, table, outcomes)
        enforce(outcomes)
        return outcomes

    return run
