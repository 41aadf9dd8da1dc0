"""Table contracts: declared shape, owner and grain; DDL from them; and drift of what was written against them."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import yaml
from pyspark.sql import SparkSession
from pyspark.sql.types import StructType

from perkline.sources.storage import exists, join_uri

CONTRACT_DIR = Path(__file__).parent / "contracts_data"


class ContractError(ValueError):
    """A contract that contradicts itself or is not there."""


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    type: str
    nullable: bool = True
    description: str = ""
    pii: bool = False
    accepted_values: tuple[str, ...] = ()


@dataclass(frozen=True)
class Contract:
    layer: str
    table: str
    owner: str
    grain: tuple[str, ...]
    columns: tuple[ColumnSpec, ...]
    description: str = ""
    partitioned_by: tuple[str, ...] = ()

    @property
    def full_name(self) -> str:
        return f"{self.layer}.{self.table}"

    @property
    def pii(self) -> list[str]:
        return [c.name for c in self.columns if c.pii]

    def struct(self) -> StructType:
        return StructType.fromDDL(", ".join(f"`{c.name}` {c.type}" for c in self.columns))


def parse_contract(raw: Mapping[str, Any], origin: str = "contract") -> Contract:
    for key in ("layer", "table", "owner", "grain", "columns"):
        if not raw.get(key):
            raise ContractError(f"{origin}: {key} is missing")
    columns = []
    for c in raw["columns"]:
        if not c.get("name") or not c.get("type"):
            raise ContractError(f"{origin}: a column needs name and type")
        columns.append(ColumnSpec(c["name"], str(c["type"]).lower(), bool(c.get("nullable", True)), str(c.get("description", "")), bool(c.get("pii", False)), tuple(c.get("accepted_values", ()))))
    names = [c.name for c in columns]
    if twice := {n for n in names if names.count(n) > 1}:
        raise ContractError(f"{origin}: column declared twice: {', '.join(sorted(twice))}")
    parts = tuple(raw.get("partitioned_by", ()) or ())
    for what, used in (("grain", raw["grain"]), ("partitioned_by", parts)):
        if strange := [u for u in used if u not in names]:
            raise ContractError(f"{origin}: {what} uses undeclared columns: {', '.join(strange)}")
    return Contract(raw["layer"], raw["table"], raw["owner"], tuple(raw["grain"]), tuple(columns), str(raw.get("description", "")).strip(), parts)


def load_contracts(folder: Path = CONTRACT_DIR) -> list[Contract]:
    """All contracts below `folder`, by layer and table."""
    found = [parse_contract(yaml.safe_load(p.read_text()) or {}, str(p)) for p in sorted(folder.rglob("*.y*ml"))]
    return sorted(found, key=lambda c: (c.layer, c.table))


def find_contract(full_name: str, folder: Path = CONTRACT_DIR) -> Contract:
    for c in load_contracts(folder):
        if c.full_name == full_name:
            return c
    raise ContractError(f"no contract for {full_name}")


def sql_literal(text: str) -> str:
    """A SQL string in single quotes; backslashes and quotes are escaped by a backslash, line breaks become spaces."""
    return "'" + " ".join(text.split("\n")).replace("\\", "\\\\").replace("'", "\\'") + "'"


def catalog_name(c: Contract, database: str) -> str:
    """Gold tables carry their own names; those of other layers are prefixed with the layer."""
    return f"{database}.{c.table if c.layer == 'gold' else f'{c.layer}_{c.table}'}"


def render_ddl(c: Contract, database: str = "{database}", warehouse: str = "{warehouse}") -> str:
    """CREATE TABLE of the external Parquet table; with the defaults the places stay placeholders."""
    cols = ",\n".join(f"  {x.name} {x.type.upper()}{'' if x.nullable else ' NOT NULL'}" + (f" COMMENT {sql_literal(x.description)}" if x.description else "") for x in c.columns)
    tags = {"owner_team": c.owner, "grain": ",".join(c.grain)} | ({"pii_columns": ",".join(c.pii)} if c.pii else {})
    lines = [f"CREATE TABLE IF NOT EXISTS {catalog_name(c, database)} (\n{cols}\n)", "USING parquet"]
    if c.partitioned_by:
        lines.append(f"PARTITIONED BY ({', '.join(c.partitioned_by)})")
    if c.description:
        lines.append(f"COMMENT {sql_literal(c.description)}")
    lines += [f"LOCATION {sql_literal(join_uri(warehouse, c.layer, c.table))}", "TBLPROPERTIES (" + ", ".join(f"{sql_literal(k)} = {sql_literal(v)}" for k, v in tags.items()) + ")"]
    return "\n".join(lines) + ";"


@dataclass(frozen=True)
class Drift:
    """How a written table differs from its contract. `checked` is False where nothing was written yet."""

    full_name: str
    checked: bool = True
    missing: tuple[str, ...] = ()
    undeclared: tuple[str, ...] = ()
    mismatched: tuple[tuple[str, str, str], ...] = field(default=())

    @property
    def clean(self) -> bool:
        return not (self.missing or self.undeclared or self.mismatched)


def compare(c: Contract, written: StructType) -> Drift:
    """By name and exact type, in any order; nullability is not compared, since file readers relax it."""
    have = {f.name: f.dataType.simpleString() for f in written}
    want = {f.name: f.dataType.simpleString() for f in c.struct()}
    return Drift(c.full_name, True, tuple(n for n in want if n not in have), tuple(n for n in have if n not in want), tuple((n, want[n], have[n]) for n in want if n in have and want[n] != have[n]))


def check_drift(spark: SparkSession, warehouse: str, contracts: Iterable[Contract]) -> list[Drift]:
    out = []
    for c in contracts:
        path = join_uri(warehouse, c.layer, c.table)
        out.append(compare(c, spark.read.parquet(path).schema) if exists(spark, path) else Drift(c.full_name, checked=False))
    return out
