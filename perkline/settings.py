"""Run settings: YAML file, then the overlay of the environment, then environment variables, then flags."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import yaml

from perkline.sources.storage import join_uri

CONF_DIR = Path(__file__).parent / "conf"
#: Environment variable -> place in the settings.
OVERRIDES = {
    "RP_APP_NAME": ("app_name",), "RP_LANDING_PATH": ("paths", "landing"), "RP_WAREHOUSE_PATH": ("paths", "warehouse"),
    "RP_REPORTS_PATH": ("paths", "reports"), "SPARK_SHUFFLE_PARTITIONS": ("spark", "shuffle_partitions"),
}


def merged(base: Mapping[str, Any], over: Mapping[str, Any]) -> dict[str, Any]:
    """Mappings merge key by key; anything else is replaced."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out


def is_local(uri: str) -> bool:
    return "://" not in uri or uri.startswith("file:")


@dataclass(frozen=True)
class Settings:
    environment: str
    raw: dict[str, Any]
    expectations: dict[str, list[dict[str, Any]]] = field(default_factory=dict)

    @property
    def app_name(self) -> str:
        return self.raw["app_name"]

    @property
    def landing(self) -> str:
        return self.raw["paths"]["landing"]

    @property
    def warehouse(self) -> str:
        return self.raw["paths"]["warehouse"]

    @property
    def reports(self) -> str:
        """A folder of the driver; the warehouse itself when that is local."""
        told = self.raw["paths"].get("reports")
        if told:
            if not is_local(told):
                raise ValueError("reports must be a local folder")
            return told.removeprefix("file://")
        if not is_local(self.warehouse):
            raise ValueError("set paths.reports: the warehouse is not local")
        return self.warehouse.removeprefix("file://")

    @property
    def database(self) -> str:
        return self.raw["catalog"]["database"]

    @property
    def default_severity(self) -> str:
        return self.raw.get("quality", {}).get("on_breach_default", "fail")

    def tables(self, layer: str) -> list[str]:
        return list(self.raw["layers"][layer])

    def quarantine_path(self, name: str) -> str:
        return join_uri(self.warehouse, self.raw.get("quality", {}).get("quarantine_path", "_quarantine"), name)

    def checks(self, table: str) -> list[dict[str, Any]]:
        return self.expectations.get(table, [])


def load_settings(path: str | Path | None = None, environ: Mapping[str, str] | None = None) -> Settings:
    env = os.environ if environ is None else environ
    file = Path(path) if path else CONF_DIR / "perkline.yaml"
    raw = yaml.safe_load(file.read_text()) or {}
    name = env.get("RP_ENV", "local")
    overlay = file.with_name(f"{file.stem}.{name}.yaml")
    if overlay.exists():
        raw = merged(raw, yaml.safe_load(overlay.read_text()) or {})
    elif name != "local":
        raise FileNotFoundError(f"no settings for environment {name}: {overlay}")
    for variable, place in OVERRIDES.items():
        if env.get(variable):
            value: Any = int(env[variable]) if place[-1] == "shuffle_partitions" else env[variable]
            for key in reversed(place):
                value = {key: value}
            raw = merged(raw, value)
    checks = file.with_name("expectations.yaml")
    return Settings(name, raw, yaml.safe_load(checks.read_text()) or {} if checks.exists() else {})
