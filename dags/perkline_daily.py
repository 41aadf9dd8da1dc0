"""Daily run on Airflow: is there a feed for the day, then bronze, silver, gold, and a summary of the run.

Each stage is one call of the command line, so it runs in a session of its own and its exit code tells why it failed.
"""

from __future__ import annotations

import json
import os
from datetime import datetime, timedelta
from pathlib import Path

from airflow.operators.bash import BashOperator
from airflow.operators.python import PythonOperator, ShortCircuitOperator

from airflow import DAG

ROOT = os.environ.get("RP_PROJECT_ROOT", str(Path(__file__).resolve().parents[1]))


def landed(day: str) -> bool:
    """Without a directory for the day the run ends here, unfailed; remote landing zones are left to the bronze stage."""
    from perkline.settings import is_local, load_settings
    from perkline.sources.storage import join_uri

    path = join_uri(load_settings().landing, "transactions", f"ingest_date={day}")
    return not is_local(path) or Path(path.removeprefix("file://")).exists()


def summarise(day: str) -> list[dict]:
    from perkline.settings import load_settings

    lines = (Path(load_settings().reports) / "_runs" / f"{day}.jsonl").read_text().splitlines()
    latest = {r["stage"]: r for r in map(json.loads, lines)}
    return [t for r in latest.values() for t in r["tables"]]


with DAG(
    "perkline_daily",
    schedule="0 6 * * *",
    start_date=datetime(2026, 1, 1),
    catchup=False,
    is_paused_upon_creation=True,
    max_active_runs=1,
    default_args={"retries": 2, "retry_delay": timedelta(minutes=5), "retry_exponential_backoff": True, "execution_timeout": timedelta(hours=1)},
) as dag:
    day = "{{ ds }}"
    step = ShortCircuitOperator(task_id="landing", python_callable=landed, op_args=[day])
    for stage in ("bronze", "silver", "gold"):
        step = step >> BashOperator(task_id=stage, cwd=ROOT, bash_command=f"python -m perkline {stage} --date {day}")
    step >> PythonOperator(task_id="summary", python_callable=summarise, op_args=[day])
