import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from oracle import compare

SQL = {k: v for k, v in entry.oracle_sql().items() if k[0] == "q"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_and_sql_agree(spark, sf_dir, name):
    n, here, there = compare(entry.queries()[name](spark, sf_dir), SQL[name], sf_dir)
    assert n > 0 and not here and not there


def test_schema_drift_query(spark, sf_dir):
    got = {tuple(r) for r in entry.queries()["q29_schema_drift"](spark, sf_dir).collect()}
    assert ("missing", "customer", "") in got and ("mismatch", "o_totalprice", "decimal(14,2) double") in got and ("undeclared", "o_custkey", "") in got


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_the_rest_stands_without_the_removable_part(tmp_path):
    """The entry file imports, and offers its other queries, where the training-data operators are gone."""
    import shutil

    root = Path(entry.__file__).parent
    shutil.copytree(root / "perkline", tmp_path / "perkline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; n = e.queries(); assert 'q13_points_fact' in n and not any(x.startswith('op') or x == 'pipeline' for x in n); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
