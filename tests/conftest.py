import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

HERE = Path(__file__).parent
sys.path[:0] = [str(HERE.parent), str(HERE)]
os.environ["PYTHONPATH"] = os.pathsep.join([str(HERE.parent), os.environ.get("PYTHONPATH", "")])
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    home = tmp_path_factory.mktemp("spark")
    s = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.bindAddress", "127.0.0.1").config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.memory", "4g").config("spark.sql.warehouse.dir", str(home / "warehouse"))
        .config("spark.driver.extraJavaOptions", f"-Dderby.system.home={home}").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture
def frame(spark):
    return lambda ddl, *rows: spark.createDataFrame([tuple(r) for r in rows], ddl)


@pytest.fixture(scope="session")
def sf_dir():
    return SF
