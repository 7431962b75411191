import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    return session


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"


@pytest.fixture
def db(spark, tmp_path):
    from docpipe import Engine

    return Engine(spark, f"file://{tmp_path}").connect().db("test")


@pytest.fixture
def docs(db):
    """``run(documents, pipeline)`` as a list of documents."""

    def run(rows, pipeline):
        return db.aggregate([{"$documents": rows}, *pipeline]).to_list()

    return run
