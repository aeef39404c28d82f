from __future__ import annotations

import tempfile

import pytest
from pyspark.sql import SparkSession

from scoremon.sources.tables import clear_stored


def build_session() -> SparkSession:
    spark = (
        SparkSession.builder.master("local[8]")
        .appName("scoremon-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="scoremon-warehouse-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@pytest.fixture(scope="session")
def spark():
    session = build_session()
    yield session
    clear_stored(session)
    session.stop()


SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"
