import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("profilekit-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small(spark):
    """Five companies with results that can be worked out by hand."""
    rows = [
        (1, "north", 40.0, 61.0, 70.0, 300.0, "p"),
        (2, "south", 20.0, None, 50.0, 900.0, "qq"),
        (3, "north", None, 33.0, 66.0, 200.0, "p"),
        (4, "west", 55.0, 47.0, None, 500.0, "qq"),
        (5, "south", 30.0, 29.0, 58.0, 9000.0, "r"),
    ]
    return spark.createDataFrame(
        rows,
        "company_id long, gics_sector string, environmental_score double, social_score double, "
        "governance_score double, carbon_emissions double, rating string",
    )


@pytest.fixture(scope="session")
def companies(spark):
    from profilekit.sources.samples import company_table

    return company_table(spark).cache()


def by_key(df, key):
    return {r[key]: r for r in df.collect()}
