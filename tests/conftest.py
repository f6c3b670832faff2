import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture
def sliced(spark):
    """Groups above 10 rows take the way meant for groups that no task can hold."""
    spark.conf.set("spark.measureframe.taskRows", "10")
    yield
    spark.conf.unset("spark.measureframe.taskRows")


@pytest.fixture(scope="session")
def m(spark):
    from catalog.views import measurements

    return measurements(spark, SMALL)


@pytest.fixture
def missing(spark):
    rows = [("a", 1.0, 2.0), ("a", 2.0, 0.0), ("a", 4.0, float("nan")), ("b", None, 3.0), (None, 7.0, 1.0)]
    return spark.createDataFrame(rows, "g string, x double, y double")
