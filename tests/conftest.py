import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "3").config("spark.default.parallelism", "3")
        .config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def plan(spark):
    """The whole estimate over the smallest tables; each of its tables is built once for all tests."""
    from tramo import queries as Q

    return Q.delivery(spark, "/root/testdata/sf0.001")
