import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(params=["whole", "cut"])
def mode(request, spark):
    """Run a test on the plain plan and with every busy group cut into blocks."""
    if request.param == "cut":
        spark.conf.set("spark.tidemark.blocks.targetRows", "12")
    yield request.param
    spark.conf.unset("spark.tidemark.blocks.targetRows")
