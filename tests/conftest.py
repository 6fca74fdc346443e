import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from threadloom.session import SETTINGS, ship_package

    builder = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    ship_package(session)
    yield session
    session.stop()


@pytest.fixture
def skewed(spark):
    """Make every key with more than two rows a hot one, and broadcast nothing."""
    spark.conf.set("spark.threadloom.hotKeyRows", "2")
    spark.conf.set("spark.threadloom.broadcastBytes", "0")
    yield
    spark.conf.unset("spark.threadloom.hotKeyRows")
    spark.conf.unset("spark.threadloom.broadcastBytes")
