import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (SparkSession.builder.master("local[4]").appName("tests")
               .config("spark.sql.shuffle.partitions", "2").config("spark.default.parallelism", "1")
               # tiny inputs: planning and code generation would cost more than the work
               .config("spark.sql.adaptive.enabled", "false")
               .config("spark.sql.codegen.wholeStage", "false")
               .config("spark.sql.codegen.factoryMode", "NO_CODEGEN")
               .config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
               .getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def demo(spark):
    from grainwise.sources import demo_tables

    return {name: df.cache() for name, df in demo_tables(spark).items()}


@pytest.fixture(scope="session")
def small():
    """Folder with the smallest given tables."""
    return "/root/testdata/sf0.001"
