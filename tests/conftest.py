import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    at = tmp_path_factory.mktemp("spark")
    conf = {
        "spark.master": "local[4]", "spark.driver.memory": "4g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "4", "spark.sql.warehouse.dir": f"{at}/warehouse", "spark.local.dir": f"{at}/local", "spark.checkpoint.dir": f"file://{at}/shared",
    }
    session = SparkSession.builder.config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
