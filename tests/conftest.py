import pytest

from joulemark.sources.session import session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = session("tests", **{
        "spark.master": "local[4]", "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g",
        "spark.checkpoint.dir": tmp_path_factory.mktemp("shared").as_uri(), "spark.sql.warehouse.dir": tmp_path_factory.mktemp("warehouse").as_uri(),
    })
    s.sparkContext.setLogLevel("ERROR")
    return s
