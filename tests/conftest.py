import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from logwarden.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    conf = {
        "spark.master": "local[8]",
        "spark.sql.shuffle.partitions": "4",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "6g",
        "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    }
    session = get_session("tests", **conf)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
