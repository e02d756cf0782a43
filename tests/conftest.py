import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from comptoir.session import build_session

    session = build_session(
        "tests", "local[8]",
        **{"spark.sql.shuffle.partitions": "4", "spark.default.parallelism": "2", "spark.ui.enabled": "false",
           "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false",
           "spark.sql.optimizer.excludedRules": "org.apache.spark.sql.catalyst.optimizer.ConvertToLocalRelation"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
