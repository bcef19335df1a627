import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from meterloom import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session.build("local[8]", 8, **{"spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(autouse=True)
def own_settings():
    """What a query set for itself does not reach the next test."""
    yield
    from pyspark.sql import SparkSession

    if live := SparkSession.getActiveSession():
        session.tune(live)
