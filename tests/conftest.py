import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from siftlode.runtime import session, ship

    s = session("tests", "4", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.sql.codegen.wholeStage": "false"})
    s.sparkContext.setLogLevel("OFF")
    ship(s)
    yield s
    s.stop()
