import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from docketry.session import build_session

    return build_session("tests", cpus=os.environ.get("TEST_CPUS", "4"), **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "3g"})
