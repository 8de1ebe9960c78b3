import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from cloudsieve.session import get_spark
    s = get_spark("tests", "8")
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()
