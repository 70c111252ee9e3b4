import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pitwall.plans.session import session
    s = session("local[4]", 4, "pitwall-tests", **{"spark.driver.memory": "4g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def bed(spark):
    from pitwall.sources.testbed import Testbed
    return Testbed(spark, SF)
