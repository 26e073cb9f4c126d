import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from loomgraph.session import get_spark

    s = get_spark("tests", master="local[4]", shuffle_partitions=4, extra={"spark.driver.memory": "4g"})
    yield s
    s.stop()
