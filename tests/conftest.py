import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from cohortlens.session import get_spark
    s = get_spark(cores=4, shuffle_partitions=4, driver_memory="4g", app="cohortlens-tests")
    yield s
