import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from sparkkb.session import get_spark

    return get_spark("tests", 4, spark__sql__shuffle__partitions="4")
