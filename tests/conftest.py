import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from airshed.session import build_session
    s = build_session("local[4]", shuffle_partitions=8, app="airshed-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_small():
    if not os.path.exists(os.path.join(SF_SMALL, "lineitem.parquet")):
        pytest.skip("test data not available")
    return SF_SMALL
