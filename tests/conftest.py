import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from shirabe.session import local_session

    return local_session("8", 8, driver_memory="6g")


@pytest.fixture(scope="session")
def sf_dir():
    return SF
