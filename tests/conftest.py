import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from folioscope.session import drop_staged, local_session

    session = local_session("8", "tests")
    yield session
    drop_staged(session)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
