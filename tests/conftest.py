import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from skein.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, partitions=4, memory="6g")
    yield session
    session.stop()


@pytest.fixture(autouse=True)
def no_cached_tables(request):
    """What another test has cached would stand in the plans of this one in place of its reads."""
    if "spark" in request.fixturenames:
        request.getfixturevalue("spark").catalog.clearCache()
