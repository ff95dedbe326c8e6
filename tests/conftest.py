import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from gridspark.runtime import local_session, shared_root  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("8")
    shared_root(session)
    yield session
    session.stop()
