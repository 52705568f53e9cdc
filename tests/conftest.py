import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from fareline.session import finish, local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores=int(os.environ.get("TEST_CPUS", "8")), app="fareline-tests")
    yield session
    finish(session)
