import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from jobweave import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    active = session.local_session(4, shuffle_partitions=4, memory="6g")
    yield active
    active.stop()
