import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from paneflow.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session(4, 4, "4g", "paneflow-tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
