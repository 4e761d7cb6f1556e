import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from check import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    yield session("8")


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
