import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pricetide.session import get_session


@pytest.fixture(scope="session")
def spark():
    session = get_session("tests", "8")
    yield session
    session.stop()
