import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from textloom.runtime import local_session

    session = local_session("textloom-tests", 8, spark__driver__memory="8g")
    yield session
    session.stop()
