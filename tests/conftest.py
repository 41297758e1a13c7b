import pytest

from millrace.runtime import session


@pytest.fixture(scope="session")
def spark():
    s = session("tests", "local[4]", 4)
    s.sparkContext.setLogLevel("ERROR")
    return s
