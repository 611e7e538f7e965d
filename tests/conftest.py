import pytest

from recordloom.session import session


@pytest.fixture(scope="session")
def spark():
    s = session("local[8]", "tests", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    return s
