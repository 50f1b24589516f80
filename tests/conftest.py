import pytest

from torsia.session import get_spark


@pytest.fixture(scope="session")
def spark():
    s = get_spark("8")
    s.sparkContext.setLogLevel("ERROR")
    return s
