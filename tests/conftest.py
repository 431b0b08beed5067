import pytest

from tessera.session import session


@pytest.fixture(scope="session")
def spark():
    s = session(cores="4", memory="4g", partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
