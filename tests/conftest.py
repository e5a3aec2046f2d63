import pytest

from rasterlake.session import local


@pytest.fixture(scope="session")
def spark():
    session = local(cores=4, partitions=4, memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
