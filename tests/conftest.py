import pytest

from arbora.session import get_session

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = get_session("arbora-tests", cores=8, shuffle=8)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
