import pytest

from tidewatch.session import local_session

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session(8, "tidewatch-tests", shuffle=4, memory="6g")


@pytest.fixture(scope="session")
def sf():
    return SF
