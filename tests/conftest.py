import pytest

from spanloom.session import local_session, ship


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, partitions=4, memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield ship(session)
    session.stop()
