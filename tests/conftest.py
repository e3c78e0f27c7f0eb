import pytest

from quillmesh.runtime import session


@pytest.fixture(scope="session")
def spark():
    s = session("quillmesh-tests", cores="4", partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
