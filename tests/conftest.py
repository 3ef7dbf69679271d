"""One local session for all tests."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

SF = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from fieldloom.session import local_session

    session = local_session(cpus=8, shuffle_partitions=4, memory="6g")
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def sf():
    return str(SF)
