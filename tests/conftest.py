import os

import pytest

from tidewater.runtime import local_session

ROOT = os.environ.get("TIDEWATER_TESTDATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark():
    session = local_session(cpus=4, shuffle_partitions=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small_root():
    return f"{ROOT}/sf0.001"
