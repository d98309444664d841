import os

import pytest

from corpuskit.session import local_session

DATA = os.environ.get("CORPUSKIT_TESTDATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", spark__checkpoint__dir="/tmp/corpuskit-test-checkpoints")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    return DATA
