"""One local session for all tests."""

import os

import pytest

from quillon.session import local_session

SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    return local_session(cpus=4, memory="3g")


@pytest.fixture(scope="session")
def sf():
    return SMALL
