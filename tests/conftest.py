import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from oddline.session import local_session

    session = local_session(8, "oddline-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def folder():
    """A new folder per test, left in place."""
    return tempfile.mkdtemp(prefix="oddline-test-")


@pytest.fixture(scope="session")
def sf():
    return SF
