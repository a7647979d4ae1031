import os

import pytest

from skygrain.session import local_session

SF = os.environ.get("SKYGRAIN_TEST_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    return local_session("tests", cpus="*", partitions=4)


@pytest.fixture(scope="session")
def sf_dir():
    return SF
