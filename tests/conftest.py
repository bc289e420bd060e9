import os

import pytest

from tests.support import duck, spark_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = spark_session(folder=str(tmp_path_factory.mktemp("shared")))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def con(sf_dir):
    return duck(sf_dir)
