import os
import pathlib
import sys
import tempfile

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from memberlens.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", 8, 4)
    session.conf.set("spark.sql.session.timeZone", "UTC")
    yield session
    session.stop()


@pytest.fixture()
def fresh_dir():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small_data():
    if not os.path.isdir(SMALL):
        pytest.skip("test tables are not here")
    return SMALL
