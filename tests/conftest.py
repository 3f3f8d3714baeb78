import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from leadloom.session import build_session, checkpoint_dir  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "6g",
        "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="run-")})
    session.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(session, tempfile.mkdtemp(prefix="run-"))
    return session


@pytest.fixture()
def folder():
    return tempfile.mkdtemp(prefix="run-")
