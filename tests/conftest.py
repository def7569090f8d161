import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from emberlake.session import build_session  # noqa: E402

UTC = dt.timezone.utc


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "emberlake-tests",
        master="local[8]",
        **{
            "spark.sql.shuffle.partitions": "2",
            # Tiny inputs: interpreting beats compiling.
            "spark.sql.codegen.wholeStage": "false",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "6g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
