from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from hubloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")  # driver and executors are one process here
    session = build_session(
        "tests", spark__master=os.environ.get("TEST_MASTER", "local[8]"),
        spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
        spark__sql__shuffle__partitions="8", spark__checkpoint__dir=str(shared),
        spark__sql__warehouse__dir=str(shared / "warehouse"))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small_folder() -> str:
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("star-schema tables not present")
    return folder
