import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidemark.session import build_session  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    # Interpreted plans: on tiny inputs compiling generated code is most of the time.
    s = build_session(
        "tests", master="local[8]", spark__sql__shuffle__partitions=4,
        spark__sql__codegen__wholeStage="false",
        spark__ui__enabled="false", spark__driver__memory="6g",
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


@pytest.fixture(scope="session")
def data():
    return DATA
