import pathlib
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from lotwise import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "lotwise-tests", "local[8]", spark__sql__shuffle__partitions=8
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
