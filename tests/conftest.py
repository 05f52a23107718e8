import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parent.parent), str(Path(__file__).resolve().parent)]


@pytest.fixture(scope="session")
def spark():
    from silverloom.session import build_session, ship_package

    s = build_session("tests", 8, "6g", spark__sql__shuffle__partitions="4")
    s.sparkContext.setLogLevel("ERROR")
    ship_package(s)
    yield s
    s.stop()
