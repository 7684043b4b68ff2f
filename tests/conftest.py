import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from spanloom.session import local_session

    session = local_session(4, app="tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return SMALL
