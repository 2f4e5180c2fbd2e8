import pathlib
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from homeledger.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("homeledger-tests", 8)
    yield session
    session.stop()


@pytest.fixture
def scratch(tmp_path):
    return str(tmp_path)
