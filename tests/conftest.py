import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from deckweave.session import local_session, ship_package  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8)
    session.sparkContext.setLogLevel("ERROR")
    ship_package(session)
    session.sparkContext.addPyFile(str(Path(__file__).with_name("stubs.py")))
    yield session
    session.stop()
