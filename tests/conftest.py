from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from signalbox.session import local_session, ship_package  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", "signalbox-tests", memory="4g")
    session.sparkContext.setLogLevel("OFF")
    ship_package()
    yield session
    session.stop()
