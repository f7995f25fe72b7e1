import sys
from datetime import datetime, timedelta
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from gaugeflow.session import local_session  # noqa: E402

T0 = datetime(2024, 1, 1)


def at(minutes: float) -> datetime:
    return T0 + timedelta(minutes=minutes)


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", 4, memory="6g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
