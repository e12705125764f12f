import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from podium.session import local_session, prepare

    return prepare(local_session("4", "3g", 4))
