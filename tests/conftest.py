import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from tallyfield.session import build_session

    session = build_session(4, "tests", spark__sql__shuffle__partitions="4", spark__driver__memory="3g")
    session.sparkContext.setLogLevel("ERROR")
    return session
