import os

import pytest

pytest.importorskip("tallyfield.llm.queries")

SF = os.environ.get("TALLYFIELD_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    return SF
