import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from kinweft.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(4, 4, "4g")


@pytest.fixture
def sf():
    path = Path("/root/testdata/sf0.001")
    if not path.exists():
        pytest.skip("no test tables here")
    return str(path)


def rows(df):
    """The rows of a frame as a sorted list of tuples."""
    return sorted((tuple(r) for r in df.collect()), key=str)
