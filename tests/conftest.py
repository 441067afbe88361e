import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("TZ", "UTC")
DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from barloom.session import local_session

    s = local_session(4, 4, "4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    if not DATA.exists():
        pytest.skip("test tables are not here")
    return str(DATA)


@pytest.fixture
def rows():
    """Sorted tuples of a DataFrame."""
    return lambda df: sorted((tuple(r) for r in df.collect()), key=lambda r: tuple(str(x) for x in r))
