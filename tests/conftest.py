import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from loamgraph.runtime import local_session

    return local_session("tests", "4", 4)


@pytest.fixture
def rows():
    """Rows of a DataFrame as sorted tuples of the given columns."""

    def get(df, *cols):
        return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)

    return get
