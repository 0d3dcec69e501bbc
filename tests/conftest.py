import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from driftline.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", 8, "8g")
    yield session
    session.stop()


def rows(df, *order):
    """Collected rows as dicts, sorted by the given columns."""
    out = [r.asDict() for r in df.collect()]
    return sorted(out, key=lambda r: tuple((r[c] is None, r[c] if r[c] is not None else 0) for c in order))
