from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from medallion.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", shuffle_partitions=4, app="tests")
    yield session
    session.stop()


def rows(df, *order):
    """All rows as tuples, ordered."""
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple(str(v) for v in r))
