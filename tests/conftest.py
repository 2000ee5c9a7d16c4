from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from shelfline.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[8]", shuffle_partitions=8, driver_memory="8g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def rows(spark):
    """Rows of a DataFrame as sorted tuples of the named columns."""

    def take(df, *columns):
        return sorted(tuple(r) for r in df.select(*(columns or df.columns)).collect())

    return take
