"""Registered queries of the package against their SQL on the smallest tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import check  # noqa: E402

from shelfline.llm import registry  # noqa: E402

registry.load_all()
FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="query tables not present")


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, name):
    got = registry.QUERIES[name](spark, FOLDER).toPandas()
    assert check.compare(got, check.connect(FOLDER).execute(registry.ORACLES[name]).df()) == []
