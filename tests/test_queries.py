"""Registered queries against their SQL on the smallest tables.

A fast selection runs by default; ``ALL_QUERIES=1`` runs every one.
"""

import os
from pathlib import Path

import check
import pytest

from shelfline.plans import ORACLES, QUERIES, load_all

load_all()
FOLDER = os.environ.get("QUERY_TABLES", "/root/testdata/sf0.001")
FAST = """outlier_caps daily_product_sales top_products holiday_flags split_by_fraction split_by_count expanding_folds pair_counts
item_neighbors_topk basket_stats tag_compatibility content_neighbors_topk branch_trending branch_popularity personalized_topk rfm_profile
loyalty_segments demand_gates rec_quality_checks pricing_request_rules sales_summary volume_tier stream_daily_sales""".split()

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="query tables not present")


@pytest.fixture(scope="module")
def duck():
    return check.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES) if os.environ.get("ALL_QUERIES") else FAST)
def test_query_equals_sql(spark, duck, name):
    assert check.compare(QUERIES[name](spark, FOLDER).toPandas(), duck.execute(ORACLES[name]).df()) == []


def test_partition_count_does_not_change_results(spark):
    name = "loyalty_segments"
    first = sorted(map(str, QUERIES[name](spark, FOLDER).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert sorted(map(str, QUERIES[name](spark, FOLDER).collect())) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
