"""Order statistics against numpy and pandas, with hot values and forced distributed paths."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfline.functions import ranking


def hot_values(n=4000):
    rng = np.random.default_rng(3)
    values = np.round(rng.gamma(2.0, 50.0, n), 2)
    values[: n // 3] = 42.0  # a third of all rows share one value
    return values


@pytest.mark.parametrize("small", [200_000, 0])
@pytest.mark.parametrize("p", [0.0, 0.31, 0.5, 0.995, 1.0])
def test_quantile_is_exact(spark, p, small):
    values = hot_values()
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = ranking.quantiles(df, {"v": p}, small_bracket=small)["v"]
    assert got == pytest.approx(float(np.quantile(values, p)), abs=1e-9)


def test_quantile_of_nothing(spark):
    assert ranking.quantiles(spark.createDataFrame([], "v double"), {"v": 0.5}) == {"v": None}


def test_fractional_ranks_match_pandas(spark):
    values = hot_values(900)
    pdf = pd.DataFrame({"id": range(len(values)), "v": values})
    df = spark.createDataFrame(pdf)
    got = ranking.fractional_ranks(df, {"v": "r"}, buckets=7).toPandas().set_index("id")["r"].sort_index()
    assert np.allclose(got, pdf["v"].rank(pct=True))


def test_row_numbers_with_hot_group(spark):
    data = [("hot", f"{i:05d}") for i in range(600)] + [("cold", f"{i:05d}") for i in range(7)]
    df = spark.createDataFrame(data, "k string, id string").orderBy(F.rand(1))
    got = {(r.k, r.id): r.position for r in ranking.row_numbers(df, ["k"], "id", buckets=5).collect()}
    assert got == {(k, i): int(i) + 1 for k, i in data}


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(-5, 5), min_size=1, max_size=40))
def test_cumulative_counts_property(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v int")
    for r in ranking.cumulative_counts(df, "v", buckets=3).collect():
        assert r.n == values.count(r.v)
        assert r.before == sum(x < r.v for x in values)
