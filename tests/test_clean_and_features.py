"""Cleaning, panels, features, splits: literal cases and leakage tests."""

import statistics
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from shelfline.functions import calendar as cal
from shelfline.functions import columns
from shelfline.operators import clean, demand_panel, features, metrics, splits
from shelfline.sources import schemas

TEXT = ", ".join(f"{n} string" for n in schemas.TRANSACTIONS.fieldNames())


def tx(spark, *rows):
    return spark.createDataFrame(list(rows), TEXT)


def test_cleaning_keeps_valid_sales_only(spark, rows):
    day = "2026-01-05 10:00:00"
    df = tx(
        spark,
        ("100", " A ", "Tea", "2", day, "10.0", "1", "LK"),
        ("C101", "A", "Tea", "1", day, "10.0", "1", "LK"),
        ("c1", "A", "Tea", "1", day, "10.0", "1", "LK"),
        ("102", "B", "Cup", "-1", day, "5.0", "2", "LK"),
        ("103", "C", "Jar", "1", day, "0.0", "3", "LK"),
        ("104", "D", "Pot", "many", day, "4.0", "3", "LK"),
        ("105", "D", "Pot", "1", "no date", "4.0", "3", "LK"),
        (None, "E", None, "1", day, "10.0", None, None),
    )
    valid = clean.valid_sales(clean.typed_transactions(df))
    assert rows(valid, "product_id", "quantity", "description", "country") == [
        ("A", 2.0, "Tea", "LK"), ("E", 1.0, "Unknown product", "Unknown"),
    ]
    # both caps interpolate between 1 and 2 units, so the larger sale is above its cap
    assert rows(clean.clean_transactions(df), "product_id", "revenue") == [("E", 10.0)]


def test_outliers_above_the_cap_leave(spark):
    day = "2026-01-05 10:00:00"
    df = tx(spark, *[(str(i), "A", "x", str(i + 1), day, "1.0", "1", "LK") for i in range(1000)])
    kept = clean.clean_transactions(df).agg(F.max("quantity"), F.count("*")).first()
    assert tuple(kept) == (995.0, 995)


def test_missing_column_fails(spark):
    with pytest.raises(ValueError, match="unit_price"):
        clean.typed_transactions(tx(spark).drop("unit_price"))


def product_panel(spark, quantity=lambda i: float(i), n=40):
    start = date(2026, 1, 1)
    data = [(start + timedelta(i), "A", quantity(i), 1.0, 1.0, 1.0, "x", 100.0) for i in range(n)]
    return spark.createDataFrame(
        data, "date date, product_id string, quantity double, revenue double, orders double, "
        "customers double, description string, unit_price double",
    )


def test_stock_features_literal(spark):
    out = features.stock_features(product_panel(spark))
    row = out.where("quantity = 28").first()
    assert (row.demand_lag_1, row.demand_lag_7, row.rolling_mean_7) == (27.0, 21.0, 24.0)
    assert out.count() == 26 and out.agg(F.min("quantity")).first()[0] == 14.0


def test_dense_panel_fills_days_and_prices(spark, rows):
    data = [("1", "A", "old", 2.0, datetime(2026, 1, 1, 9), 5.0, "c", "LK"),
            ("2", "A", "new", 1.0, datetime(2026, 1, 4, 9), 7.0, "c", "LK"),
            ("3", "B", "b", 1.0, datetime(2026, 1, 2, 9), 3.0, "d", "LK")]
    raw = spark.createDataFrame(
        data, "invoice_no string, product_id string, description string, quantity double, invoice_date timestamp, "
        "unit_price double, customer_id string, country string",
    )
    lines = raw.withColumns({"revenue": F.expr("quantity * unit_price"), "date": F.to_date("invoice_date")})
    panel = clean.daily_product_panel(lines)
    a = [(r.date.day, r.quantity, r.unit_price, r.description) for r in panel.where("product_id = 'A'").orderBy("date").collect()]
    assert a == [(1, 2.0, 5.0, "old"), (2, 0.0, 5.0, "old"), (3, 0.0, 5.0, "old"), (4, 1.0, 7.0, "new")]
    assert [r.unit_price for r in panel.where("product_id = 'B'").orderBy("date").collect()] == [3.0] * 4


def records(spark, data, kinds=""):
    return spark.createDataFrame(
        data, f"organization_id string, branch_id string, product_id string, date date, quantity double{kinds}"
    )


D0 = date(2026, 1, 1)


def test_panel_density_zero_days_and_prices(spark):
    data = [("o", "b", "p", D0, 4.0, 50.0, 30.0), ("o", "b", "p", D0 + timedelta(2), 6.0, 50.0, 30.0)]
    df = records(spark, data, kinds=", unit_price double, cost_price double")
    for fill in ("constant", "as_known"):
        day = demand_panel.build_demand_panel(df, attribute_fill=fill).where(F.col("date") == D0 + timedelta(1)).first()
        assert (day.quantity, day.is_in_stock, day.is_branch_open) == (0.0, 1, 1)
        assert (day.unit_price, day.selling_price, day.cost_price) == (50.0, 50.0, 30.0)


def test_panel_closed_and_stockout_are_per_tenant(spark, rows):
    data = [(o, "A", "p", D0 + timedelta(i), 5.0) for o in ("org-1", "org-2") for i in range(2)]
    closed = spark.createDataFrame([("org-1", "A", D0)], "organization_id string, branch_id string, date date")
    out_days = spark.createDataFrame(
        [("org-2", "A", "p", D0 + timedelta(1))], "organization_id string, branch_id string, product_id string, date date"
    )
    panel = demand_panel.build_demand_panel(records(spark, data), closed_days=closed, out_of_stock_days=out_days)
    got = rows(panel.withColumn("d", F.dayofmonth("date")), "organization_id", "d", "quantity", "is_branch_open", "is_in_stock")
    assert got == [("org-1", 1, 0.0, 0, 1), ("org-1", 2, 5.0, 1, 1), ("org-2", 1, 5.0, 1, 1), ("org-2", 2, 5.0, 1, 0)]


def test_panel_range_and_empty_input(spark):
    df = records(spark, [("o", "b", "p", D0, 1.0)])
    assert demand_panel.build_demand_panel(df, end=D0 + timedelta(2)).count() == 3
    with pytest.raises(ValueError, match="must not be after"):
        demand_panel.build_demand_panel(df, start="2026-01-05", end="2026-01-01")
    empty = demand_panel.build_demand_panel(records(spark, []))
    assert empty.columns == demand_panel.PANEL_COLUMNS and empty.count() == 0


def demand_frame(spark, quantity=lambda i: float(i), price=lambda i: 100.0):
    data = [
        ("o", "b", "p", D0 + timedelta(i), quantity(i), price(i), 60.0, 100.0, 5.0,
         int(i % 10 == 0), 0.15 if i % 10 == 0 else 0.0, 1, 1)
        for i in range(60)
    ]
    return spark.createDataFrame(
        data, "organization_id string, branch_id string, product_id string, date date, quantity double, unit_price double, "
        "cost_price double, selling_price double, reorder_level double, has_scheduled_discount int, discount_rate double, "
        "is_in_stock int, is_branch_open int",
    )


def test_demand_features_literal(spark):
    out = features.demand_features(demand_frame(spark))
    row = out.where("quantity = 35").first()
    assert [row[f"demand_lag_{k}"] for k in schemas.DEMAND_LAGS] == [35.0 - k for k in schemas.DEMAND_LAGS]
    row = out.where("quantity = 40").first()
    week = list(range(33, 40))
    assert row.rolling_mean_7 == 36.0 and row.rolling_max_7 == 39.0
    assert row.rolling_std_7 == pytest.approx((sum((x - 36) ** 2 for x in week) / 6) ** 0.5)
    assert row.rolling_max_28 == 39.0 and row.margin_rate == pytest.approx(0.4)
    assert features.feature_vector(out).columns == schemas.DEMAND_FEATURES


def test_price_index_moves_on_the_day(spark):
    out = features.demand_features(demand_frame(spark, price=lambda i: 120.0 if i >= 34 else 100.0))
    index = {r.quantity: r.price_index_28 for r in out.collect()}
    assert index[33.0] == 1.0 and index[34.0] == pytest.approx(1.2)


@pytest.mark.parametrize("build", ["stock", "demand", "sales"])
def test_no_leakage(spark, build):
    """Changing a day's value changes no feature of that day or before."""
    spike = lambda i: 999.0 if i == 34 else float(i)
    if build == "stock":
        a, b = (features.stock_features(product_panel(spark, q)) for q in (lambda i: float(i), spike))
    elif build == "demand":
        a, b = (features.demand_features(demand_frame(spark, q)) for q in (lambda i: float(i), spike))
    else:
        a, b = (features.sales_features(revenue(spark, q)) for q in (lambda i: float(i), spike))
    value = "daily_revenue" if build == "sales" else "quantity"
    until = F.col("date") <= D0 + timedelta(34)
    left, right = (sorted(map(str, x.where(until).drop(value).collect())) for x in (a, b))
    assert left == right and len(left) > 3


def test_forbidden_columns(spark):
    with pytest.raises(ValueError, match="Data leakage detected"):
        features.demand_features(demand_frame(spark).withColumn("Discount_Application", F.lit(1)))


def revenue(spark, value=lambda i: 100.0 + i, n=50):
    data = [("o", "b", D0 + timedelta(i), value(i), 1, 0) for i in range(n)]
    return spark.createDataFrame(
        data, "organization_id string, branch_id string, date date, daily_revenue double, is_operating_day int, active_discount_count int"
    )


def test_sales_features_literal(spark):
    out = features.sales_features(revenue(spark))
    assert out.count() == 22 and set(schemas.SALES_FEATURES) <= set(out.columns)
    row = out.orderBy("date").first()
    assert (row.revenue_lag_1, row.revenue_lag_28, row.branch_age_days) == (127.0, 100.0, 28)
    assert row.rolling_mean_7 == 124.0 and row.weekly_momentum_ratio == round(124 / 117, 4)
    assert row.branch_historical_avg_sales == 113.5


def test_gaps_become_closed_days(spark):
    df = revenue(spark, n=10).where(F.dayofmonth("date") != 4)
    dense = features.dense_branch_days(df.drop("is_operating_day"))
    gap = dense.where(F.dayofmonth("date") == 4).first()
    assert dense.count() == 10 and (gap.daily_revenue, gap.is_operating_day) == (0.0, 0)


def test_holidays(spark):
    days = ["2026-02-04", "2026-04-14", "2026-05-01", "2026-02-10", "2026-05-31"]
    df = spark.createDataFrame([(d,) for d in days], "d string").withColumn("d", F.to_date("d"))
    flags = cal.holiday_flags(F.col("d"))
    got = {str(r.d): tuple(r[n] for n in flags) for r in df.withColumns(flags).collect()}
    assert got == {
        "2026-02-04": (1, 1, 0, 0), "2026-04-14": (1, 1, 0, 1), "2026-05-01": (1, 1, 1, 1),
        "2026-02-10": (0, 0, 0, 0), "2026-05-31": (1, 1, 1, 1),
    }
    other = cal.holiday_flags(F.col("d"), poya=["2026-02-10"], public=["2026-02-10"])
    got = df.withColumns(other).where("d = date'2026-02-10'").first()
    assert (got.is_public_holiday, got.is_poya_day) == (1, 1)


def test_split_arithmetic(spark, rows):
    df = spark.range(40).select(F.date_add(F.lit(D0), F.col("id").cast("int")).alias("date"))
    both = df.unionByName(df)
    count = lambda cuts: rows(splits.split_summary(splits.label_split(both, cuts)), "split", "n_dates", "n_rows")
    assert count(splits.count_cutoffs(both)) == [("test", 6, 12), ("train", 28, 56), ("validation", 6, 12)]
    assert count(splits.fraction_cutoffs(both)) == [("test", 6, 12), ("train", 28, 56), ("validation", 6, 12)]
    assert splits.tail_cutoffs(both).first().train_end is None


def test_fixed_split(spark, rows):
    days = ["2014-08-01", "2014-08-01", "2014-11-20", "2014-12-10", "2014-12-10"]
    df = spark.createDataFrame([(d,) for d in days], "transaction_date string")
    out = splits.label_fixed(df.withColumn("transaction_date", F.to_date("transaction_date")), "2014-11-01", "2014-12-01")
    assert rows(out.groupBy("split").count()) == [("test", 2), ("train", 2), ("validation", 1)]


def test_metrics(spark):
    df = spark.createDataFrame([(10.0, 12.0, 9.0), (0.0, 1.0, 2.0), (5.0, None, 5.0)], "actual double, predicted double, baseline double")
    row = metrics.forecasting_metrics(df).first()
    assert (row.mae, row.wape, row.mase) == (1.5, 0.3, None)
    row = metrics.fva_metrics(df.na.drop()).first()
    assert row.fva == pytest.approx(1 - 1.5 / 1.5) and row.baseline_mae == 1.5


def test_scalar_helpers(spark):
    from statistics import NormalDist

    df = spark.createDataFrame([(0.5,), (0.95,), (0.001,), (0.999,)], "p double")
    for r in df.withColumn("z", columns.normal_quantile(F.col("p"))).collect():
        assert r.z == pytest.approx(NormalDist().inv_cdf(r.p), abs=1e-8)
    row = spark.range(1).select(
        columns.tile_history(F.array(*[F.lit(float(x)) for x in (1, 2, 3)]), 7).alias("tiled"),
        columns.lead_with_first(F.array(F.lit(1.0), F.lit(2.0)), 4).alias("led"),
        columns.linspace(F.lit(1.0), F.lit(2.0), F.lit(5)).alias("grid"),
        columns.clip(F.lit(None).cast("double"), 0.0, 1.0).alias("none"),
    ).first()
    assert row.tiled == [3.0, 1.0, 2.0, 3.0, 1.0, 2.0, 3.0] and row.led == [1.0, 1.0, 1.0, 2.0]
    assert row.grid == [1.0, 1.25, 1.5, 1.75, 2.0] and row.none is None


def test_panel_of_the_last_days_is_the_end_of_the_whole_panel(spark):
    """Opening prices and descriptions come from before the kept days, from after them, or (all null) from nowhere."""
    day = lambda i: date(2024, 1, 1) + timedelta(i)
    rows = [
        ("early", day(0), 2.0, 8.0, "old"), ("early", day(3), 1.0, None, "older"), ("late", day(8), 1.0, 5.0, None),
        ("late", day(9), 1.0, 6.0, "seen"), ("both", day(1), 1.0, 3.0, None), ("both", day(7), 4.0, 4.0, "b"), ("none", day(2), 1.0, None, None),
    ]
    daily = spark.createDataFrame(
        [(p, d, q, None if u is None else q * u, 1, 1, t, u) for p, d, q, u, t in rows],
        "product_id string, date date, quantity double, revenue double, orders long, customers long, description string, unit_price double",
    )
    names = ["product_id", "date", "quantity", "revenue", "orders", "customers", "description", "unit_price"]
    take = lambda df: sorted(map(tuple, df.select(names).collect()), key=lambda r: r[:2])
    whole = take(clean.dense_panel(daily))
    assert len(whole) == 40 and {r[7] for r in whole if r[0] == "late" and r[1] < day(8)} == {5.0}
    assert {r[7] for r in whole if r[0] == "none"} == {None} and {r[7] for r in whole if r[0] == "early"} == {8.0}
    for days in (1, 3, 10, 99):
        assert take(clean.dense_panel(daily, last_days=days)) == [r for r in whole if r[1] > day(9 - days)]
    assert clean.dense_panel(daily.limit(0), last_days=3).isEmpty()
    assert {r[7] for r in take(clean.dense_panel(daily, 0.5)) if r[0] == "none"} == {0.5}
    assert [r.date for r in clean.sales_calendar(daily).orderBy("date").collect()] == [day(i) for i in range(10)]


def test_chronological_split_by_two_days(spark):
    day = lambda i: date(2024, 1, i)
    df = spark.createDataFrame([(day(i),) for i in (1, 5, 6, 9, 10, 11)] + [(None,)], "date date")
    parts = splits.chronological_split(df, day(6), day(10))
    assert [[r.date.day for r in part.orderBy("date").collect()] for part in parts] == [[1, 5], [6, 9], [10, 11]]
    assert [part.count() for part in splits.chronological_split(df, day(9), day(2))] == [3, 0, 3]


def test_a_panel_is_spread_by_its_rows(spark, monkeypatch):
    """A few sales make long series: the panel has tasks for its rows, however small the sales are."""
    monkeypatch.setattr(clean, "PANEL_TASK_ROWS", 100)
    data = [(date(2026, 1, 1) + timedelta(d), f"p{i}", 1.0, 2.0, 1, 1, "x", 2.0) for i in range(6) for d in (0, 99)]
    daily = spark.createDataFrame(
        data, "date date, product_id string, quantity double, revenue double, orders long, customers long, "
        "description string, unit_price double",
    )
    panel = clean.dense_panel(daily)
    assert panel.count() == 600 and panel.rdd.getNumPartitions() == 6
    assert clean.dense_panel(daily, last_days=10).rdd.getNumPartitions() == 1
    assert clean.dense_panel(daily.limit(0)).count() == 0


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_daily_sales_and_panels_shuffle_sales_only(spark):
    """F7, F11-F14, F17: lines are not multiplied before a shuffle, and days without sales are never joined or shuffled."""
    when = datetime(2026, 1, 5, 10)
    lines = spark.createDataFrame(
        [("1", "A", "old", 1.0, when, 2.0, "x"), ("1", "A", "old", 2.0, when, 2.0, "x"), ("2", "A", "new", 1.0, when + timedelta(hours=1), 2.0, None),
         ("3", "A", "new", 1.0, when + timedelta(hours=1), 2.0, "y"), (None, "B", None, 1.0, when, 3.0, None), ("4", None, "no", 1.0, when, 2.0, "x")],
        "invoice_no string, product_id string, description string, quantity double, invoice_date timestamp, unit_price double, customer_id string",
    ).withColumns({"revenue": F.col("quantity") * F.col("unit_price"), "date": F.to_date("invoice_date")})
    daily = clean.daily_product_sales(lines)
    assert "Expand" not in _plan(daily)
    took = {r.product_id: (r.quantity, r.revenue, r.orders, r.customers, r.description) for r in daily.collect()}
    assert took == {"A": (5.0, 10.0, 3, 2, "new"), "B": (1.0, 3.0, 0, 0, None)}
    # a repeated day keeps its rows, and the days after it follow the last of them
    twice = daily.where("product_id = 'A'").unionByName(daily.where("product_id = 'A'")).unionByName(daily.withColumn("date", F.date_add("date", 3)))
    panel = clean.dense_panel(twice)
    assert sorted((r.product_id, r.date.day, r.quantity) for r in panel.collect()) == [
        ("A", 5, 5.0), ("A", 5, 5.0), ("A", 6, 0.0), ("A", 7, 0.0), ("A", 8, 5.0), ("B", 5, 0.0), ("B", 6, 0.0), ("B", 7, 0.0), ("B", 8, 1.0)]
    stored = twice.localCheckpoint()
    panel = _plan(clean.dense_panel(stored, last_days=2))
    after = panel[:panel.index("Generate")] if "Generate" in panel else panel
    assert "Join" not in panel and "Exchange" not in after


def test_backtest_sums_are_differences_of_running_sums(spark):
    """F8: no frame slides over the days; ends, unknown units and fractions are as in a frame."""
    units = [None if i % 11 == 3 else (i * 37 % 101) / 8 for i in range(70)]
    data = [(date(2026, 1, 1) + timedelta(i), p, u if p == "a" else 1.0) for i, u in enumerate(units) for p in "ab"]
    panel = spark.createDataFrame(data, "date date, product_id string, quantity double")
    out = metrics.direct_horizon_backtest(panel, "2026-01-01", "2026-03-15")
    plan = _plan(out)
    assert "specifiedwindowframe(RowFrame, -28, -1)" not in plan and "specifiedwindowframe(RowFrame, 0, 29)" not in plan
    cases = {7: [], 14: [], 30: []}
    for values in (units, [1.0] * 70):
        for at in range(28, 70):
            past = [u for u in values[at - 28: at] if u is not None]
            for h in cases:
                if at + h - 1 <= 73:
                    cases[h].append((sum(past) / len(past) * h, sum(u for u in values[at: at + h] if u is not None)))
    for r in out.collect():
        mine = cases[r.horizon_days]
        assert r.origins == len(mine)
        assert r.mae == pytest.approx(sum(abs(f - a) for f, a in mine) / len(mine)) and r.actual_total == pytest.approx(sum(a for _, a in mine))


def test_trailing_medians_of_few_values(spark):
    """medians of a frame come from its sorted values, as percentiles give them, without a map for each row."""
    prices = [None if i % 5 == 2 else (i * 29 % 17) / 3 for i in range(60)]
    panel = spark.createDataFrame([("p", date(2026, 1, 1) + timedelta(i), 1.0, u, 1, 1) for i, u in enumerate(prices)],
                                  "product_id string, date date, quantity double, unit_price double, orders long, customers long")
    out = features.stock_features(panel, drop_incomplete=False)
    assert "percentile" not in _plan(out)
    for i, r in enumerate(out.orderBy("date").collect()):
        seen = [u for u in prices[max(0, i - 28): i] if u is not None]
        want = prices[i] / max(statistics.median(seen), 0.01) if len(seen) >= 7 and prices[i] is not None else None
        assert r.price_index_28 == (None if want is None else pytest.approx(want, rel=1e-14))
