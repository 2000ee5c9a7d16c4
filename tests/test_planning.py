"""Loyalty, replenishment, pricing, models, recursion, quality gates, request rules, files, streams."""

import json
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfline.operators import features, loyalty, models, pricing, quality, recursion, requests, stock
from shelfline.sources import files, schemas
from shelfline.streaming import jobs

D0 = date(2026, 1, 1)


def test_segments_are_right_closed(spark):
    df = spark.createDataFrame([(35.0,), (35.1,), (60.0,), (80.0,), (80.1,)], "s double")
    assert [r[0] for r in df.select(loyalty.segment(F.col("s"))).collect()] == ["new_or_at_risk", "regular", "regular", "loyal", "champion"]


def purchases(spark, n=60):
    rng = np.random.default_rng(0)
    rows = [(f"i{c}-{j}", f"p{rng.integers(12):02d}", float(rng.integers(1, 6)), f"c{c:02d}", D0 + timedelta(int(rng.integers(90))))
            for c in range(n) for j in range(int(rng.integers(1, 9)))]
    df = spark.createDataFrame(rows, "invoice_no string, product_id string, quantity double, customer_id string, day date")
    return df.select("*", F.col("day").cast("timestamp_ntz").alias("invoice_date"), (F.col("quantity") * 2).alias("revenue"))


def test_factors_equal_the_dense_decomposition(spark):
    kept, holdout = loyalty.interactions(purchases(spark))
    vectors = loyalty.customer_vectors(kept)
    model = loyalty.fit_factors(vectors, components=4)
    pdf = vectors.orderBy("customer_id").toPandas()
    x = loyalty._dense(pdf, {p: i for i, p in enumerate(model.products)})
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    want = (u[:, :4] * s[:4]) @ vt[:4] + loyalty.POPULARITY_WEIGHT * model.popularity
    assert np.allclose((x @ model.components) @ model.components.T + loyalty.POPULARITY_WEIGHT * model.popularity, want)
    recs = loyalty.recommend_products(vectors, model, 3)
    seen = {(r.customer_id, i) for r in vectors.collect() for i in r["items"]}
    assert not {(r.customer_id, r.product_id) for r in recs.collect()} & seen
    first = {r.customer_id: (r.product_id, r.score) for r in recs.where("rank = 1").collect()}
    for row, c in enumerate(pdf["customer_id"]):
        masked = np.where(x[row] != 0, -np.inf, want[row])
        assert first[c] == (model.products[int(np.argmax(masked))], pytest.approx(1.0)) or np.isinf(masked).sum() >= len(masked) - 1
    row = loyalty.holdout_metrics(recs, holdout, model, 3).first()
    assert 0 <= row.hit_rate_at_10 <= 1 and 0 < row.explained_variance <= 1
    assert loyalty.newcomer_products(model, spark, 3).count() == 3


def series_frame(spark, history, **extra):
    columns = {"product_id": "A", "history": [float(x) for x in history], **extra}
    return spark.createDataFrame([tuple(columns.values())], ", ".join(f"{n} {'array<double>' if n == 'history' else 'string' if n == 'product_id' else 'double'}" for n in columns))


def test_calibration_meets_the_direct_totals(spark):
    series = series_frame(spark, range(1, 29))
    curve = spark.range(65).select(F.lit("A").alias("product_id"), F.col("id").cast("int").alias("offset"), F.lit(1.0).alias("predicted_demand"),
                                   F.date_add(F.lit(D0), F.col("id").cast("int")).alias("date"))
    out = stock.calibrate_curve(curve, series, ["product_id"])
    direct = {r.horizon_days: r.predicted_demand for r in stock.direct_horizons(series).collect()}
    for h in (7, 14, 30):
        assert out.where(F.col("offset") < h).agg(F.sum("predicted_demand")).first()[0] == pytest.approx(direct[h])
    assert out.where("offset >= 60").agg(F.sum("predicted_demand")).first()[0] == pytest.approx(direct[30] / 30 * 5)
    flat = stock.calibrate_curve(curve.withColumn("predicted_demand", F.lit(0.0)), series, ["product_id"])
    assert flat.where("offset = 3").first().predicted_demand == pytest.approx(direct[7] / 7)
    weeks = stock.period_rollup(out, ["product_id"]).where("kind = 'weekly'").orderBy("start_date").first()
    assert (weeks.label, weeks.start_date, weeks.end_date) == ("2026-W01", D0, date(2026, 1, 4))
    assert stock.forecast_summary(out, ["product_id"]).first().forecast_days == 65


def test_direct_band_and_readiness(spark):
    row = stock.direct_horizons(series_frame(spark, [10] * 20)).where("horizon_days = 7").first()
    assert (row.predicted_demand, row.lower_bound, row.upper_bound) == (70.0, pytest.approx(49.0), pytest.approx(91.0))
    df = spark.createDataFrame([(14,), (28,), (90,), (365,)], "history_days int")
    assert [r.maturity for r in stock.data_readiness(df).collect()] == ["cold_start", "limited_history", "developing", "annual_history_available"]


def test_plan_from_a_day(spark):
    df = spark.createDataFrame([("A", 10.0, 0.5, 0.0, 4, 6), ("B", 10.0, 0.5, 500.0, 4, 6)], "product_id string, predicted_daily_demand double, rolling_std_7 double, current_stock double, lead_time_days int, review_period_days int")
    a, b = stock.plan_from_day(df).orderBy("product_id").collect()
    assert a.safety_stock == pytest.approx(1.6448536269514722 * 1.0 * 2) and a.status == "reorder_now" and a.stockout_risk == 1.0
    assert a.recommended_order_quantity == pytest.approx(100 + a.safety_stock) and b.status == "healthy"


def test_price_guardrails(spark):
    row = ("A", 100.0, 95.0, 0.10, 0.15, 13, 1.0)
    df = spark.createDataFrame([row], "product_id string, current_price double, unit_cost double, min_margin_rate double, max_change_rate double, candidate_steps int, price_index_28 double")
    grid = [r.candidate_price for r in pricing.price_grid(df).orderBy("candidate_no").collect()]
    assert len(grid) == 13 and grid[0] == pytest.approx(104.5) and grid[-1] == pytest.approx(115.0)
    flat = pricing.recommend_price(df, ["product_id"], lambda d: d.withColumn("demand", F.lit(1.0))).first()
    assert flat.recommended_price == pytest.approx(115.0) and flat.decision == "increase"
    none = pricing.recommend_price(df, ["product_id"], lambda d: d.withColumn("demand", F.lit(0.0))).first()
    assert none.recommended_price == pytest.approx(104.5)  # first of equals


def panel(spark, products=4, n=90):
    data = [(D0 + timedelta(i), f"P{p}", float((i % 7) * (p + 1)), 1.0, float(i % 3), float(i % 2), "x", 10.0 + p)
            for p in range(products) for i in range(n)]
    return spark.createDataFrame(data, "date date, product_id string, quantity double, revenue double, orders double, customers double, description string, unit_price double")


@pytest.fixture(scope="module")
def demand_model(spark):
    return models.fit_next_day_demand(features.stock_features(panel(spark)), max_iter=4, step=0.3, depth=3)


def test_demand_model_is_deterministic_and_beats_nothing_negative(spark, demand_model):
    table = features.stock_features(panel(spark))
    again = models.fit_next_day_demand(table, max_iter=4, step=0.3, depth=3)
    assert demand_model.metrics.first() == again.metrics.first()
    assert models.score(demand_model, table).agg(F.min("predicted")).first()[0] >= 0


def test_tree_kernel_equals_the_model(spark, demand_model):
    table = features.stock_features(panel(spark))
    pdf = demand_model.model.transform(table).select(*schemas.STOCK_FEATURES, "raw").toPandas()
    trees = recursion.read_trees(demand_model)
    assert np.allclose(trees.predict(pdf[schemas.STOCK_FEATURES].to_numpy(float)), pdf["raw"])


def test_recursive_demand_first_step(spark, demand_model):
    series = stock.history_series(panel(spark), ["product_id"]).withColumns(
        {"start_date": F.date_add("last_date", 1), "unit_price": F.lit(10.0), "price_index_28": F.lit(1.0), "orders_lag_1": F.lit(1.0), "customers_lag_1": F.lit(1.0)}
    )
    out = recursion.recursive_demand(series, demand_model, ["product_id"], 30)
    assert out.count() == 4 * 30 and out.agg(F.min("predicted_demand")).first()[0] >= 0
    longer = panel(spark, n=91).withColumns({"unit_price": F.lit(10.0)})
    step = features.stock_features(longer, drop_incomplete=False).where(F.col("date") == D0 + timedelta(90))
    step = step.withColumns({"price_index_28": F.lit(1.0), "orders_lag_1": F.lit(1.0), "customers_lag_1": F.lit(1.0)})
    want = {r.product_id: r.predicted for r in models.score(demand_model, step).collect()}
    got = {r.product_id: r.predicted_demand for r in out.where("offset = 0").collect()}
    assert got == pytest.approx(want)


def test_revenue_model_and_recursion(spark):
    data = [("o", b, D0 + timedelta(i), 0.0 if i % 7 == 3 else 50000.0 + 1000 * (i % 7) + 50 * (i % 5), int(i % 7 != 3), 0) for b in ("b1", "b2") for i in range(150)]
    dense = spark.createDataFrame(data, "organization_id string, branch_id string, date date, daily_revenue double, is_operating_day int, active_discount_count int")
    table = features.sales_features(dense)
    fitted = models.fit_daily_revenue(table, max_iter=5, step=0.3, depth=3)
    assert fitted.metrics.first().wape < 0.2
    with pytest.raises(ValueError, match="Not enough dates"):
        models.fit_daily_revenue(table.where(F.col("date") < D0 + timedelta(60)), max_iter=2)
    series = stock.history_series(dense, ["branch_id"], "daily_revenue").withColumns(
        {"first_date": F.lit(D0), "calendar": F.array(*[F.struct(F.date_add("last_date", i).alias("date"), F.lit(int(i != 2)).alias("is_operating_day"), F.lit(0).alias("active_discounts")) for i in range(1, 8)])}
    )
    out = recursion.recursive_revenue(series, fitted, ["branch_id"]).where("branch_id = 'b1'").orderBy("offset").collect()
    assert len(out) == 7 and out[1].predicted_revenue == 0.0 and out[4].predicted_revenue > 0


def unit_rows(n=600):
    cats = schemas.UNIT_DEMAND_LEVELS["category"]
    for i in range(n):
        is_open, promo = int(i % 31 != 0), i % 2
        yield (D0 + timedelta(i // 5), i % 3, f"SKU-{i % 5:03d}", cats[i % 5], 0 if not is_open else 5 + i % 7 + 4 * promo, 10.0, 12.0,
               is_open, promo, 0, (D0 + timedelta(i // 5)).weekday(), "0abc"[i % 4], 0, "acd"[i % 3], "ac"[i % 2], 20 + 3 * (i % 7))


def unit_frame(spark):
    return spark.createDataFrame(list(unit_rows()), "date date, store_id int, product_id string, category string, units_sold int, unit_price double, base_unit_price double, is_open int, is_promo int, promo2 int, day_of_week int, state_holiday string, school_holiday int, store_type string, assortment string, customers int")


def test_bake_off_and_unit_forecast(spark):
    table = unit_frame(spark)
    target, chosen = models.resolve_columns(table)
    assert target == "units_sold" and "customers" not in chosen and "category" in chosen
    winner, report = models.bake_off(table, {"boosted": {"maxIter": 3}, "linear": {}}, models.UNIT_DEMAND_FEATURES)
    rows = report.collect()
    assert sum(r.chosen for r in rows) == 1 and min(rows, key=lambda r: r.wape).chosen
    asked = spark.createDataFrame(
        [("r", "SKU-1", "7", "Power Banks", None, 12.0, "a", "a", 0, 7, date(2026, 3, 2))],
        "request_id string, product_id string, store_id string, category string, unit_price double, base_unit_price double, store_type string, assortment string, promo2 int, horizon int, forecast_date date",
    )
    contexts = spark.createDataFrame([("r", date(2026, 3, 4), 9, 0, 0, None, "0", 0), ("r", None, 1, 1, 1, 9.5, "0", 0)], "request_id string, forecast_date date, position int, is_open int, is_promo int, unit_price double, state_holiday string, school_holiday int")
    days = {r.forecast_date.day: r for r in models.forecast_units(winner, asked, contexts).collect()}
    assert len(days) == 7 and days[4].predicted_units == 0.0 and days[8].is_open == 0  # given closed day, Sunday
    assert days[3].unit_price == 9.5 and days[3].is_promo == 1 and days[2].unit_price == 12.0


def test_gates_pass_and_fail(spark):
    table = unit_frame(spark).dropDuplicates(["product_id", "store_id", "date"])
    checks = lambda df: {r.check: r.passed for r in quality.demand_gates(df, "SKU-003", "SKU-002", ["SKU-001"], ["SKU-004"]).collect()}
    good = checks(table)
    assert good["physical_integrity"] and good["panel_feasibility"]
    bad = table.withColumn("units_sold", F.when(F.col("is_open") == 0, 3).otherwise(F.col("units_sold")))
    assert not checks(bad)["physical_integrity"]
    assert not checks(table.unionByName(table.limit(1)))["panel_feasibility"]


def rec_tables(spark):
    catalog = spark.createDataFrame([(f"P{i}", "org", "Cat", 1.0, 2.0, 2.0, [f"t{i}", "x"], i != 9) for i in range(10)], "product_id string, organization_id string, category_level_1 string, cost_price double, base_unit_price double, current_unit_price double, compatibility_tags array<string>, is_active boolean")
    customers = spark.createDataFrame([(f"CUST-{i}", "org", ["Cat"], 2) for i in range(4)], "customer_id string, organization_id string, preferred_categories array<string>, total_transactions int")
    rows = [(f"t{i}-{s}", "org", s, f"CUST-{i % 4}", D0, line, f"P{(i + line) % 5}", 1, 2.0, 2.0) for s, n in (("B1", 12), ("B2", 60)) for i in range(n) for line in range(2)]
    baskets = spark.createDataFrame(rows, "transaction_id string, organization_id string, store_id string, customer_id string, transaction_date date, line_item_id int, product_id string, quantity int, unit_price double, line_total double")
    inventory = spark.createDataFrame([(b, f"P{i}", "org", i, i > 0) for b in ("B1", "B2") for i in range(10)], "branch_id string, product_id string, organization_id string, stock_quantity int, is_available boolean")
    return catalog, customers, baskets, inventory


def test_table_checks_find_the_corruption(spark):
    catalog, customers, baskets, inventory = rec_tables(spark)
    failed = lambda *t: {r.check for r in quality.recommendation_checks(*t, as_of="2026-02-01").collect() if not r.passed}
    clean = failed(catalog, customers, baskets, inventory)
    assert clean == {"long_tail_distribution"}
    worse = failed(catalog, customers, baskets.withColumn("quantity", F.when(F.col("product_id") == "P1", -1).otherwise(F.col("quantity"))), inventory)
    assert "quantities_valid" in worse and "primary_keys_unique" not in worse
    assert "no_inactive_products_sold" in failed(catalog.withColumn("is_active", F.lit(False)), customers, baskets, inventory)
    assert "tenant_consistency" in failed(catalog, customers.withColumn("organization_id", F.lit("zzz")), baskets, inventory)
    assert quality.recommendation_summary(catalog, customers, baskets, inventory).first().total_line_items == baskets.count()


def test_training_set_problems(spark):
    table = features.sales_features(spark.createDataFrame([("o", "b", D0 + timedelta(i), float(i) - 40, 1, 0) for i in range(60)], "organization_id string, branch_id string, date date, daily_revenue double, is_operating_day int, active_discount_count int"))
    bad = table.withColumn("Customers", F.lit(1)).drop("month")
    found = {r.problem for r in quality.sales_training_problems(bad, schemas.SALES_FEATURES, schemas.SALES_FORBIDDEN).collect()}
    assert found == {"missing:month", "forbidden:Customers", "negative:daily_revenue"}


def test_request_rules(spark):
    base = {f: 1.0 for f in requests.FEATURES}
    columns = {"product_id": "A", "current_price": 90.0, "unit_cost": 100.0, "price_index_28": 1.0, **base}
    df = spark.createDataFrame([tuple(columns.values())], list(columns))
    assert requests.validate(df, "pricing").first().reasons == ["price_not_above_cost"]
    assert requests.accepted(requests.validate(df.withColumn("current_price", F.lit(110.0)), "pricing")).count() == 1
    horizon = spark.createDataFrame([("A", [1.0] * 14, 5.0, 20, 20, 30, 1.0, 1.0, 1.0), ("B", [1.0, -1.0], 5.0, 1, 1, 30, 1.0, 1.0, 1.0)], "product_id string, recent_daily_demand array<double>, current_stock double, lead_time_days int, review_period_days int, forecast_days int, unit_price double, orders_lag_1 double, customers_lag_1 double")
    reasons = {r.product_id: r.reasons for r in requests.validate(horizon, "horizon").collect()}
    assert reasons == {"A": ["horizon_too_short"], "B": ["history_length", "negative_history"]}
    with pytest.raises(ValueError, match="customers"):
        requests.validate(spark.createDataFrame([(1,)], "customers int"), "demand")
    days = spark.createDataFrame([("o", "b", 7, [D0, D0], [0.0]), ("o", "b", 7, [D0, D0 + timedelta(1)], [1.0])], "organization_id string, branch_id string, forecast_horizon int, future_dates array<date>, recent_daily_revenue array<double>")
    assert [r.reasons for r in requests.validate(days, "sales").collect()] == [["calendar_not_increasing", "no_revenue_history"], []]


def test_files_round_trip(spark, tmp_path, demand_model):
    folder = str(tmp_path)
    raw = spark.createDataFrame([("536365", "A", "Tea", "6", "45000.5", "2.5", "17850", "UK"), ("C1", "B", "Cup", "1", "45000", "2", "1", "UK"), ("2", "C", "Jar", "x", "2020-01-01", "2", "1", "UK")], list(schemas.RETAIL_EXPORT_NAMES))
    raw.write.option("header", True).csv(f"{folder}/sheet.csv")
    good, bad = files.read_sheet_export(spark, f"{folder}/sheet.csv")
    assert str(good.first().invoice_date) == "2023-03-15 12:00:00"
    assert {r.outcome: r.n_rows for r in files.ingest_counts(good, bad).collect()} == {"written": 1, "cancelled": 1, "not_a_number": 1}
    assert files.read_transactions(spark, f"{folder}/sheet.csv").columns == schemas.TRANSACTIONS.fieldNames()
    with pytest.raises(ValueError, match="Unsupported"):
        files.read_transactions(spark, f"{folder}/sheet.xlsx")
    files.write_feature_table(good, f"{folder}/features")
    stored = spark.read.parquet(f"{folder}/features/parquet")
    stats = files.table_stats(stored).first()
    assert (stats.n_rows, stats.n_columns) == (1, 8)
    table = spark.range(50).withColumn("k", F.col("id") % 3)
    a, b = (files.fingerprint(t).first() for t in (table, table.orderBy(F.desc("id"))))
    assert a == b and a != files.fingerprint(table.limit(49)).first() and len(a.fingerprint) == 16
    files.save_index(table, f"{folder}/index", "k")
    assert files.load_index(spark, f"{folder}/index").count() == 50
    files.save_model(demand_model.model, f"{folder}/model", {"mae": 1.0}, {"kind": "boosted"})
    _, metrics, metadata = files.load_model(spark, f"{folder}/model")
    assert metrics == {"mae": 1.0} and metadata["kind"] == "boosted" and "trained_at" in metadata
    with pytest.raises(FileNotFoundError):
        files.load_model(spark, f"{folder}/nowhere")
    for status in ("ok", "failed"):
        files.append_run(spark, f"{folder}/runs", "demand", status, 1.5, {"rows": 3})
    assert {r.status for r in spark.read.json(f"{folder}/runs").collect()} == {"ok", "failed"}
    assert json.loads(spark.read.json(f"{folder}/runs").first().details) == {"rows": 3}


def test_store_day_fields(spark, tmp_path):
    (tmp_path / "d.csv").write_text("Store,DayOfWeek,Date,Sales,Customers,Open,Promo,StateHoliday,SchoolHoliday\n1,5,2015-07-31,5263,555,,1,0.0,1\n2,5,2015-07-31,6064,,1,,a,\n")
    (tmp_path / "s.csv").write_text("Store,StoreType,Assortment,CompetitionDistance,CompetitionOpenSinceMonth,CompetitionOpenSinceYear,Promo2,Promo2SinceWeek,Promo2SinceYear,PromoInterval\n1,c,,1270,9,2008,0,,,\n")
    one, two = files.read_store_days(spark, str(tmp_path / "d.csv"), str(tmp_path / "s.csv")).orderBy("store_id").collect()
    assert (one.is_open, one.state_holiday, one.store_type, one.assortment) == (1, "0", "c", "a")
    assert (two.customers, two.is_promo, two.school_holiday, two.state_holiday, two.store_type) == (0, 0, 0, "a", None)
    row = files.check_csv_header(spark, str(tmp_path / "d.csv"), ["Store", "Nope"]).first()
    assert (row.missing_columns, row.n_rows, row.ok) == ("Nope", 2, False)


def test_stream_replays_and_updates(spark, tmp_path):
    """Two files arrive in two batches; a group touched twice keeps its newest value only."""
    folder = tmp_path / "in"
    for i, rows in enumerate([[("2024-01-01 10:00:00", "a", 1.0)], [("2024-01-01 12:00:00", "a", 2.0), ("2024-01-02 01:00:00", "b", 5.0)]]):
        df = spark.createDataFrame(rows, "ts string, k string, v double").withColumn("ts", F.to_timestamp("ts"))
        df.coalesce(1).write.mode("append").parquet(str(folder))
        del i
    stream = spark.readStream.schema("ts timestamp, k string, v double").option("maxFilesPerTrigger", 1).parquet(str(folder))
    changes = jobs.changed_groups(jobs.daily_totals(stream, "ts", ["k"], F.col("v")), "test")
    assert changes.count() == 3  # 'a' was written by both batches
    got = {(str(r.date), r.k): (r.total, r.n) for r in jobs.latest(changes, ["date", "k"]).collect()}
    assert got == {("2024-01-01", "a"): (3.0, 2), ("2024-01-02", "b"): (5.0, 1)}


def test_streams_count_late_files_and_read_directories(spark, tmp_path):
    """Part files in a table directory, the newest day first: every row counts, in every job."""
    folder = tmp_path / "in"
    for day in (20, 11, 2, 1):
        rows = [(f"2024-01-{day:02d} 10:00:00", "a", 7, 2.0), (f"2024-01-{day:02d} 11:00:00", "a", day, 1.0)]
        df = spark.createDataFrame(rows, "ts string, k string, order_id int, v double").withColumn("ts", F.to_timestamp("ts"))
        df.coalesce(1).write.mode("append").parquet(str(folder / "t.parquet"))
    stream = jobs.file_stream(spark, str(folder), "t", files_per_trigger=1)
    days = jobs.latest(jobs.changed_groups(jobs.daily_totals(stream, "ts", ["k"], F.col("v")), "days"), ["date", "k"])
    assert sorted((r.date.day, r.total, r.n) for r in days.collect()) == [(d, 3.0, 2) for d in (1, 2, 11, 20)]
    orders = jobs.latest(jobs.changed_groups(jobs.order_totals(stream, "k", "order_id", F.col("v"), "ts"), "orders"), ["k", "order_id"])
    total = jobs.running_totals(orders, "k", "order_id").first()
    assert (total.orders, total.spend, total.last_day.day) == (5, 12.0, 20)  # order 7 has lines in four batches
    arrived = stream.withColumn("seen", F.lit("2024-01-14").cast("date"))
    split = jobs.split_late(arrived, "ts", "seen", 3).groupBy("is_late").count()
    assert {tuple(r) for r in split.collect()} == {("late", 4), ("on_time", 4)}
    forecasts = spark.createDataFrame([("a", 1.0)], "k string, f double")
    weeks = jobs.latest(jobs.changed_groups(
        jobs.live_accuracy(stream, forecasts, ["k"], "ts", "v", "f", 0.5), "weeks"), ["window_start"])
    assert weeks.agg(F.sum("n")).first()[0] == 8


def test_event_days_lose_nothing(spark, tmp_path):
    """Eight files, the newest days first: late rows stand apart, the open days stay few, and all rows are counted."""
    folder = tmp_path / "in"
    rng = np.random.default_rng(3)
    every = [(D0 + timedelta(int(d)), f"p{rng.integers(3)}", f"b{rng.integers(2)}", float(rng.integers(1, 9)))
             for d in range(64) for _ in range(4)]
    for part in reversed(range(8)):
        rows = [r for r in every if (r[0] - D0).days // 8 == part] + [(D0 + timedelta(60), "p0", "b0", 1.0)]
        spark.createDataFrame(rows, "day date, p string, b string, v double").withColumn("ts", F.col("day").cast("timestamp")).coalesce(
            1).write.mode("append").parquet(str(folder / "t.parquet"))
    stream = jobs.file_stream(spark, str(folder), "t", files_per_trigger=1)
    closed, still_open, late = jobs.event_days(stream, "ts", ["p", "b"], F.col("v"), allowed_days=7)
    got = {tuple(r) for r in jobs.merged_days(closed, still_open, late, ["p", "b"]).collect()}
    batch = spark.read.parquet(str(folder / "t.parquet")).groupBy("day", "p", "b").agg(F.sum("v"), F.count(F.lit(1)))
    assert got == {tuple(r) for r in batch.collect()}
    assert late.count() > 0
    newest = D0 + timedelta(63)
    assert all(r.date >= newest - timedelta(7) for r in still_open.collect())
    assert not {tuple(r)[:3] for r in closed.collect()} & {tuple(r)[:3] for r in still_open.collect()}


def test_customer_state_counts_an_order_once(spark, tmp_path):
    folder = tmp_path / "in"
    lines = [("a", 7, 200, 20), ("a", 7, 100, 3), ("b", 1, 50, 5), ("a", 8, 10, 1), ("a", None, 5, 2), ("b", 1, 50, 6)]
    for start in (0, 2, 4):
        spark.createDataFrame([(c, o, x, D0 + timedelta(d)) for c, o, x, d in lines[start: start + 2]],
                              "k string, order_id int, cents long, day date").coalesce(1).write.mode("append").parquet(str(folder / "t.parquet"))
    stream = jobs.file_stream(spark, str(folder), "t", files_per_trigger=1)
    got = {r.k: (r.orders, r.spend, (r.last_day - D0).days) for r in jobs.customer_totals(stream, "k", "order_id", "cents", "day").collect()}
    assert got == {"a": (2, 315, 20), "b": (1, 100, 6)}


def test_streams_without_rows_give_empty_tables(spark, tmp_path):
    empty = spark.createDataFrame([], "ts timestamp, k string, seen date, v double")
    empty.write.parquet(str(tmp_path / "t.parquet"))
    stream = jobs.file_stream(spark, str(tmp_path), "t")
    assert jobs.changed_groups(jobs.daily_totals(stream, "ts", ["k"], F.col("v")), "none").count() == 0
    assert jobs.split_late(stream, "ts", "seen", 3).select("is_late", "k").count() == 0
    assert jobs.score_batches(stream, lambda batch: batch.select("k", F.col("v").alias("score"))).columns == ["k", "score"]


def test_best_columns_are_those_of_a_stable_sort():
    """the best products of a customer come from a partition; ties go to the smaller one, seen products never come."""
    import numpy as np

    from shelfline.operators import loyalty

    r = np.random.default_rng(0)
    for shape, depth in (((40, 300), 10), ((7, 5), 5), ((1, 1), 1)):
        scores = np.round(r.normal(size=shape), 1)
        scores[r.random(shape) < 0.2] = -np.inf
        scores[0] = -np.inf
        order = np.argsort(-scores, axis=1, kind="stable")[:, :depth]
        want = [(i, c) for i in range(len(scores)) for c in order[i] if np.isfinite(scores[i, c])]
        assert list(zip(*loyalty._best_columns(scores, depth))) == want
