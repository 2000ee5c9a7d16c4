"""Model training, scoring and recursive forecasts (no SQL form)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean as clean_ops
from ..operators import features, metrics, models, pricing, recursion, stock
from ..session import cut_lineage
from ..sources import star_schema as star
from . import panels, sales
from . import stock as stock_plans
from .registry import query, rounded

#: Trees per model in the registered queries; the library defaults are the full counts.
TREES = 10


#: Best sellers the demand model is fitted on: its training parameter. What it forecasts and prices is all products.
TRAINING_PRODUCTS = 200


def stock_table(spark, folder):
    """Training table, written once: every boosting round and metric pass reads the copy."""
    panel = clean_ops.daily_product_panel(sales.clean(spark, folder, names=True), top=TRAINING_PRODUCTS)
    return cut_lineage(features.stock_features(panel), "stock-features")


def unit_table(spark, folder):
    return cut_lineage(star.unit_demand(spark, folder), "unit-demand")


def revenue_table(spark, folder):
    """(dense revenue, its features), both written once."""
    dense = cut_lineage(panels.dense_revenue(spark, folder), "revenue")
    return dense, cut_lineage(features.sales_features(dense), "revenue-features")


@query("demand_model_eval")
def demand_model_eval(spark, folder):
    """Next-day demand model against last week's value on the test dates."""
    return rounded(models.fit_next_day_demand(stock_table(spark, folder), max_iter=TREES, step=0.3).metrics)


@query("revenue_model_eval")
def revenue_model_eval(spark, folder):
    """Branch revenue model with early stopping and refit."""
    _, table = revenue_table(spark, folder)
    fitted = models.fit_daily_revenue(table, max_iter=TREES, step=0.3)
    return fitted.metrics.withColumn("trees", F.lit(fitted.details["trees"]))


def unit_levels(table):
    """Category and brand-free contract levels of the star-schema tables."""
    types = [r[0] for r in table.select("category").distinct().orderBy("category").collect()]
    return {**models.UNIT_DEMAND_LEVELS, "category": types}


@query("model_bakeoff")
def model_bakeoff(spark, folder):
    table = unit_table(spark, folder)
    params = {"boosted": {"maxIter": TREES, "stepSize": 0.3}, "forest": {"numTrees": TREES}, "linear": {}}
    _, report = models.bake_off(table, params, models.UNIT_DEMAND_FEATURES, unit_levels(table))
    return rounded(report)


@query("bakeoff_winner_horizons")
def bakeoff_winner_horizons(spark, folder):
    """The winner's test metrics on the first 7, 14, 30 and all test dates, next to the units of the
    same product and store a week before (none sold: zero) as baseline."""
    table = unit_table(spark, folder)
    before = table.select(
        F.date_add("date", 7).alias("date"), "product_id", "store_id", F.col("units_sold").alias("demand_lag_7")
    )
    lagged = cut_lineage(table.join(before, ["date", "product_id", "store_id"], "left").na.fill(0, ["demand_lag_7"]), "lagged")
    params = {"boosted": {"maxIter": TREES, "stepSize": 0.3}, "forest": {"numTrees": TREES}, "linear": {}}
    winner, _ = models.bake_off(lagged, params, models.UNIT_DEMAND_FEATURES, unit_levels(table))
    return rounded(metrics.horizon_metrics(winner.metrics.withColumn("baseline", metrics.lag7_baseline())))


@query("unit_forecast")
def unit_forecast(spark, folder):
    """Seven days ahead for every product type and store, total per request."""
    table = unit_table(spark, folder)
    fitted = models.fit(
        table.where("is_open = 1"), models.UNIT_DEMAND_FEATURES, "units_sold",
        models.regressor("boosted", maxIter=TREES, stepSize=0.3), levels=unit_levels(table),
    )
    last = table.groupBy("product_id", "store_id").agg(F.max("date").alias("d"), F.max_by(
        F.struct("category", "unit_price", "base_unit_price", "store_type", "assortment", "promo2"), "date"
    ).alias("c"))
    requests = last.select(
        F.concat_ws("|", "product_id", F.col("store_id").cast("string")).alias("request_id"), "product_id", "store_id",
        F.date_add("d", 1).alias("forecast_date"), F.lit(7).alias("horizon"), "c.*",
    )
    return models.forecast_totals(models.forecast_units(fitted, requests))


def recursive_curve(spark, folder, days=60):
    table = stock_table(spark, folder)
    fitted = models.fit_next_day_demand(table, max_iter=TREES, step=0.3)
    panel = sales.product_panel(spark, folder, stock_plans.HISTORY)
    series = stock.history_series(panel, ["product_id"])
    latest = stock_plans.latest_features(spark, folder).select(
        "product_id", "unit_price", "price_index_28", "orders_lag_1", "customers_lag_1"
    )
    asked = series.join(latest, "product_id").withColumn("start_date", F.date_add("last_date", 1))
    raw = recursion.recursive_demand(asked, fitted, ["product_id"], days)
    return series, stock.calibrate_curve(raw, series, ["product_id"])


@query("recursive_forecast")
def recursive_forecast(spark, folder):
    """60 recursive days of every product, calibrated to the direct totals."""
    _, curve = recursive_curve(spark, folder)
    return rounded(curve)


@query("recursive_stock_plan")
def recursive_stock_plan(spark, folder):
    series, curve = recursive_curve(spark, folder)
    return rounded(stock.plan_from_curve(curve, series, stock_plans.policy(spark, folder), ["product_id"]))


@query("recursive_revenue_forecast")
def recursive_revenue_forecast(spark, folder):
    """14 recursive days of revenue per branch; Sundays are closed."""
    dense, table = revenue_table(spark, folder)
    fitted = models.fit(
        table, models.SALES_FEATURES, "daily_revenue",
        models.regressor("boosted", maxIter=TREES, stepSize=0.3), log_target=False,
    )
    series = stock.history_series(dense, ["organization_id", "branch_id"], "daily_revenue")
    first = dense.groupBy("organization_id", "branch_id").agg(F.min("date").alias("first_date"))
    day = lambda i: F.date_add("last_date", i)
    calendar = F.array(
        *[
            F.struct(
                day(i).alias("date"), F.when(F.weekday(day(i)) == 6, 0).otherwise(1).alias("is_operating_day"),
                F.lit(0).alias("active_discounts"),
            )
            for i in range(1, 15)
        ]
    )
    asked = series.join(first, ["organization_id", "branch_id"]).withColumn("calendar", calendar)
    return recursion.recursive_revenue(asked, fitted, ["organization_id", "branch_id"])


@query("pricing_recommendation")
def pricing_recommendation(spark, folder):
    """Guard-railed price per product under the fitted price-conditioned demand model."""
    fitted = models.fit_next_day_demand(stock_table(spark, folder), max_iter=TREES, step=0.3)
    chosen = pricing.recommend_price(
        stock_plans.price_requests(spark, folder), ["product_id"], lambda df: models.score(fitted, df, "demand")
    )
    return rounded(chosen)
