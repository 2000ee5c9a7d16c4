"""Forecast accuracy queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import clean as clean_ops
from ..operators import features, metrics, splits
from ..session import cut_lineage
from . import panels, sales
from .registry import cte, query, rounded, sql

cte("naive", """
SELECT organization_id, branch_id, date, daily_revenue AS actual, is_operating_day AS is_open,
       CAST(sum(CAST(daily_revenue AS DECIMAL(28,6))) OVER w AS DOUBLE) / 7 AS predicted,
       CASE WHEN is_operating_day = 0 THEN 0 ELSE greatest(lag(daily_revenue, 7) OVER (PARTITION BY organization_id, branch_id ORDER BY date), 0) END AS baseline,
       row_number() OVER (PARTITION BY organization_id, branch_id ORDER BY date) AS r
FROM revenue_dense WINDOW w AS (PARTITION BY organization_id, branch_id ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)""", "revenue_dense")
cte("naive_test", """
SELECT n.*, dense_rank() OVER (ORDER BY n.date) AS p FROM naive n
WHERE n.date > (SELECT max(CASE WHEN p = greatest(2, CAST(floor(n * (0.7 + 0.15)) AS INTEGER)) THEN date END) FROM positions_dense)""",
    "naive", "positions_dense")
cte("positions_dense", """
SELECT date, row_number() OVER (ORDER BY date) AS p, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM revenue_dense)""", "revenue_dense")


def naive_forecast(spark, folder):
    """Test part of the branch-day series: actual, 7-day mean forecast, last-week baseline."""
    dense = panels.dense_revenue(spark, folder)
    cut = splits.fraction_cutoffs(dense).select("validation_end").scalar()
    table = features.sales_features(dense, rounded=False).where(F.col("date") > cut)
    return table.select(
        "organization_id", "branch_id", "date", F.col("daily_revenue").alias("actual"),
        F.col("rolling_mean_7").alias("predicted"), F.col("is_operating_day").alias("is_open"),
        metrics.lag7_baseline("is_operating_day", "revenue_lag_7").alias("baseline"),
    )


@query("regression_metrics", sql("""
SELECT branch_id, round(avg(abs(predicted - actual)), 4) AS mae, round(sqrt(avg((predicted - actual) ** 2)), 4) AS rmse,
       round(sum(abs(predicted - actual)) / greatest(sum(abs(actual)), 1e-9), 9) AS wape, count(*) AS n
FROM naive_test GROUP BY branch_id""", "naive_test"))
def regression_metrics(spark, folder):
    out = metrics.regression_metrics(naive_forecast(spark, folder), keys=["branch_id"])
    return rounded(out, 4, wape=9)


@query("forecasting_metrics", sql("""
SELECT round(mae, 4) AS mae, round(rmse, 4) AS rmse, round(wape, 6) AS wape, round(mae / scale, 6) AS mase FROM (
SELECT avg(abs(actual - predicted)) AS mae, sqrt(avg((actual - predicted) ** 2)) AS rmse, sum(abs(actual - predicted)) / sum(actual) AS wape FROM naive_test),
(SELECT avg(d) AS scale FROM (SELECT abs(daily_revenue - lag(daily_revenue, 7) OVER (PARTITION BY organization_id, branch_id ORDER BY date)) AS d
 FROM revenue_dense WHERE date <= (SELECT max(date) FROM revenue_dense WHERE date NOT IN (SELECT date FROM naive_test))))""", "naive_test", "revenue_dense"))
def forecasting_metrics(spark, folder):
    dense = panels.dense_revenue(spark, folder)
    cut = splits.fraction_cutoffs(dense).select("validation_end").scalar()
    scale = metrics.seasonal_scale(
        dense.where(F.col("date") <= cut), "daily_revenue", "date", ["organization_id", "branch_id"]
    )
    return metrics.forecasting_metrics(naive_forecast(spark, folder), scale=scale)


def _fva_sql() -> str:
    one = """SELECT '{label}' AS horizon, round(sum(abs(predicted - actual)) / greatest(sum(abs(actual)), 1e-9), 9) AS wape,
 round(avg(abs(predicted - actual)), 4) AS mae, round(sqrt(avg((predicted - actual) ** 2)), 4) AS rmse,
 round(avg(abs(baseline - actual)), 4) AS baseline_mae, round(sum(abs(baseline - actual)) / greatest(sum(abs(actual)), 1e-9), 9) AS baseline_wape,
 round(1 - avg(abs(predicted - actual)) / avg(abs(baseline - actual)), 9) AS fva FROM naive_test WHERE p <= {h}"""
    parts = [one.format(label=f"horizon_{h}d", h=h) for h in (7, 14, 30)] + [one.format(label="overall_test", h=10**9)]
    return sql("\nUNION ALL\n".join(parts), "naive_test")


@query("fva_by_horizon", _fva_sql())
def fva_by_horizon(spark, folder):
    out = metrics.horizon_metrics(naive_forecast(spark, folder))
    return rounded(out, 4, wape=9, baseline_wape=9, fva=9)


@query("pinball_loss", sql("""
SELECT level, round(avg(greatest(level * (actual - predicted), (level - 1) * (actual - predicted))), 4) AS pinball_loss
FROM naive_test, (VALUES (0.5::DOUBLE), (0.9::DOUBLE)) l(level) GROUP BY level""", "naive_test"))
def pinball_loss(spark, folder):
    return rounded(metrics.pinball_loss(naive_forecast(spark, folder)), 4)


@query("direct_horizon_backtest", sql("""
, cuts AS (SELECT date, row_number() OVER (ORDER BY date) AS p, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM panel))
, bounds AS (SELECT max(CASE WHEN p = greatest(1, CAST(floor(n * 0.7) AS INTEGER)) THEN date END) + 1 AS lo, max(date) AS hi FROM cuts)
, origins AS (
  SELECT date, row_number() OVER w AS r, avg(quantity) OVER (w ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING) AS m,
    sum(quantity) OVER (w ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING) AS s7, sum(quantity) OVER (w ROWS BETWEEN CURRENT ROW AND 13 FOLLOWING) AS s14,
    sum(quantity) OVER (w ROWS BETWEEN CURRENT ROW AND 29 FOLLOWING) AS s30 FROM panel WINDOW w AS (PARTITION BY product_id ORDER BY date))
, cases AS (SELECT h AS horizon_days, CASE h WHEN 7 THEN s7 WHEN 14 THEN s14 ELSE s30 END AS a, m * h AS f
  FROM origins, bounds, (VALUES (7), (14), (30)) t(h) WHERE r > 28 AND date >= lo AND date <= hi - (h - 1))
SELECT horizon_days, round(avg(abs(f - a)), 6) AS mae, round(sqrt(avg((f - a) ** 2)), 6) AS rmse, round(sum(abs(f - a)) / greatest(sum(abs(a)), 1e-9), 6) AS wape,
  count(*) AS origins, round(avg(f - a), 6) AS bias, round(sum(a), 4) AS actual_total, round(sum(f), 4) AS predicted_total FROM cases GROUP BY horizon_days""",
    "panel").replace(")\n\n, cuts", ")\n, cuts"))
def direct_horizon_backtest(spark, folder):
    daily = cut_lineage(clean_ops.daily_product_sales(sales.clean(spark, folder, names=True)), "daily-sales")
    days = clean_ops.sales_calendar(daily)
    end = days.agg(F.max("date")).scalar()
    start = F.date_add(splits.fraction_cutoffs(days).select("train_end").scalar(), 1)
    # origins begin after the training days; each reads the 28 days before it
    panel = clean_ops.dense_panel(daily, last_days=F.date_diff(end, start) + 1 + 28)
    out = metrics.direct_horizon_backtest(panel, start, end)
    return rounded(out, 6, actual_total=4, predicted_total=4)
