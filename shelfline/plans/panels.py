"""Demand panel and features, holiday flags, branch revenue features, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..operators import demand_panel as panel_ops
from ..operators import features, splits
from ..session import cut_lineage
from ..sources import star_schema as star
from .registry import cte, query, rounded, sql

cte("branch_of", """
SELECT s_suppkey, n_name AS branch_id, r_name AS organization_id, n_nationkey AS branch_key
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
cte("records", """
SELECT organization_id, branch_id, p_type AS product_id, CAST(o_orderdate AS DATE) AS date,
       l_quantity AS quantity, l_extendedprice / l_quantity AS unit_price,
       p_retailprice * 0.6 AS cost_price, p_retailprice AS selling_price,
       CAST(p_size AS DOUBLE) AS reorder_level, p_type AS category_id, p_brand AS brand_id,
       CASE WHEN l_discount >= 0.08 THEN 1 ELSE 0 END AS promo, l_discount AS discount_rate,
       l_orderkey * 8 + l_linenumber AS seq
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN branch_of ON l_suppkey = s_suppkey
JOIN part ON l_partkey = p_partkey""", "branch_of")
cte("demand_daily", """
SELECT organization_id, branch_id, product_id, date, sum(quantity) AS quantity,
       median(unit_price) AS unit_price, last(cost_price ORDER BY seq, cost_price) AS cost_price,
       last(selling_price ORDER BY seq, selling_price) AS selling_price,
       last(reorder_level ORDER BY seq, reorder_level) AS reorder_level,
       first(category_id ORDER BY seq, category_id) AS category_id,
       first(brand_id ORDER BY seq, brand_id) AS brand_id, max(promo) AS has_scheduled_discount,
       max(discount_rate) AS discount_rate
FROM records GROUP BY ALL""", "records")
cte("attributes", """
SELECT organization_id, product_id, last(cost_price ORDER BY branch_id, date) AS cost_price,
       last(selling_price ORDER BY branch_id, date) AS selling_price,
       last(reorder_level ORDER BY branch_id, date) AS reorder_level,
       first(category_id ORDER BY branch_id, date) AS category_id,
       first(brand_id ORDER BY branch_id, date) AS brand_id
FROM demand_daily GROUP BY organization_id, product_id""", "demand_daily")
cte("demand_spine", """
SELECT organization_id, branch_id, product_id,
       CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date
FROM (SELECT DISTINCT organization_id, branch_id, product_id FROM demand_daily),
     (SELECT min(date) AS lo, max(date) AS hi FROM demand_daily)""", "demand_daily")
cte("closed", """
SELECT DISTINCT organization_id, branch_id, date FROM records WHERE isodow(date) = 7""", "records")
cte("stockouts", """
SELECT organization_id, branch_id, product_id, CAST(date + INTERVAL 1 DAY AS DATE) AS date
FROM demand_daily WHERE quantity >= 80""", "demand_daily")
cte("demand_panel", """
SELECT s.organization_id, s.branch_id, s.product_id, s.date,
       CASE WHEN c.date IS NOT NULL THEN 0 ELSE coalesce(d.quantity, 0) END AS quantity,
       coalesce(d.unit_price, a.selling_price, 0) AS unit_price, a.cost_price, a.selling_price,
       a.reorder_level, a.category_id, a.brand_id,
       coalesce(d.has_scheduled_discount, 0) AS has_scheduled_discount,
       coalesce(d.discount_rate, 0) AS discount_rate,
       CAST(o.date IS NULL AS INTEGER) AS is_in_stock, CAST(c.date IS NULL AS INTEGER) AS is_branch_open
FROM demand_spine s
LEFT JOIN demand_daily d USING (organization_id, branch_id, product_id, date)
LEFT JOIN attributes a USING (organization_id, product_id)
LEFT JOIN closed c USING (organization_id, branch_id, date)
LEFT JOIN stockouts o USING (organization_id, branch_id, product_id, date)""",
    "demand_spine", "demand_daily", "attributes", "closed", "stockouts")
cte("revenue_days", """
SELECT organization_id, branch_id, CAST(o_orderdate AS DATE) AS date,
       CAST(sum(CAST(l_extendedprice AS DECIMAL(28,2))) AS DOUBLE) AS daily_revenue,
       CAST(sum(CASE WHEN l_discount >= 0.09 THEN 1 ELSE 0 END) AS INTEGER) AS active_discount_count
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN branch_of ON l_suppkey = s_suppkey
GROUP BY ALL""", "branch_of")
cte("revenue_dense", """
SELECT s.organization_id, s.branch_id, s.date, coalesce(daily_revenue, 0) AS daily_revenue,
       coalesce(active_discount_count, 0) AS active_discount_count,
       CAST(d.date IS NOT NULL AS INTEGER) AS is_operating_day
FROM (SELECT organization_id, branch_id,
             CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date
      FROM revenue_days GROUP BY organization_id, branch_id) s
LEFT JOIN revenue_days d USING (organization_id, branch_id, date)""", "revenue_days")
POYA_SQL = ", ".join(f"DATE '{d}'" for d in cal.POYA_DAYS)
HOLIDAY_SQL = f"""
       CAST(date IN ({POYA_SQL}) OR strftime(date, '%m-%d') IN ('01-01','02-04','04-12','04-13','04-14','05-01','12-25') AS INTEGER) AS is_public_holiday,
       CAST(date IN ({POYA_SQL}) OR strftime(date, '%m-%d') IN ('02-04','04-13','04-14','05-01','12-25') AS INTEGER) AS is_mercantile_holiday,
       CAST(date IN ({POYA_SQL}) AS INTEGER) AS is_poya_day,
       CAST((month(date) = 4 AND day(date) BETWEEN 10 AND 18)
         OR (month(date) = 5 AND (day(date) <= 25 OR date IN ({POYA_SQL})))
         OR (month(date) = 12 AND day(date) >= 15) AS INTEGER) AS is_festive_peak"""


def demand_panel(spark, folder):
    records = cut_lineage(star.demand_records(spark, folder), "demand-records")
    closed = records.where(F.weekday("date") == 6)
    daily = panel_ops.daily_demand(records)
    stockouts = daily.where("quantity >= 80").withColumn("date", F.date_add("date", 1))
    return panel_ops.build_demand_panel(records, closed_days=closed, out_of_stock_days=stockouts)


def revenue_days(spark, folder):
    """Observed branch-days, written once: one row per branch and day."""
    return cut_lineage(star.branch_revenue(spark, folder), "revenue-days")


def dense_revenue(spark, folder):
    return features.dense_branch_days(revenue_days(spark, folder))


@query("demand_panel", sql("""
SELECT * REPLACE (round(unit_price, 6) AS unit_price, round(cost_price, 6) AS cost_price,
                  CAST(quantity AS DOUBLE) AS quantity)
FROM demand_panel""", "demand_panel"), dates=("date",))
def demand_panel_query(spark, folder):
    return rounded(demand_panel(spark, folder))


def _lags():
    return ", ".join(f"lag(quantity, {k}) OVER w AS demand_lag_{k}" for k in (1, 2, 3, 7, 14, 21, 28))


def _rolls():
    parts = []
    for n in (7, 14, 28):
        parts += [
            f"round(avg(quantity) OVER w{n}, 6) AS rolling_mean_{n}",
            f"round(coalesce(stddev_samp(quantity) OVER w{n}, 0), 6) AS rolling_std_{n}",
            f"max(quantity) OVER w{n} AS rolling_max_{n}",
        ]
    return ", ".join(parts)


SERIES = "PARTITION BY organization_id, branch_id, product_id ORDER BY date"


@query("demand_features", sql(f"""
SELECT * FROM (
SELECT organization_id, branch_id, product_id, date, quantity, round(unit_price, 6) AS unit_price,
       round(cost_price, 6) AS cost_price, selling_price, reorder_level, category_id, brand_id,
       has_scheduled_discount, discount_rate, is_in_stock, is_branch_open, {_lags()}, {_rolls()},
       round(greatest(least(coalesce(unit_price / nullif(median(unit_price) OVER w28, 0), 1), 10), 0.1), 6) AS price_index_28,
       round(greatest(least((selling_price - cost_price) / greatest(selling_price, 0.01), 1), -1), 6) AS margin_rate,
       CAST(isodow(date) - 1 AS INTEGER) AS day_of_week, CAST(day(date) AS INTEGER) AS day_of_month,
       CAST(month(date) AS INTEGER) AS month, CAST(isodow(date) >= 6 AS INTEGER) AS is_weekend,
       CAST(day(date) = 1 AS INTEGER) AS is_month_start, CAST(last_day(date) = date AS INTEGER) AS is_month_end,
       CAST(day(date) >= 25 OR day(date) <= 3 AS INTEGER) AS is_payday_window, {HOLIDAY_SQL}
FROM (SELECT * REPLACE (CAST(quantity AS DOUBLE) AS quantity) FROM demand_panel)
WINDOW w AS ({SERIES}),
       w7 AS ({SERIES} ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING),
       w14 AS ({SERIES} ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING),
       w28 AS ({SERIES} ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING))
WHERE demand_lag_28 IS NOT NULL""", "demand_panel"), dates=("date",))
def demand_features(spark, folder):
    return rounded(features.demand_features(demand_panel(spark, folder)))


@query("holiday_flags", sql(f"""
SELECT date, {HOLIDAY_SQL} FROM (
SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders
UNION SELECT DISTINCT CAST(ts AS DATE) FROM events)"""), dates=("date",))
def holiday_flags(spark, folder):
    days = (
        star.table(spark, folder, "orders").select(F.col("o_orderdate").cast("date").alias("date"))
        .unionByName(star.table(spark, folder, "events").select(F.col("ts").cast("date").alias("date")))
        .distinct()
    )
    return days.withColumns(cal.holiday_flags(F.col("date")))


BRANCH = "PARTITION BY organization_id, branch_id ORDER BY date"


@query("sales_features", sql(f"""
SELECT * EXCLUDE (row_no) FROM (
SELECT organization_id, branch_id, date, daily_revenue, active_discount_count, is_operating_day,
       row_number() OVER w AS row_no,
       CAST(isodow(date) - 1 AS INTEGER) AS day_of_week, CAST(day(date) AS INTEGER) AS day_of_month,
       CAST(month(date) AS INTEGER) AS month, CAST(weekofyear(date) AS INTEGER) AS week_of_year,
       CAST(isodow(date) >= 6 AS INTEGER) AS is_weekend, CAST(day(date) = 1 AS INTEGER) AS is_month_start,
       CAST(last_day(date) = date AS INTEGER) AS is_month_end,
       round(sin((isodow(date) - 1) * 2 * pi() / 7), 4) + 0.0 AS day_of_week_sin,
       round(cos((isodow(date) - 1) * 2 * pi() / 7), 4) + 0.0 AS day_of_week_cos,
       round(sin((month(date) - 1) * 2 * pi() / 12), 4) + 0.0 AS month_sin,
       round(cos((month(date) - 1) * 2 * pi() / 12), 4) + 0.0 AS month_cos,
       lag(daily_revenue, 1) OVER w AS revenue_lag_1, lag(daily_revenue, 7) OVER w AS revenue_lag_7,
       lag(daily_revenue, 14) OVER w AS revenue_lag_14, lag(daily_revenue, 28) OVER w AS revenue_lag_28,
       CAST(sum(CAST(daily_revenue AS DECIMAL(28,6))) OVER w7 AS DOUBLE) / count(*) OVER w7 AS rolling_mean_7, CAST(sum(CAST(daily_revenue AS DECIMAL(28,6))) OVER w14 AS DOUBLE) / count(*) OVER w14 AS rolling_mean_14,
       CAST(sum(CAST(daily_revenue AS DECIMAL(28,6))) OVER w28 AS DOUBLE) / count(*) OVER w28 AS rolling_mean_28,
       round(stddev_samp(daily_revenue) OVER w7, 2) AS rolling_std_7,
       round(stddev_samp(daily_revenue) OVER w28, 2) AS rolling_std_28,
       CASE WHEN avg(daily_revenue) OVER p7 > 0
            THEN (CAST(sum(CAST(daily_revenue AS DECIMAL(28,6))) OVER w7 AS DOUBLE) / count(*) OVER w7)
               / (CAST(sum(CAST(daily_revenue AS DECIMAL(28,6))) OVER p7 AS DOUBLE) / count(*) OVER p7) ELSE 1 END AS weekly_momentum_ratio,
       CAST(date - min(date) OVER w AS INTEGER) AS branch_age_days,
       CAST(sum(CAST(daily_revenue AS DECIMAL(28,6))) OVER wall AS DOUBLE) / count(*) OVER wall AS branch_historical_avg_sales
FROM revenue_dense
WINDOW w AS ({BRANCH}), w7 AS ({BRANCH} ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING),
       w14 AS ({BRANCH} ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING),
       w28 AS ({BRANCH} ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING),
       p7 AS ({BRANCH} ROWS BETWEEN 14 PRECEDING AND 8 PRECEDING),
       wall AS ({BRANCH} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
WHERE row_no > 28""", "revenue_dense"), dates=("date",))
def sales_features(spark, folder):
    df = features.sales_features(dense_revenue(spark, folder), rounded=False)
    angles = ("day_of_week_sin", "day_of_week_cos", "month_sin", "month_cos")
    stds = ("rolling_std_7", "rolling_std_28")
    out = rounded(df, 4, only=angles + stds, rolling_std_7=2, rolling_std_28=2)
    # -0.0 and 0.0 are one value but print differently
    return out.withColumns({c: F.col(c) + F.lit(0.0) for c in angles})


@query("branch_daily_revenue", sql("SELECT * FROM revenue_dense", "revenue_dense"), dates=("date",))
def branch_daily_revenue(spark, folder):
    return dense_revenue(spark, folder)


SPLIT_SQL = """
SELECT split, count(*) AS n_rows, count(DISTINCT date) AS n_dates, min(date) AS first_date, max(date) AS last_date
FROM (SELECT date, CASE WHEN date <= train_end THEN 'train' WHEN date <= validation_end THEN 'validation' ELSE 'test' END AS split
      FROM revenue_days, cutoffs) GROUP BY split"""
DATES = "SELECT date, row_number() OVER (ORDER BY date) AS p, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM revenue_days)"
cte("positions", DATES, "revenue_days")


def _split_sql(first: str, second: str) -> str:
    body = SPLIT_SQL.replace("cutoffs", f"""(SELECT max(CASE WHEN p = {first} THEN date END) AS train_end,
        max(CASE WHEN p = {second} THEN date END) AS validation_end FROM positions)""")
    return sql(body, "positions")


@query("split_by_fraction", _split_sql("greatest(1, CAST(floor(n * 0.7) AS INTEGER))",
                                       "greatest(2, CAST(floor(n * (0.7 + 0.15)) AS INTEGER))"),
       dates=("first_date", "last_date"))
def split_by_fraction(spark, folder):
    df = revenue_days(spark, folder)
    return splits.split_summary(splits.label_split(df, splits.fraction_cutoffs(df)))


@query("split_by_count", _split_sql("CAST(floor(n * 0.7) AS INTEGER)",
                                    "CAST(floor(n * 0.7) AS INTEGER) + CAST(floor(n * 0.15) AS INTEGER)"),
       dates=("first_date", "last_date"))
def split_by_count(spark, folder):
    df = revenue_days(spark, folder)
    return splits.split_summary(splits.label_split(df, splits.count_cutoffs(df)))


@query("split_last_days", _split_sql("n - 60", "n - 30"), dates=("first_date", "last_date"))
def split_last_days(spark, folder):
    df = revenue_days(spark, folder)
    return splits.split_summary(splits.label_split(df, splits.tail_cutoffs(df)))


@query("split_fixed_dates", sql("""
SELECT split, count(*) AS n_rows, count(DISTINCT date) AS n_dates, min(date) AS first_date, max(date) AS last_date
FROM (SELECT date, CASE WHEN date < DATE '2000-01-01' THEN 'train' WHEN date < DATE '2001-01-01' THEN 'validation' ELSE 'test' END AS split
      FROM revenue_days) GROUP BY split""", "revenue_days"), dates=("first_date", "last_date"))
def split_fixed_dates(spark, folder):
    df = revenue_days(spark, folder)
    return splits.split_summary(splits.label_fixed(df, "2000-01-01", "2001-01-01", "date"))


@query("expanding_folds", sql("""
SELECT fold, CASE WHEN d < n THEN 'train' ELSE 'test' END AS split, count(*) AS n_rows,
       CAST(sum(CAST(daily_revenue AS DECIMAL(28,2))) AS DOUBLE) AS revenue
FROM (SELECT daily_revenue, date - (SELECT min(date) FROM revenue_days) AS d FROM revenue_days)
JOIN (VALUES (1, 180), (2, 210), (3, 240), (4, 270)) f(fold, n) ON d < n + 30
GROUP BY ALL""", "revenue_days"))
def expanding_folds(spark, folder):
    folds = splits.expanding_folds(revenue_days(spark, folder))
    return folds.groupBy("fold", "split").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.col("daily_revenue").cast("decimal(28,2)")).cast("double").alias("revenue"),
    )
