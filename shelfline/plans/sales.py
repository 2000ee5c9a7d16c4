"""Cleaning, daily sales, product panel and stock features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean as ops
from ..operators import features
from ..session import cut_lineage
from ..sources import star_schema as star
from .registry import cte, query, rounded, sql

cte("tx_base", """
SELECT CASE WHEN l_returnflag = 'R' THEN 'C' ELSE '' END || CAST(l_orderkey AS VARCHAR) AS invoice_no,
       CAST(l_partkey AS VARCHAR) AS product_id, l_quantity AS quantity, o_orderdate AS invoice_date,
       l_extendedprice / l_quantity AS unit_price, CAST(o_custkey AS VARCHAR) AS customer_id,
       l_partkey, o_custkey
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
cte("valid", """
SELECT * FROM tx_base
WHERE NOT starts_with(upper(invoice_no), 'C') AND quantity > 0 AND unit_price > 0""", "tx_base")
cte("caps", """
SELECT quantile_cont(quantity, 0.995) AS quantity_cap, quantile_cont(unit_price, 0.995) AS price_cap
FROM valid""", "valid")
cte("clean", """
SELECT valid.*, quantity * unit_price AS revenue, CAST(invoice_date AS DATE) AS date
FROM valid, caps WHERE quantity <= quantity_cap AND unit_price <= price_cap""", "valid", "caps")
cte("top200", """
SELECT product_id, sum(quantity) AS quantity FROM clean GROUP BY product_id
ORDER BY quantity DESC, product_id LIMIT 200""", "clean")
cte("sold", "SELECT DISTINCT product_id FROM clean", "clean")
cte("panel_daily", """
SELECT date, clean.product_id, sum(clean.quantity) AS quantity, CAST(sum(CAST(revenue AS DECIMAL(28,6))) AS DOUBLE) AS revenue,
       count(DISTINCT invoice_no) AS orders, count(DISTINCT customer_id) AS customers,
       CAST(sum(CAST(revenue AS DECIMAL(28,6))) AS DOUBLE) / greatest(sum(clean.quantity), 1) AS unit_price, max(p_name) AS description
FROM clean JOIN part ON p_partkey = l_partkey
GROUP BY date, clean.product_id""", "clean")
cte("panel_spine", """
SELECT product_id, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date
FROM sold, (SELECT min(date) AS lo, max(date) AS hi FROM panel_daily)""", "sold", "panel_daily")
cte("panel", """
SELECT s.product_id, s.date, coalesce(quantity, 0) AS quantity, coalesce(revenue, 0) AS revenue,
       coalesce(orders, 0) AS orders, coalesce(customers, 0) AS customers,
       coalesce(last_value(unit_price IGNORE NULLS) OVER back, first_value(unit_price IGNORE NULLS) OVER fore) AS unit_price,
       coalesce(last_value(description IGNORE NULLS) OVER back, first_value(description IGNORE NULLS) OVER fore) AS description
FROM panel_spine s LEFT JOIN panel_daily d ON s.product_id = d.product_id AND s.date = d.date
WINDOW back AS (PARTITION BY s.product_id ORDER BY s.date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
       fore AS (PARTITION BY s.product_id ORDER BY s.date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""",
    "panel_spine", "panel_daily")
cte("stock_features", """
SELECT * FROM (
SELECT product_id, date, quantity,
       lag(quantity, 1) OVER w AS demand_lag_1, lag(quantity, 7) OVER w AS demand_lag_7,
       lag(quantity, 14) OVER w AS demand_lag_14,
       CASE WHEN count(quantity) OVER w7 >= 3 THEN avg(quantity) OVER w7 END AS rolling_mean_7,
       CASE WHEN count(quantity) OVER w28 >= 7 THEN avg(quantity) OVER w28 END AS rolling_mean_28,
       CASE WHEN count(quantity) OVER w7 >= 3 THEN stddev_samp(quantity) OVER w7 END AS rolling_std_7,
       unit_price,
       CASE WHEN count(unit_price) OVER w28 >= 7
            THEN unit_price / greatest(median(unit_price) OVER w28, 0.01) END AS price_index_28,
       CAST(lag(orders) OVER w AS DOUBLE) AS orders_lag_1,
       CAST(lag(customers) OVER w AS DOUBLE) AS customers_lag_1,
       CAST(isodow(date) - 1 AS INTEGER) AS day_of_week, CAST(month(date) AS INTEGER) AS month,
       CAST(isodow(date) >= 6 AS INTEGER) AS is_weekend
FROM panel
WINDOW w AS (PARTITION BY product_id ORDER BY date),
       w7 AS (PARTITION BY product_id ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING),
       w28 AS (PARTITION BY product_id ORDER BY date ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING))
WHERE demand_lag_14 IS NOT NULL AND rolling_mean_28 IS NOT NULL AND price_index_28 IS NOT NULL""", "panel")

def clean(spark, folder, names=False):
    """Cleaned lines. The joined raw lines are written once: the caps and every user of the cleaned
    table read that copy instead of repeating the join."""
    return ops.clean_transactions(cut_lineage(star.transactions(spark, folder, names), "transactions"))


def product_panel(spark, folder, last_days=None):
    """Dense panel of all products; of their last days where no more is read."""
    return ops.daily_product_panel(clean(spark, folder, names=True), last_days=last_days)


@query("clean_transactions", sql("""
SELECT invoice_no, clean.product_id, p_name AS description, quantity, CAST(invoice_date AS DATE) AS invoice_day,
       unit_price, customer_id, n_name AS country, revenue
FROM clean JOIN part ON l_partkey = p_partkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey""", "clean"), dates=("invoice_day",))
def clean_transactions(spark, folder):
    df = clean(spark, folder, names=True)
    return df.drop("invoice_date").withColumnRenamed("date", "invoice_day")


@query("outlier_caps", sql("""
SELECT round(quantity_cap, 6) AS quantity_cap, round(price_cap, 6) AS price_cap FROM caps""", "caps"))
def outlier_caps(spark, folder):
    lines = cut_lineage(star.transactions(spark, folder, False), "transactions")
    valid = ops.valid_sales(ops.typed_transactions(lines))
    caps = ops.outlier_caps(valid)
    return rounded(
        valid.limit(1).select(
            F.lit(caps["quantity"]).alias("quantity_cap"), F.lit(caps["unit_price"]).alias("price_cap")
        )
    )


@query("daily_product_sales", sql("""
SELECT date, clean.product_id, sum(quantity) AS quantity, CAST(sum(CAST(revenue AS DECIMAL(28,6))) AS DOUBLE) AS revenue,
       count(DISTINCT invoice_no) AS orders, count(DISTINCT customer_id) AS customers,
       max(p_name) AS description, CAST(sum(CAST(revenue AS DECIMAL(28,6))) AS DOUBLE) / greatest(sum(quantity), 1) AS unit_price
FROM clean JOIN part ON l_partkey = p_partkey GROUP BY date, clean.product_id""", "clean"), dates=("date",))
def daily_product_sales(spark, folder):
    return ops.daily_product_sales(clean(spark, folder, names=True))


@query("top_products", sql("SELECT product_id, quantity FROM top200", "top200"))
def top_products(spark, folder):
    return ops.top_products(clean(spark, folder))


@query("daily_product_panel", sql("""
SELECT product_id, date, quantity, revenue, CAST(orders AS BIGINT) AS orders,
       CAST(customers AS BIGINT) AS customers, unit_price, description
FROM panel""", "panel"), dates=("date",))
def daily_product_panel(spark, folder):
    return product_panel(spark, folder)


@query("stock_features", sql("""
SELECT product_id, date, quantity, demand_lag_1, demand_lag_7, demand_lag_14,
       round(rolling_mean_7, 6) AS rolling_mean_7, round(rolling_mean_28, 6) AS rolling_mean_28,
       round(rolling_std_7, 6) AS rolling_std_7, unit_price,
       round(price_index_28, 6) AS price_index_28, orders_lag_1, customers_lag_1, day_of_week, month,
       is_weekend FROM stock_features""", "stock_features"), dates=("date",))
def stock_features(spark, folder):
    df = features.stock_features(product_panel(spark, folder))
    df = df.drop("revenue", "orders", "customers", "description")
    return rounded(df, only=("rolling_mean_7", "rolling_mean_28", "rolling_std_7", "price_index_28"))


@query("product_panel_profile", sql("""
SELECT product_id, count(*) AS days, count(*) FILTER (WHERE orders > 0) AS sold_days, CAST(sum(quantity) AS DOUBLE) AS quantity,
       CAST(sum(orders) AS BIGINT) AS orders, CAST(sum(customers) AS BIGINT) AS customers, min(unit_price) AS lowest_price,
       max(unit_price) AS highest_price, min(description) AS description
FROM panel GROUP BY product_id""", "panel"))
def product_panel_profile(spark, folder):
    """The dense panel of all products, one row per product."""
    return product_panel(spark, folder).groupBy("product_id").agg(
        F.count(F.lit(1)).alias("days"), F.count(F.when(F.col("orders") > 0, 1)).alias("sold_days"),
        F.sum("quantity").cast("double").alias("quantity"), F.sum("orders").cast("long").alias("orders"),
        F.sum("customers").cast("long").alias("customers"), F.min("unit_price").alias("lowest_price"),
        F.max("unit_price").alias("highest_price"), F.min("description").alias("description"),
    )


@query("stock_feature_profile", sql("""
SELECT product_id, count(*) AS n_rows, CAST(sum(demand_lag_1) AS DOUBLE) AS lag_1, CAST(sum(demand_lag_7) AS DOUBLE) AS lag_7,
       CAST(sum(demand_lag_14) AS DOUBLE) AS lag_14, round(max(rolling_mean_7), 6) AS top_mean_7, round(max(rolling_mean_28), 6) AS top_mean_28,
       round(max(rolling_std_7), 6) AS top_std_7, round(max(price_index_28), 6) AS top_price_index,
       CAST(sum(is_weekend) AS BIGINT) AS weekend_rows
FROM stock_features GROUP BY product_id""", "stock_features"))
def stock_feature_profile(spark, folder):
    """Stock features of all products, one row per product; the features' partitioning by product serves the sums too."""
    table = features.stock_features(product_panel(spark, folder))
    return rounded(table.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.sum(f"demand_lag_{n}").cast("double").alias(f"lag_{n}") for n in (1, 7, 14)],
        F.max("rolling_mean_7").alias("top_mean_7"), F.max("rolling_mean_28").alias("top_mean_28"),
        F.max("rolling_std_7").alias("top_std_7"), F.max("price_index_28").alias("top_price_index"),
        F.sum("is_weekend").cast("long").alias("weekend_rows"),
    ), only=("top_mean_7", "top_mean_28", "top_std_7", "top_price_index"))
