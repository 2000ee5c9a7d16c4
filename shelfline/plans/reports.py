"""Business reports over the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import popularity, reports
from ..session import cut_lineage
from ..sources import star_schema as star
from . import panels, recommend  # noqa: F401 - recommend registers table expressions read here
from .registry import cte, query, rounded, sql

SINCE = "2001-01-01"
cte("sold", """
SELECT l_orderkey AS order_id, o_orderpriority AS payment, CAST(l_extendedprice AS DECIMAL(28,2)) AS amount, l_returnflag = 'R' AS refunded,
  CAST(o_orderdate AS DATE) AS date, CAST(l_partkey AS VARCHAR) AS product_id, l_quantity AS quantity, CAST(o_custkey AS VARCHAR) AS customer_id, branch_id,
  CAST(p_retailprice * 0.6 * l_quantity AS DECIMAL(28,4)) AS cost
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN branch_of ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey""", "branch_of")


def sold(spark, folder):
    lines = star.sale_lines(spark, folder).join(star.branches(spark, folder), F.col("l_suppkey") == F.col("s_suppkey"))
    part = star.table(spark, folder, "part").select("p_partkey", "p_retailprice")
    return lines.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("order_id"), F.col("o_orderpriority").alias("payment"), F.col("l_extendedprice").alias("amount"),
        (F.col("l_returnflag") == "R").alias("refunded"), F.col("o_orderdate").cast("date").alias("date"),
        F.col("l_partkey").cast("string").alias("product_id"), F.col("l_quantity").alias("quantity"),
        F.col("o_custkey").cast("string").alias("customer_id"), "branch_id",
        (F.col("p_retailprice") * 0.6 * F.col("l_quantity")).alias("cost"),
    )


SUMMARY = """SELECT {p} AS payment, r AS revenue, o AS orders, f AS refunds, r / o AS average_order_value, r - f AS net_revenue FROM (
SELECT {g} CAST(sum(amount) AS DOUBLE) AS r, count(DISTINCT order_id) AS o, CAST(sum(CASE WHEN refunded THEN amount ELSE 0 END) AS DOUBLE) AS f FROM sold {b})"""


@query("sales_summary", sql(SUMMARY.format(p="payment", g="payment,", b="GROUP BY payment") + " UNION ALL " + SUMMARY.format(p="'ALL'", g="", b=""), "sold"))
def sales_summary(spark, folder):
    return reports.sales_summary(sold(spark, folder))


@query("daily_sales", sql("SELECT date, CAST(sum(amount) AS DOUBLE) AS revenue, count(DISTINCT order_id) AS orders FROM sold GROUP BY date", "sold"), dates=("date",))
def daily_sales(spark, folder):
    return reports.daily_sales(sold(spark, folder))


@query("top_selling_products", sql("""
SELECT product_id, CAST(sum(amount) AS DOUBLE) AS revenue, sum(quantity) AS units FROM sold GROUP BY product_id ORDER BY revenue DESC, product_id LIMIT 10""", "sold"))
def top_selling_products(spark, folder):
    return reports.top_selling(sold(spark, folder))


@query("inventory_status", sql("""
SELECT branch_id, CAST(sum(stock) AS BIGINT) AS units, CAST(sum(CAST(stock * (p_retailprice * 0.6) AS DECIMAL(28,4))) AS DOUBLE) AS stock_value,
  CAST(sum(CASE WHEN stock <= 5 THEN 1 ELSE 0 END) AS BIGINT) AS reorder_alerts, CAST(sum(CASE WHEN stock <= 5 THEN 5 - stock ELSE 0 END) AS BIGINT) AS deficit,
  CAST(sum(CASE WHEN stock = 0 THEN 1 ELSE 0 END) AS BIGINT) AS out_of_stock
FROM stock JOIN part ON CAST(p_partkey AS VARCHAR) = product_id GROUP BY branch_id""", "stock"))
def inventory_status(spark, folder):
    return reports.inventory_status(star.inventory(spark, folder), star.catalog(spark, folder))


@query("product_info", """
SELECT p_type AS category, count(*) AS products, CAST(sum(CASE WHEN p_size > 2 THEN 1 ELSE 0 END) AS BIGINT) AS active_products,
  round(avg((p_retailprice - p_retailprice * 0.6) / p_retailprice * 100), 6) AS mean_margin_pct FROM part GROUP BY p_type""")
def product_info(spark, folder):
    return rounded(reports.product_info(star.catalog(spark, folder)))


cte("spend", """
SELECT customer_id, count(DISTINCT order_id) AS orders, CAST(sum(amount) AS DOUBLE) AS spend, min(date) AS first_date FROM sold GROUP BY customer_id""", "sold")


@query("customer_report", sql(f"""
SELECT count(*) AS customers, CAST(sum(CASE WHEN first_date >= DATE '{SINCE}' THEN 1 ELSE 0 END) AS BIGINT) AS new_customers,
  round(avg(CASE WHEN orders > 1 THEN 1.0 ELSE 0.0 END), 9) AS repeat_rate, CAST(sum(CAST(spend AS DECIMAL(28,2))) AS DOUBLE) / count(*) AS average_spend FROM spend""", "spend"))
def customer_report(spark, folder):
    return rounded(reports.customer_report(sold(spark, folder), SINCE)[0], 9, only=("repeat_rate",))


@query("top_customers", sql("SELECT customer_id, orders, spend FROM spend ORDER BY spend DESC, customer_id LIMIT 10", "spend"))
def top_customers(spark, folder):
    return reports.customer_report(sold(spark, folder), SINCE)[1]


@query("branch_report", sql("""
SELECT branch_id, r AS revenue, o AS orders, r / o AS average_order_value, r / CAST(sum(CAST(r AS DECIMAL(28,2))) OVER () AS DOUBLE) AS revenue_share FROM (
SELECT branch_id, CAST(sum(amount) AS DOUBLE) AS r, count(DISTINCT order_id) AS o FROM sold GROUP BY branch_id)""", "sold"))
def branch_report(spark, folder):
    return reports.branch_comparison(sold(spark, folder))


@query("business_overview", sql("""
SELECT r AS revenue, c AS cost, o AS orders, r - c AS gross_profit, (r - c) / r AS gross_margin FROM (
SELECT CAST(sum(amount) AS DOUBLE) AS r, CAST(sum(cost) AS DOUBLE) AS c, count(DISTINCT order_id) AS o FROM sold)""", "sold"))
def business_overview(spark, folder):
    return reports.business_overview(sold(spark, folder))


@query("demand_targets", """
SELECT CAST(l_partkey AS VARCHAR) AS product_id, CAST(o_orderdate AS DATE) AS date,
  sum(greatest(l_quantity - CASE WHEN o_orderstatus = 'P' AND l_returnflag = 'R' THEN l_quantity ELSE 0 END, 0)) AS net_quantity
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus IN ('F', 'P') GROUP BY ALL""", dates=("date",))
def demand_targets(spark, folder):
    lines = star.sale_lines(spark, folder).withColumn(
        "sale_item_id", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    )
    status = F.when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "P", "PARTIALLY_REFUNDED").otherwise("OPEN")
    items = lines.select(
        "sale_item_id", status.alias("status"), F.col("l_partkey").cast("string").alias("product_id"),
        F.col("o_orderdate").cast("date").alias("date"), F.col("l_quantity").alias("quantity"),
    )
    returned = lines.where("l_returnflag = 'R'").select("sale_item_id", F.col("l_quantity").alias("quantity"))
    return reports.demand_targets(items, returned)


@query("volume_tier", sql("""
SELECT branch_id, recent_revenue, CAST(ntile(3) OVER (ORDER BY recent_revenue, branch_id) AS INTEGER) AS tier FROM (
SELECT branch_id, CAST(sum(CAST(daily_revenue AS DECIMAL(28,2))) AS DOUBLE) AS recent_revenue FROM revenue_days
WHERE date > (SELECT max(date) FROM revenue_days) - 90 GROUP BY branch_id)""", "revenue_days"))
def volume_tier(spark, folder):
    return reports.volume_tier(panels.revenue_days(spark, folder))


cte("units_days", """
SELECT CAST(l_partkey AS VARCHAR) AS product_id, sum(l_quantity) AS units, count(DISTINCT CAST(o_orderdate AS DATE)) AS days
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_partkey""")


@query("cold_start_prior", sql("""
SELECT CAST(p_partkey AS VARCHAR) AS product_id, coalesce(f, c, 0) AS prior_daily_demand FROM part
LEFT JOIN (SELECT p_type, p_brand, sum(units) / sum(days) AS f FROM units_days JOIN part ON CAST(p_partkey AS VARCHAR) = product_id GROUP BY ALL) USING (p_type, p_brand)
LEFT JOIN (SELECT p_type, sum(units) / sum(days) AS c FROM units_days JOIN part ON CAST(p_partkey AS VARCHAR) = product_id GROUP BY ALL) USING (p_type)""", "units_days"))
def cold_start_prior(spark, folder):
    daily = star.sale_lines(spark, folder).groupBy(F.col("l_partkey").cast("string").alias("product_id")).agg(
        F.sum("l_quantity").alias("units"), F.count_distinct(F.col("o_orderdate").cast("date")).alias("days")
    )
    return reports.cold_start_prior(daily, star.catalog(spark, folder))


@query("trend_columns", sql("""
SELECT branch_id, date, min(daily_revenue) OVER w7 AS rolling_min_7, CASE WHEN avg(daily_revenue) OVER w28 > 0
  THEN round(avg(daily_revenue) OVER w7 / avg(daily_revenue) OVER w28, 6) END AS trend_ratio_7_28 FROM revenue_dense
WINDOW w7 AS (PARTITION BY branch_id ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), w28 AS (PARTITION BY branch_id ORDER BY date ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING)""",
    "revenue_dense"), dates=("date",))
def trend_columns(spark, folder):
    out = reports.trend_columns(panels.dense_revenue(spark, folder), ["branch_id"], "daily_revenue")
    return rounded(out, 6, only=("trend_ratio_7_28",))


@query("velocity_variant", sql("""
SELECT product_id, CASE WHEN (l - s) * 0.25 > 0 THEN s / ((l - s) * 0.25::DOUBLE) END AS velocity FROM (
SELECT product_id, CAST(sum(CASE WHEN transaction_date > top - 7 THEN quantity ELSE 0 END) AS DOUBLE) AS s, CAST(sum(CASE WHEN transaction_date > top - 28 THEN quantity ELSE 0 END) AS DOUBLE) AS l
FROM bk, (SELECT max(transaction_date) AS top FROM bk) GROUP BY product_id)""", "bk"))
def velocity_variant(spark, folder):
    return reports.velocity_variant(popularity.windowed_sales(cut_lineage(star.baskets(spark, folder), "baskets"), None, 7, 28))
