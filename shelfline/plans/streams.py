"""Streaming jobs run to completion over the stored tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics, rules
from ..sources import star_schema as star
from ..streaming import jobs
from . import baskets as basket_plans
from .registry import query, rounded, sql

MONEY = "decimal(28,2)"


def events(spark, folder):
    return jobs.event_time(jobs.file_stream(spark, folder, "events"), "ts")


@query("stream_daily_sales", """
SELECT CAST(ts AS DATE) AS date, event_type, CAST(sum(CAST(value AS DECIMAL(28,2))) AS DOUBLE) AS total, count(*) AS n FROM events GROUP BY ALL""", dates=("date",))
def stream_daily_sales(spark, folder):
    totals = jobs.daily_totals(events(spark, folder), "ts", ["event_type"], F.col("value").cast(MONEY))
    out = jobs.latest(jobs.changed_groups(totals, "daily"), ["date", "event_type"])
    return out.withColumn("total", F.col("total").cast("double"))


@query("stream_velocity", """
SELECT user_id, s_short, s_long, round((s_short / 7 + 0.1) / (s_long / 30 + 0.1), 9) AS velocity FROM (
SELECT user_id, CAST(sum(CASE WHEN CAST(ts AS DATE) > top - 7 THEN CAST(value AS DECIMAL(28,2)) ELSE 0 END) AS DOUBLE) AS s_short,
  CAST(sum(CASE WHEN CAST(ts AS DATE) > top - 30 THEN CAST(value AS DECIMAL(28,2)) ELSE 0 END) AS DOUBLE) AS s_long
FROM events, (SELECT max(CAST(ts AS DATE)) AS top FROM events) GROUP BY user_id)""")
def stream_velocity(spark, folder):
    daily = jobs.daily_totals(events(spark, folder), "ts", ["user_id"], F.col("value").cast(MONEY))
    days = jobs.latest(jobs.changed_groups(daily, "velocity"), ["date", "user_id"])
    sums = jobs.velocity_from_days(days, "user_id")
    exact = sums.select("user_id", F.col("s_short").cast("double"), F.col("s_long").cast("double"))
    velocity = (F.col("s_short") / 7 + 0.1) / (F.col("s_long") / 30 + 0.1)
    return rounded(exact.withColumn("velocity", velocity), 9, only=("velocity",))


@query("stream_product_branch_days", """
SELECT CAST(o_orderdate AS DATE) AS date, CAST(l_partkey AS VARCHAR) AS product_id, n_name AS branch_id,
  CAST(sum(CAST(l_quantity AS DECIMAL(28,2))) AS DOUBLE) AS total, count(*) AS n
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY ALL""", dates=("date",))
def stream_product_branch_days(spark, folder):
    """Daily units per product and branch under a watermark, with the late rows merged back."""
    lines = jobs.file_stream(spark, folder, "lineitem")
    orders = star.table(spark, folder, "orders").select("o_orderkey", "o_orderdate")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(
        star.branches(spark, folder), F.col("l_suppkey") == F.col("s_suppkey")
    ).select(F.col("l_partkey").cast("string").alias("product_id"), "branch_id", "o_orderdate", "l_quantity")
    keys = ["product_id", "branch_id"]
    tables = jobs.event_days(joined, "o_orderdate", keys, F.col("l_quantity").cast(MONEY))
    return jobs.merged_days(*tables, keys).withColumn("total", F.col("total").cast("double"))


@query("stream_late_split", """
SELECT is_late, branch_id, count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(28,2))) AS DOUBLE) AS amount FROM (
SELECT CASE WHEN CAST(l_shipdate AS DATE) - CAST(o_orderdate AS DATE) > 60 THEN 'late' ELSE 'on_time' END AS is_late, n_name AS branch_id, l_extendedprice
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey) GROUP BY ALL""")
def stream_late_split(spark, folder):
    lines = jobs.file_stream(spark, folder, "lineitem")
    orders = star.table(spark, folder, "orders").select("o_orderkey", "o_orderdate")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(
        star.branches(spark, folder), F.col("l_suppkey") == F.col("s_suppkey")
    ).select("branch_id", "l_extendedprice", "o_orderdate", "l_shipdate")
    split = jobs.split_late(joined, "o_orderdate", "l_shipdate", 60)
    return split.groupBy("is_late", "branch_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("l_extendedprice").cast(MONEY)).cast("double").alias("amount")
    )


@query("stream_live_accuracy", """
SELECT CAST(TIMESTAMP '1970-01-01' + INTERVAL 7 DAY * CAST(floor(epoch(o_orderdate) / 604800) AS INTEGER) AS DATE) AS window_start,
  CAST(sum(abs(a - f)) AS DOUBLE) AS absolute_error, CAST(sum(a) AS DOUBLE) AS actual_total, count(*) AS n,
  round(CAST(sum(abs(a - f)) AS DOUBLE) / CAST(sum(a) AS DOUBLE), 9) AS wape, CAST(sum(abs(a - f)) AS DOUBLE) / CAST(sum(a) AS DOUBLE) > 0.5 AS alert,
  round(CAST(sum(abs(a - f)) AS DOUBLE) / count(*) / (SELECT avg(abs(v - before)) FROM (
    SELECT v, lag(v, 7) OVER (PARTITION BY o_orderpriority ORDER BY d) AS before FROM (
      SELECT o_orderpriority, CAST(o_orderdate AS DATE) AS d, CAST(sum(CAST(o_totalprice AS DECIMAL(28,2))) AS DOUBLE) AS v FROM orders GROUP BY ALL))), 6) AS mase FROM (
SELECT o_orderdate, CAST(o_totalprice AS DECIMAL(28,2)) AS a, f FROM orders JOIN (
  SELECT o_orderpriority, CAST(round(avg(o_totalprice), 0) AS DECIMAL(28,2)) AS f FROM orders GROUP BY o_orderpriority) USING (o_orderpriority)) GROUP BY 1""",
       dates=("window_start",))
def stream_live_accuracy(spark, folder):
    forecast = star.table(spark, folder, "orders").groupBy("o_orderpriority").agg(
        F.round(F.avg("o_totalprice"), 0).cast(MONEY).alias("forecast")
    )
    stream = jobs.event_time(jobs.file_stream(spark, folder, "orders"), "o_orderdate")
    actual = stream.withColumn("actual", F.col("o_totalprice").cast(MONEY))
    accuracy = jobs.live_accuracy(actual, forecast, ["o_orderpriority"], "o_orderdate", "actual", "forecast", 0.5)
    out = jobs.latest(jobs.changed_groups(accuracy.drop("wape", "alert"), "accuracy"), ["window_start"])
    out = out.withColumns({c: F.col(c).cast("double") for c in ("absolute_error", "actual_total")})
    ratio = F.col("absolute_error") / F.col("actual_total")
    daily = star.table(spark, folder, "orders").groupBy("o_orderpriority", F.to_date("o_orderdate").alias("d")).agg(
        F.sum(F.col("o_totalprice").cast(MONEY)).cast("double").alias("v"))
    scale = metrics.seasonal_scale(daily, "v", "d", ["o_orderpriority"]).first()["scale"]
    out = out.withColumns({"wape": ratio, "alert": ratio > 0.5, "mase": jobs.mase(scale)})
    return rounded(out, 9, only=("wape", "mase"), mase=6)


@query("stream_customer_totals", """
SELECT CAST(o_custkey AS VARCHAR) AS customer_id, count(*) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(28,2))) AS DOUBLE) AS spend,
  max(CAST(o_orderdate AS DATE)) AS last_day FROM orders GROUP BY o_custkey""", dates=("last_day",))
def stream_customer_totals(spark, folder):
    stream = jobs.event_time(jobs.file_stream(spark, folder, "orders"), "o_orderdate")
    named = stream.withColumns({"customer_id": F.col("o_custkey").cast("string"),
                                "cents": F.round(F.col("o_totalprice").cast(MONEY) * 100).cast("long")})
    out = jobs.customer_totals(named, "customer_id", "o_orderkey", "cents", "o_orderdate")
    return out.withColumn("spend", (F.col("spend") / 100).cast("double"))


@query("stream_cart_scoring", sql("""
SELECT request_id, product_id, score, CAST(rank AS INTEGER) AS rank FROM (
SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, product_id) AS rank FROM (
SELECT i.transaction_id AS request_id, r.consequent[1] AS product_id, max(r.confidence) AS score
FROM brand_items i JOIN brand_rules r ON len(r.antecedent) = 1 AND len(r.consequent) = 1 AND r.antecedent[1] = i.product_id
ANTI JOIN brand_items x ON x.transaction_id = i.transaction_id AND x.product_id = r.consequent[1]
GROUP BY ALL)) WHERE rank <= 5""", "brand_rules", "brand_items"))
def stream_cart_scoring(spark, folder):
    """Order lines arrive as cart events; each batch's carts are scored with single-item rules."""
    found = rules.association_rules(
        basket_plans.brand_itemsets(spark, folder), basket_plans.BRAND_CONFIDENCE, basket_plans.BRAND_LIFT
    )
    single = found.where(F.size("antecedent") == 1)
    part = star.table(spark, folder, "part").select("p_partkey", "p_brand")

    def recommend(batch):
        carts = (
            batch.join(part, F.col("l_partkey") == F.col("p_partkey"))
            .groupBy(F.col("l_orderkey").cast("string").alias("request_id"))
            .agg(F.collect_set("p_brand").alias("product_ids"))
        )
        return rules.recommend_by_rules(carts, single, 5)

    return jobs.score_batches(jobs.file_stream(spark, folder, "lineitem"), recommend)
