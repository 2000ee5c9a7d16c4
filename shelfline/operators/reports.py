"""Business reports: plain grouped aggregates over sales, stock and customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import decimal_sum


def sales_summary(sales: DataFrame) -> DataFrame:
    """Revenue, orders, average order value, refunds and net, by payment kind and in total.

    ``sales`` has (order_id, payment, amount, refunded). Grouping sets give both levels in one pass.
    """
    amount, refunded = F.col("amount"), F.col("refunded")
    grouped = sales.rollup("payment").agg(
        decimal_sum(amount).alias("revenue"),
        F.count_distinct("order_id").alias("orders"),
        decimal_sum(F.when(refunded, amount).otherwise(0)).alias("refunds"),
        F.grouping("payment").alias("is_total"),
    )
    return grouped.select(
        F.when(F.col("is_total") == 1, "ALL").otherwise(F.col("payment")).alias("payment"),
        "revenue", "orders", "refunds",
        (F.col("revenue") / F.col("orders")).alias("average_order_value"),
        (F.col("revenue") - F.col("refunds")).alias("net_revenue"),
    )


def daily_sales(sales: DataFrame) -> DataFrame:
    return sales.groupBy("date").agg(
        decimal_sum(F.col("amount")).alias("revenue"), F.count_distinct("order_id").alias("orders")
    )


def top_selling(sales: DataFrame, n: int = 10) -> DataFrame:
    totals = sales.groupBy("product_id").agg(
        decimal_sum(F.col("amount")).alias("revenue"), F.sum("quantity").alias("units")
    )
    return totals.orderBy(F.desc("revenue"), "product_id").limit(n)


def inventory_status(inventory: DataFrame, catalog: DataFrame) -> DataFrame:
    """Units, value at cost, items to reorder with their deficit, items out of stock, per branch."""
    stock, level = F.col("stock_quantity"), F.col("reorder_level")
    low = stock <= level
    return inventory.join(catalog.select("product_id", "cost_price"), "product_id").groupBy("branch_id").agg(
        F.sum("stock_quantity").alias("units"),
        decimal_sum(stock * F.col("cost_price"), 4).alias("stock_value"),
        F.sum(F.when(low, 1).otherwise(0)).alias("reorder_alerts"),
        F.sum(F.when(low, level - stock).otherwise(0)).alias("deficit"),
        F.sum(F.when(stock == 0, 1).otherwise(0)).alias("out_of_stock"),
    )


def product_info(catalog: DataFrame) -> DataFrame:
    """Products, active products and mean margin per category."""
    margin = F.try_divide(F.col("current_unit_price") - F.col("cost_price"), "current_unit_price") * 100
    return catalog.groupBy(F.col("category_level_1").alias("category")).agg(
        F.count(F.lit(1)).alias("products"),
        F.sum(F.when(F.col("is_active"), 1).otherwise(0)).alias("active_products"),
        F.avg(margin).alias("mean_margin_pct"),
    )


def customer_report(sales: DataFrame, since, top: int = 10) -> tuple[DataFrame, DataFrame]:
    """(one row of totals, best customers by spend)."""
    per = sales.groupBy("customer_id").agg(
        F.count_distinct("order_id").alias("orders"), decimal_sum(F.col("amount")).alias("spend"),
        F.min("date").alias("first_date"),
    )
    totals = per.agg(
        F.count(F.lit(1)).alias("customers"),
        F.sum(F.when(F.col("first_date") >= F.to_date(F.lit(str(since))), 1).otherwise(0)).alias("new_customers"),
        F.avg(F.when(F.col("orders") > 1, 1.0).otherwise(0.0)).alias("repeat_rate"),
        (decimal_sum(F.col("spend")) / F.count(F.lit(1))).alias("average_spend"),
    )
    best = per.orderBy(F.desc("spend"), "customer_id").limit(top).select("customer_id", "orders", "spend")
    return totals, best


def branch_comparison(sales: DataFrame) -> DataFrame:
    """Revenue, orders, order value and share of revenue per branch."""
    per = sales.groupBy("branch_id").agg(
        decimal_sum(F.col("amount")).alias("revenue"), F.count_distinct("order_id").alias("orders")
    )
    total = per.agg(decimal_sum(F.col("revenue"))).scalar()
    return per.select(
        "branch_id", "revenue", "orders", (F.col("revenue") / F.col("orders")).alias("average_order_value"),
        F.try_divide("revenue", total).alias("revenue_share"),
    )


def business_overview(sales: DataFrame) -> DataFrame:
    """Revenue, cost, gross profit and margin."""
    return sales.agg(
        decimal_sum(F.col("amount")).alias("revenue"),
        decimal_sum(F.col("cost"), 4).alias("cost"),
        F.count_distinct("order_id").alias("orders"),
    ).select(
        "revenue", "cost", "orders", (F.col("revenue") - F.col("cost")).alias("gross_profit"),
        F.try_divide(F.col("revenue") - F.col("cost"), "revenue").alias("gross_margin"),
    )


def demand_targets(sale_items: DataFrame, returns: DataFrame) -> DataFrame:
    """Net units per product and day: completed sales in full, partly refunded ones less returns,
    all other statuses left out."""
    kept = sale_items.where(F.col("status").isin("COMPLETED", "PARTIALLY_REFUNDED"))
    back = returns.groupBy("sale_item_id").agg(F.sum("quantity").alias("returned"))
    partial = F.col("status") == "PARTIALLY_REFUNDED"
    net = F.col("quantity") - F.when(partial, F.coalesce("returned", F.lit(0))).otherwise(0)
    return (
        kept.join(back, "sale_item_id", "left")
        .groupBy("product_id", "date")
        .agg(F.sum(F.greatest(net, F.lit(0))).alias("net_quantity"))
    )


def volume_tier(revenue: DataFrame, days: int = 90, tiers: int = 3) -> DataFrame:
    """Branches in equal-sized tiers by revenue of their last ``days`` days (1 = lowest).

    One row per branch enters the ranking.
    """
    last = revenue.agg(F.max("date")).scalar()
    recent = revenue.where(F.col("date") > F.date_sub(last, days)).groupBy("branch_id").agg(
        decimal_sum(F.col("daily_revenue")).alias("recent_revenue")
    )
    order = Window.partitionBy(F.lit(0)).orderBy("recent_revenue", "branch_id")
    return recent.withColumn("tier", F.ntile(tiers).over(order))


def cold_start_prior(daily: DataFrame, catalog: DataFrame, category: str = "category_level_1", brand: str = "brand") -> DataFrame:
    """Prior daily demand per product: mean of its category and brand, else of its category.

    ``daily`` has (product_id, units, days).
    """
    rows = daily.join(catalog.select("product_id", category, brand), "product_id")
    rate = F.sum("units") / F.sum("days")
    fine = rows.groupBy(category, brand).agg(rate.alias("_fine"))
    coarse = rows.groupBy(category).agg(rate.alias("_coarse"))
    return (
        catalog.select("product_id", category, brand)
        .join(fine, [category, brand], "left")
        .join(coarse, category, "left")
        .select("product_id", F.coalesce("_fine", "_coarse", F.lit(0.0)).alias("prior_daily_demand"))
    )


def trend_columns(panel: DataFrame, keys: list[str], value: str = "quantity") -> DataFrame:
    """Smallest value of the last 7 days and the 7-day over 28-day mean ratio, shifted by a day."""
    order = Window.partitionBy(*keys).orderBy("date")
    mean = lambda w: F.avg(value).over(order.rowsBetween(-w, -1))
    long = mean(28)
    return panel.select(
        *keys, "date",
        F.min(value).over(order.rowsBetween(-7, -1)).alias("rolling_min_7"),
        F.when(long > 0, mean(7) / long).alias("trend_ratio_7_28"),
    )


def velocity_variant(sales: DataFrame) -> DataFrame:
    """Trend score of the design notes: 7-day units over a quarter of the 21 days before them.

    ``sales`` has (product_id, s_short, s_long) with a 28-day long window.
    """
    per = sales.groupBy("product_id").agg(F.sum("s_short").alias("s"), F.sum("s_long").alias("l"))
    before = (F.col("l") - F.col("s")) * 0.25
    return per.select("product_id", F.when(before > 0, F.col("s") / before).alias("velocity"))


