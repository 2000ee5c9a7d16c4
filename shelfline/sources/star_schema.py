"""Views of a TPC-H-like star schema as the logical retail tables.

Joins carry no broadcast hints: Spark broadcasts a dimension only while its measured size is below
``spark.sql.autoBroadcastJoinThreshold`` and shuffles (with skew splitting) beyond it. Where a catalogue
that packs well would still be sent whole, the join asks for a merge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ORGANIZATION = "org-main"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def sale_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines with their order head."""
    lines = table(spark, folder, "lineitem")
    orders = table(spark, folder, "orders")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey)


def transactions(spark: SparkSession, folder: str, names: bool = True) -> DataFrame:
    """Transaction lines; ``names`` also joins the product text and the customer's country."""
    df = sale_lines(spark, folder)
    if names:
        part = table(spark, folder, "part").select("p_partkey", "p_name")
        nation = table(spark, folder, "nation").select("n_nationkey", "n_name")
        customer = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
        country = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        df = df.join(part, F.col("l_partkey") == F.col("p_partkey"), "left").join(
            country, F.col("o_custkey") == F.col("c_custkey"), "left"
        )
    returned = F.when(F.col("l_returnflag") == "R", "C").otherwise("")
    return df.select(
        F.concat(returned, F.col("l_orderkey").cast("string")).alias("invoice_no"),
        F.col("l_partkey").cast("string").alias("product_id"),
        (F.col("p_name") if names else F.lit(None).cast("string")).alias("description"),
        F.col("l_quantity").alias("quantity"),
        F.col("o_orderdate").alias("invoice_date"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
        F.col("o_custkey").cast("string").alias("customer_id"),
        (F.col("n_name") if names else F.lit(None).cast("string")).alias("country"),
    )


def branches(spark: SparkSession, folder: str) -> DataFrame:
    """Supplier to branch (nation) and organization (region)."""
    nation = table(spark, folder, "nation")
    region = table(spark, folder, "region")
    supplier = table(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
    return (
        supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            "s_suppkey",
            F.col("n_name").alias("branch_id"),
            F.col("r_name").alias("region_id"),
            F.col("n_nationkey").alias("branch_key"),
        )
    )


def baskets(spark: SparkSession, folder: str) -> DataFrame:
    """Line items of orders as baskets: branch = supplier nation, one organization."""
    df = sale_lines(spark, folder).join(
        branches(spark, folder), F.col("l_suppkey") == F.col("s_suppkey")
    )
    return df.select(
        F.col("l_orderkey").cast("string").alias("transaction_id"),
        F.lit(ORGANIZATION).alias("organization_id"),
        F.col("branch_id").alias("store_id"),
        F.col("o_custkey").cast("string").alias("customer_id"),
        F.col("o_orderdate").cast("date").alias("transaction_date"),
        F.col("l_linenumber").alias("line_item_id"),
        F.col("l_partkey").cast("string").alias("product_id"),
        F.col("l_quantity").cast("int").alias("quantity"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
        F.col("l_extendedprice").alias("line_total"),
        (F.col("l_discount") >= 0.05).alias("is_promo_applied"),
    )


def brand_baskets(spark: SparkSession, folder: str) -> DataFrame:
    """Baskets whose item is the brand: a small item set with high support."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey")
    part = table(spark, folder, "part").select("p_partkey", "p_brand")
    return lines.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").cast("string").alias("transaction_id"),
        F.col("p_brand").alias("product_id"),
    )


def catalog(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part")
    return part.select(
        F.col("p_partkey").cast("string").alias("product_id"),
        F.lit(ORGANIZATION).alias("organization_id"),
        F.concat(F.lit("SKU-"), F.col("p_partkey").cast("string")).alias("sku"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("category_level_1"),
        F.lit(None).cast("string").alias("category_level_2"),
        F.lit(None).cast("string").alias("category_level_3"),
        F.col("p_brand").alias("brand"),
        (F.col("p_retailprice") * 0.6).alias("cost_price"),
        F.col("p_retailprice").alias("base_unit_price"),
        F.col("p_retailprice").alias("current_unit_price"),
        F.to_json(F.struct(F.col("p_size").alias("size"))).alias("specifications_json"),
        F.split("p_name", " ").alias("compatibility_tags"),
        (F.col("p_size") > 2).alias("is_active"),
        F.lit(1.0).alias("popularity_weight"),
        F.lit("retail").alias("domain"),
    )


def inventory(spark: SparkSession, folder: str) -> DataFrame:
    """Stock of every product a branch has ever sold; the level follows from the keys."""
    stock = ((F.col("l_partkey") * 7 + F.col("branch_key") * 13) % 20).cast("int")
    sold = table(spark, folder, "lineitem").select("l_partkey", "l_suppkey").distinct()
    return (
        sold.join(branches(spark, folder), F.col("l_suppkey") == F.col("s_suppkey"))
        .select("branch_id", F.col("l_partkey").cast("string").alias("product_id"), stock.alias("stock_quantity"))
        .distinct()
        .select(
            "branch_id",
            "product_id",
            F.lit(ORGANIZATION).alias("organization_id"),
            "stock_quantity",
            F.lit(5).alias("reorder_level"),
            (F.col("stock_quantity") > 0).alias("is_available"),
        )
    )


def customer_preferences(spark: SparkSession, folder: str, top: int = 2, until=None) -> DataFrame:
    """Each customer's most bought categories and brands, by units, then name; of orders before a day, if one is given."""
    sold = sale_lines(spark, folder)
    if until is not None:
        sold = sold.where(F.col("o_orderdate").cast("date") < F.to_date(F.lit(str(until))))
    lines = sold.join(
        # merged: a large catalogue packs into files that pass for a small table
        table(spark, folder, "part").select("p_partkey", "p_type", "p_brand").hint("merge"),
        F.col("l_partkey") == F.col("p_partkey"),
    )
    # one pass: units per (customer, kind, value)
    units = (
        lines.groupBy("o_custkey", "p_type", "p_brand")
        .agg(F.sum("l_quantity").alias("u"))
        .select(
            F.col("o_custkey").cast("string").alias("customer_id"),
            F.explode(
                F.array(
                    F.struct(F.lit("category").alias("kind"), F.col("p_type").alias("value")),
                    F.struct(F.lit("brand").alias("kind"), F.col("p_brand").alias("value")),
                )
            ).alias("e"),
            "u",
        )
        .groupBy("customer_id", F.col("e.kind").alias("kind"), F.col("e.value").alias("value"))
        .agg(F.sum("u").alias("u"))
    )
    order = Window.partitionBy("customer_id", "kind").orderBy(F.desc("u"), "value")
    best = units.withColumn("r", F.row_number().over(order)).where(F.col("r") <= top)
    pick = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("value"))))
    return best.groupBy("customer_id").agg(
        pick("category").alias("preferred_categories"), pick("brand").alias("affinity_brands")
    )


def demand_records(spark: SparkSession, folder: str) -> DataFrame:
    """Sale lines as demand records: organization = region, branch = nation, product = type."""
    part = table(spark, folder, "part")
    df = (
        sale_lines(spark, folder)
        .join(branches(spark, folder), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
    )
    return df.select(
        F.col("region_id").alias("organization_id"),
        "branch_id",
        F.col("p_type").alias("product_id"),
        F.col("o_orderdate").cast("date").alias("date"),
        F.col("l_quantity").alias("quantity"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
        (F.col("p_retailprice") * 0.6).alias("cost_price"),
        F.col("p_retailprice").alias("selling_price"),
        F.col("p_size").cast("double").alias("reorder_level"),
        F.col("p_type").alias("category_id"),
        F.col("p_brand").alias("brand_id"),
        F.when(F.col("l_discount") >= 0.08, 1).otherwise(0).alias("has_scheduled_discount"),
        F.col("l_discount").alias("discount_rate"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("sequence_no"),
    )


def branch_revenue(spark: SparkSession, folder: str) -> DataFrame:
    """Observed branch-days (only days with sales)."""
    df = sale_lines(spark, folder).join(
        branches(spark, folder), F.col("l_suppkey") == F.col("s_suppkey")
    )
    return df.groupBy(
        F.col("region_id").alias("organization_id"),
        "branch_id",
        F.col("o_orderdate").cast("date").alias("date"),
    ).agg(
        F.sum(F.col("l_extendedprice").cast("decimal(28,2)")).cast("double").alias("daily_revenue"),
        F.sum(F.when(F.col("l_discount") >= 0.09, 1).otherwise(0)).cast("int").alias("active_discount_count"),
    )


def unit_demand(spark: SparkSession, folder: str) -> DataFrame:
    """Units per product type, nation and day, with store-day context columns."""
    df = (
        sale_lines(spark, folder)
        .join(branches(spark, folder), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(
            table(spark, folder, "part").select("p_partkey", "p_type", "p_brand", "p_retailprice"),
            F.col("l_partkey") == F.col("p_partkey"),
        )
        .withColumn("date", F.col("o_orderdate").cast("date"))
    )
    cells = df.groupBy("branch_key", "date", "p_brand").agg(
        F.sum("l_quantity").cast("int").alias("units_sold"),
        F.sum(F.lit(1)).cast("int").alias("lines"),
        F.max(F.when(F.col("l_discount") >= 0.08, 1).otherwise(0)).alias("is_promo"),
        F.min("p_retailprice").alias("unit_price"),
        F.max("p_retailprice").alias("base_unit_price"),
        F.max("p_type").alias("category"),
    )
    store_days = cells.groupBy("branch_key", "date").agg(F.sum("lines").cast("int").alias("customers"))
    weekday = F.weekday("date")
    return cells.join(store_days, ["branch_key", "date"]).select(
        "date",
        F.col("branch_key").alias("store_id"),
        F.col("p_brand").alias("product_id"),
        "category",
        F.when(weekday == 6, 0).otherwise(F.col("units_sold")).cast("int").alias("units_sold"),
        "unit_price",
        "base_unit_price",
        F.when(weekday == 6, 0).otherwise(1).alias("is_open"),
        "customers",
        "is_promo",
        F.when(F.col("branch_key") % 2 == 0, 1).otherwise(0).alias("promo2"),
        weekday.alias("day_of_week"),
        F.when(F.date_format("date", "MM-dd") == "12-25", "a").otherwise("0").alias("state_holiday"),
        F.when(F.month("date").isin(7, 8), 1).otherwise(0).alias("school_holiday"),
        F.element_at(F.array(*[F.lit(x) for x in "abcd"]), (F.col("branch_key") % 4 + 1).cast("int")).alias("store_type"),
        F.element_at(F.array(*[F.lit(x) for x in "abc"]), (F.col("branch_key") % 3 + 1).cast("int")).alias("assortment"),
    )
