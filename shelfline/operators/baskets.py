"""Basket operators: distinct items, item and pair frequencies, size statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Aim for this many items per chunk of a large basket.
CHUNK = 64


def basket_items(baskets: DataFrame) -> DataFrame:
    """Distinct (transaction, product)."""
    return (
        baskets.select("transaction_id", "product_id")
        .where(F.col("transaction_id").isNotNull() & F.col("product_id").isNotNull())
        .distinct()
    )


def item_counts(items: DataFrame) -> DataFrame:
    return items.groupBy("product_id").agg(F.count(F.lit(1)).alias("n"))


def basket_count(items: DataFrame) -> DataFrame:
    """One row: number of distinct baskets."""
    return items.agg(F.count_distinct("transaction_id").alias("n_baskets"))


def _pairs_within(items: Column) -> Column:
    ordered = F.sort_array(items)
    return F.flatten(
        F.transform(
            ordered,
            lambda a, i: F.transform(
                F.slice(ordered, i + 2, F.size(ordered)),
                lambda b: F.struct(a.alias("item_a"), b.alias("item_b")),
            ),
        )
    )


def _pairs_between(left: Column, right: Column) -> Column:
    return F.flatten(
        F.transform(
            left,
            lambda a: F.transform(
                right,
                lambda b: F.struct(
                    F.least(a, b).alias("item_a"), F.greatest(a, b).alias("item_b")
                ),
            ),
        )
    )


def pair_counts(baskets: DataFrame, min_count: int = 1) -> DataFrame:
    """Baskets holding both items, for every pair ``item_a < item_b`` seen ``min_count`` times.

    Items in fewer than ``min_count`` baskets cannot be part of such a pair and leave first. A large
    basket is cut into chunks of about ``CHUNK`` items and its chunk pairs become separate groups,
    so no group grows with the basket; pair counts are summed before they are shuffled.
    """
    return count_pairs(cut_lineage(basket_items(baskets), "basket-items"), min_count)


def count_pairs(items: DataFrame, min_count: int = 1) -> DataFrame:
    """:func:`pair_counts` on distinct (transaction, product) rows, which are read several times."""
    if min_count > 1:
        frequent = item_counts(items).where(F.col("n") >= min_count)
        items = items.join(frequent.select("product_id"), "product_id", "left_semi")
    sizes = items.groupBy("transaction_id").agg(F.count(F.lit(1)).alias("size")).where("size >= 2")
    n_chunks = F.ceil(F.col("size") / CHUNK).cast("int")
    own = F.pmod(F.xxhash64("product_id"), F.col("n_chunks")).cast("int")
    cells = (
        items.join(sizes, "transaction_id")
        .withColumn("n_chunks", n_chunks)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)))
        .groupBy(
            "transaction_id",
            F.least("own", "other").alias("low"),
            F.greatest("own", "other").alias("high"),
        )
        .agg(
            F.collect_list(F.when(F.col("own") <= F.col("other"), F.col("product_id"))).alias("left"),
            F.collect_list(F.when(F.col("own") > F.col("other"), F.col("product_id"))).alias("right"),
        )
    )
    pairs = F.when(F.col("low") == F.col("high"), _pairs_within(F.col("left"))).otherwise(
        _pairs_between(F.col("left"), F.col("right"))
    )
    counted = (
        cells.select(F.explode(pairs).alias("p"))
        .groupBy("p.item_a", "p.item_b")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return counted.where(F.col("n") >= min_count) if min_count > 1 else counted


def top_pairs(baskets: DataFrame, n: int = 10, min_count: int = 1) -> DataFrame:
    return pair_counts(baskets, min_count).orderBy(F.desc("n"), "item_a", "item_b").limit(n)


def basket_stats(baskets: DataFrame) -> DataFrame:
    """One row: basket units (mean, median, min, max), baskets, lines, share of walk-in lines."""
    # equal sizes collapse first, so the median reads a table of distinct sizes
    sizes = (
        baskets.groupBy("transaction_id")
        .agg(F.sum("quantity").alias("units"))
        .groupBy("units")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    per_basket = sizes.agg(
        F.sum("n").alias("n_baskets"),
        F.try_divide(F.sum(F.col("units") * F.col("n")), F.sum("n")).alias("mean_units"),
        F.percentile("units", F.lit(0.5), F.col("n")).alias("median_units"),
        F.min("units").alias("min_units"),
        F.max("units").alias("max_units"),
    )
    lines = baskets.agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.avg(F.when(F.col("customer_id").isNull(), 1.0).otherwise(0.0)).alias("walk_in_share"),
    )
    return per_basket.withColumns(
        {
            "n_lines": lines.select("n_lines").scalar(),
            "walk_in_share": lines.select("walk_in_share").scalar(),
        }
    )


def value_counts(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), column).limit(top) if top else counts


def customer_totals(baskets: DataFrame, customers: DataFrame) -> DataFrame:
    """Transactions, spend, mean lines per transaction and last date per known customer."""
    per_tx = (
        baskets.where(F.col("customer_id").isNotNull())
        .groupBy("customer_id", "transaction_id")
        .agg(
            F.sum(F.col("line_total").cast("decimal(28,2)")).alias("spend"),
            F.sum("quantity").alias("items"),
            F.max("transaction_date").alias("day"),
        )
    )
    totals = per_tx.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("total_transactions"),
        F.sum("spend").cast("double").alias("lifetime_spend"),
        (F.sum("items") / F.count(F.lit(1))).alias("avg_basket_size"),
        F.max("day").alias("last_purchase_date"),
    )
    return customers.join(totals, "customer_id", "left").na.fill(
        0, ["total_transactions", "lifetime_spend", "avg_basket_size"]
    )


def entity_counts(**tables: DataFrame) -> DataFrame:
    """One row per named table: its row count."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("entity"), "n_rows")
        for name, df in tables.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
