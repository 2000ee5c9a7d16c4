"""Trend velocity and smoothed branch popularity.

Both score every product in every branch, sold there or not. Unsold pairs share a closed form, so
only sold pairs are stored; a branch's top list then draws its unsold products from the head of one
global order, just deep enough to skip the products it did sell: its sold products are counted by blocks of
that order, and only the blocks with the first unsold ones are read. Work follows the sold pairs, not
branches times products.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import row_numbers
from ..session import cut_lineage
from .neighbours import share_of_best, top_k

SMOOTHING = 25.0
EVERYWHERE = "*"
#: Positions of a global order that are looked at together.
BLOCK = 1024


def _velocity(short: Column, long: Column, short_days: int, long_days: int) -> Column:
    return (short / short_days + 0.1) / (long / long_days + 0.1)


def windowed_sales(
    baskets: DataFrame, reference: date | str | None = None, short_days: int = 7, long_days: int = 30
) -> DataFrame:
    """(store_id, product_id, s_short, s_long): units in both windows, one pass, no future rows."""
    day = F.col("transaction_date").cast("date")
    ref = F.to_date(F.lit(str(reference))) if reference else baskets.agg(F.max(day)).scalar()
    in_window = lambda n: F.sum(F.when(day > F.date_sub(ref, n), F.col("quantity")).otherwise(0))
    return baskets.where(day <= ref).groupBy("store_id", "product_id").agg(
        in_window(short_days).cast("double").alias("s_short"),
        in_window(long_days).cast("double").alias("s_long"),
    )


def trending_scores(sales: DataFrame, short_days: int = 7, long_days: int = 30) -> DataFrame:
    """(product_id, score): velocity of all branches together, scaled to 0..1."""
    raw = (
        sales.groupBy("product_id")
        .agg(F.sum("s_short").alias("s"), F.sum("s_long").alias("l"))
        .select("product_id", _velocity(F.col("s"), F.col("l"), short_days, long_days).alias("v"))
    )
    low, high = raw.agg(F.min("v")).scalar(), raw.agg(F.max("v")).scalar()
    return raw.select(
        "product_id", ((F.col("v") - low) / F.greatest(F.lit(1e-5), high - low)).alias("score")
    )


def branch_velocity(sales: DataFrame, short_days: int = 7, long_days: int = 30) -> DataFrame:
    """Per branch: velocity range, sold products and the scaled score of an unsold product."""
    n_products = sales.agg(F.count_distinct("product_id")).scalar()
    v = _velocity(F.col("s_short"), F.col("s_long"), short_days, long_days)
    sold = F.col("s_long") > 0
    return (
        sales.groupBy("store_id")
        .agg(
            F.sum(F.when(sold, 1).otherwise(0)).alias("n_sold"),
            F.min(F.when(sold, v)).alias("v_min"),
            F.max(F.when(sold, v)).alias("v_max"),
        )
        .withColumn("n_products", n_products)
        .withColumns(
            {
                # an unsold product has velocity (0 + 0.1) / (0 + 0.1) = 1
                "low": F.when(F.col("n_sold") < F.col("n_products"), F.least("v_min", F.lit(1.0)))
                .otherwise(F.col("v_min")),
                "high": F.when(F.col("n_sold") < F.col("n_products"), F.greatest("v_max", F.lit(1.0)))
                .otherwise(F.col("v_max")),
            }
        )
        .select(
            "store_id", "n_sold", "n_products", "low",
            F.greatest(F.lit(1e-5), F.col("high") - F.col("low")).alias("span"),
        )
        .withColumn("unsold_score", (1.0 - F.col("low")) / F.col("span"))
    )


def branch_trending(sales: DataFrame, short_days: int = 7, long_days: int = 30) -> DataFrame:
    """(store_id, product_id, score) of the products a branch sold in the long window."""
    v = _velocity(F.col("s_short"), F.col("s_long"), short_days, long_days)
    return (
        sales.where(F.col("s_long") > 0)
        .join(branch_velocity(sales, short_days, long_days), "store_id")
        .select("store_id", "product_id", ((v - F.col("low")) / F.col("span")).alias("score"))
    )


def _in_blocks(ordered: DataFrame) -> DataFrame:
    """A global order, written once, with the block of ``BLOCK`` positions that a row lies in."""
    block = F.floor((F.col("position") - 1) / BLOCK)
    return cut_lineage(ordered.withColumn("block", block), "ordered")


def _first_unsold(stats: DataFrame, sold: DataFrame, ordered: DataFrame, k: int) -> DataFrame:
    """Per branch: unsold products of a global order, at least the first ``k`` there are.

    ``ordered`` has (position, block, product_id, ...), ``sold`` the block of each product. At least ``k`` unsold ones lie
    among the first ``k + n_sold`` positions. Sold products are counted by block, and only the blocks that hold the first
    ``k`` unsold ones are opened: no row per branch and position is made.
    """
    depth = F.least("n_products", F.col("n_sold") + k)
    held = sold.groupBy("store_id", "block").agg(F.count(F.lit(1)).alias("n_held"))
    blocks = stats.withColumn("depth", depth).withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("depth") - 1) / BLOCK)))
    )
    before = Window.partitionBy("store_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counted = blocks.join(held, ["store_id", "block"], "left").na.fill(0, ["n_held"])
    opened = (
        counted.withColumn("_before", F.coalesce(F.sum(BLOCK - F.col("n_held")).over(before), F.lit(0)))
        .where((F.col("_before") < k) & (F.col("n_held") < BLOCK))
        .drop("_before", "n_held")
    )
    # at most k blocks a branch; written, so that their number is known before they are joined
    opened = cut_lineage(opened, "opened-blocks")
    taken = sold.join(opened.select("store_id", "block"), ["store_id", "block"], "left_semi")
    slots = opened.join(ordered, "block").where(F.col("position") <= F.col("depth")).drop("block", "depth")
    return slots.join(taken.select("store_id", "product_id"), ["store_id", "product_id"], "left_anti")


def branch_trending_top(
    sales: DataFrame, k: int = 10, short_days: int = 7, long_days: int = 30
) -> DataFrame:
    """(store_id, product_id, score, rank): exact top ``k`` per branch over all products."""
    stats = branch_velocity(sales, short_days, long_days)
    ordered = _in_blocks(row_numbers(sales.select("product_id").distinct(), [], "product_id"))
    sold = cut_lineage(
        branch_trending(sales, short_days, long_days).join(
            ordered.select("product_id", "block").hint("merge"), "product_id", "left"
        ),
        "sold",
    )
    unsold = _first_unsold(stats, sold, ordered, k).select(
        "store_id", "product_id", F.col("unsold_score").alias("score")
    )
    sold = sold.select("store_id", "product_id", "score")
    return top_k(sold.unionByName(unsold), ["store_id"], "product_id", k)


def trending_top(sales: DataFrame, k: int = 10) -> DataFrame:
    """(product_id, score, rank) over all branches."""
    best = trending_scores(sales).orderBy(F.desc("score"), "product_id").limit(k)
    return top_k(best.withColumn("store_id", F.lit(EVERYWHERE)), ["store_id"], "product_id", k)


def item_units(baskets: DataFrame) -> DataFrame:
    """(store_id, product_id, n): units, or lines where the table has no quantity."""
    amount = F.sum("quantity") if "quantity" in baskets.columns else F.count(F.lit(1))
    return baskets.groupBy("store_id", "product_id").agg(amount.cast("double").alias("n"))


def org_popularity(units: DataFrame) -> DataFrame:
    """(product_id, n, share, score): share of all units; score relative to the best product."""
    counts = units.groupBy("product_id").agg(F.sum("n").alias("n"))
    total, best = counts.agg(F.sum("n")).scalar(), counts.agg(F.max("n")).scalar()
    return counts.select(
        "product_id", "n", F.try_divide("n", total).alias("share"),
        F.try_divide(F.try_divide("n", total), F.try_divide(best, total)).alias("score"),
    )


def branch_popularity_top(units: DataFrame, k: int = 10, smoothing: float = SMOOTHING) -> DataFrame:
    """(store_id, product_id, score, rank): shrunk popularity, best product of the branch = 1."""
    org = org_popularity(units).select("product_id", F.col("n").alias("n_org"), "share")
    stats = (
        units.groupBy("store_id")
        .agg(F.sum("n").alias("n_branch"), F.count(F.lit(1)).alias("n_sold"))
        .withColumn("n_products", org.agg(F.count(F.lit(1))).scalar())
    )
    smooth = lambda n: (n + smoothing * F.col("share")) / (F.col("n_branch") + smoothing)
    # most units first, then id, as one sortable text key
    key = F.concat(
        F.lpad((F.lit(10**18) - F.col("n_org").cast("long")).cast("string"), 19, "0"), "product_id"
    )
    ordered = _in_blocks(row_numbers(org.withColumn("sort_key", key), [], "sort_key").drop("sort_key"))
    sold = cut_lineage(
        # a long order packs so well that its file would pass for a small table: it is not sent to every task
        units.join(ordered.hint("merge"), "product_id")
        .join(stats, "store_id")
        .select("store_id", "product_id", smooth(F.col("n")).alias("score"), "block"),
        "sold",
    )
    unsold = _first_unsold(stats, sold, ordered, k).select(
        "store_id", "product_id", smooth(F.lit(0.0)).alias("score")
    )
    sold = sold.select("store_id", "product_id", "score")
    # the branch maximum is the first row of its list
    return share_of_best(top_k(sold.unionByName(unsold), ["store_id"], "product_id", k), ["store_id"])


def org_popularity_top(units: DataFrame, k: int = 10) -> DataFrame:
    best = org_popularity(units).orderBy(F.desc("n"), "product_id").limit(k)
    return top_k(
        best.select(F.lit(EVERYWHERE).alias("store_id"), "product_id", "score"),
        ["store_id"], "product_id", k,
    )
