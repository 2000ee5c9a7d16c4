"""Item-to-item cosine similarity from shared baskets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .baskets import basket_items, count_pairs, item_counts


def item_similarity(baskets: DataFrame, min_co_occurrences: int = 2) -> DataFrame:
    """(product_id, neighbour_id, score): baskets with both / sqrt(baskets with each)."""
    items = cut_lineage(basket_items(baskets), "basket-items")
    counts = item_counts(items)
    pairs = count_pairs(items, min_co_occurrences)
    scored = (
        pairs.join(counts.select(F.col("product_id").alias("item_a"), F.col("n").alias("n_a")), "item_a")
        .join(counts.select(F.col("product_id").alias("item_b"), F.col("n").alias("n_b")), "item_b")
        .withColumn("score", F.col("n") / F.sqrt(F.col("n_a") * F.col("n_b")))
    )
    both_ways = F.array(
        F.struct(F.col("item_a").alias("product_id"), F.col("item_b").alias("neighbour_id")),
        F.struct(F.col("item_b").alias("product_id"), F.col("item_a").alias("neighbour_id")),
    )
    return scored.select(F.explode(both_ways).alias("d"), "score").select("d.*", "score")


def top_k(df: DataFrame, keys: list[str], item: str, k, score: str = "score") -> DataFrame:
    """Best ``k`` rows per key by score, then item. Spark cuts each key to ``k`` before the shuffle,
    so a hot key costs no more than a cold one."""
    order = Window.partitionBy(*keys).orderBy(F.desc(score), item)
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def share_of_best(ranked: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """Scores of short ranked lists as shares of the list's best score.

    The window reuses the partitioning :func:`top_k` left behind, so there is no further exchange.
    """
    best = F.max(score).over(Window.partitionBy(*keys))
    return ranked.withColumn(score, F.coalesce(F.try_divide(score, best), F.lit(0.0)))
