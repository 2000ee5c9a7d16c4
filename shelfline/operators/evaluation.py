"""Offline ranking metrics of any recommender given as a (request_id, product_id, rank) table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .popularity import EVERYWHERE

CUTS = (5, 10)


def evaluation_requests(baskets: DataFrame, sample: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(requests, truth) from multi-item baskets: the smallest product is the seed, the rest truth.

    ``sample`` keeps that many baskets in hash order (the sampling option of the evaluator).
    """
    items = baskets.groupBy("transaction_id", "store_id", "customer_id", "product_id").agg(
        F.count(F.lit(1)).alias("lines")
    )
    request = F.concat_ws("|", "transaction_id", "store_id", F.coalesce("customer_id", F.lit("")))
    items = items.withColumn("request_id", request)
    seeds = (
        items.groupBy("request_id")
        .agg(
            F.min("product_id").alias("product_id"),
            F.count(F.lit(1)).alias("n_items"),
            F.first("store_id").alias("branch_id"),
            F.first("customer_id").alias("customer_id"),
        )
        .where("n_items >= 2")
    )
    if sample:
        seeds = seeds.orderBy(F.xxhash64("request_id"), "request_id").limit(sample)
    truth = items.join(
        seeds.select("request_id", F.col("product_id").alias("seed")), "request_id"
    ).where(F.col("product_id") != F.col("seed"))
    return seeds.drop("n_items"), truth.select("request_id", "product_id")


def ranking_metrics(
    recommendations: DataFrame, truth: DataFrame, catalog: DataFrame, cuts: tuple[int, ...] = CUTS
) -> DataFrame:
    """One row: precision, recall, hit rate, NDCG and MAP at each cut, coverage and diversity."""
    needed = truth.groupBy("request_id").agg(F.count(F.lit(1)).alias("n_truth"))
    hits = recommendations.join(
        truth.withColumn("hit", F.lit(1)), ["request_id", "product_id"], "left"
    ).withColumn("hit", F.coalesce("hit", F.lit(0)))
    categories = catalog.select("product_id", F.col("category_level_1").alias("category"))
    # lists are short (the largest cut), so a per-request array is bounded
    per_request = (
        hits.where(F.col("rank") <= max(cuts))
        .join(categories, "product_id", "left")
        .groupBy("request_id")
        .agg(
            *[F.sum(F.when(F.col("rank") <= k, F.col("hit")).otherwise(0)).alias(f"hits_{k}") for k in cuts],
            F.sort_array(F.collect_list(F.struct("rank", "hit"))).alias("ranked"),
            F.count_distinct(
                F.when(F.col("rank") <= 5, F.coalesce("category", F.lit("unknown")))
            ).alias("n_categories"),
            F.sum(F.when(F.col("rank") <= 5, 1).otherwise(0)).alias("n_top5"),
        )
    )
    dcg = lambda k: F.aggregate(
        "ranked", F.lit(0.0),
        lambda s, x: s + F.when(x["rank"] <= k, x["hit"] / F.log2(x["rank"] + 1.0)).otherwise(0.0),
    )
    ideal = lambda k: F.aggregate(
        F.sequence(F.lit(1), F.least("n_truth", F.lit(k)).cast("int")), F.lit(0.0),
        lambda s, i: s + 1.0 / F.log2(i + 1.0),
    )
    average_precision = lambda k: F.aggregate(
        "ranked", F.struct(F.lit(0.0).alias("seen"), F.lit(0.0).alias("total")),
        lambda s, x: F.struct(
            (s["seen"] + F.when(x["rank"] <= k, x["hit"]).otherwise(0)).cast("double").alias("seen"),
            (s["total"] + F.when((x["rank"] <= k) & (x["hit"] == 1), (s["seen"] + 1) / x["rank"]).otherwise(0.0)).alias("total"),
        ),
        lambda s: s["total"] / F.least(F.col("n_truth"), F.lit(k)),
    )
    rows = needed.join(per_request, "request_id", "left").na.fill(0)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    metrics = []
    for k in cuts:
        found = F.col(f"hits_{k}")
        metrics += [
            F.avg(found / F.lit(float(k))).alias(f"precision_at_{k}"),
            F.avg(found / F.col("n_truth")).alias(f"recall_at_{k}"),
            F.avg(F.when(found > 0, 1.0).otherwise(0.0)).alias(f"hit_rate_at_{k}"),
            F.avg(zero(dcg(k)) / ideal(k)).alias(f"ndcg_at_{k}"),
            F.avg(zero(average_precision(k))).alias(f"map_at_{k}"),
        ]
    n_active = catalog.where("is_active").agg(F.count_distinct("product_id")).scalar()
    used = recommendations.where(F.col("rank") <= max(cuts)).join(
        needed.select("request_id"), "request_id", "left_semi"
    )
    covered = used.agg(F.count_distinct("product_id")).scalar()
    return rows.agg(
        *metrics,
        F.avg(F.col("n_categories") / F.greatest("n_top5", F.lit(1))).alias("diversity_score"),
        F.count(F.lit(1)).alias("n_requests"),
    ).withColumn("catalog_coverage", covered / F.greatest(n_active, F.lit(1)))


def list_recommender(requests: DataFrame, lists: DataFrame, k: int = 10, everywhere: bool = True) -> DataFrame:
    """Baseline: the same top list for all requests, or the one of the request's branch, without the
    seed item. ``lists`` has (store_id or '*', product_id, rank) and at least ``k + 1`` rows each.

    A list is short, so it travels as one array per branch; requests are not multiplied by a join.
    """
    short = lists.where(F.col("rank") <= k + 1)
    packed = F.transform(
        F.sort_array(F.collect_list(F.struct("rank", "product_id"))), lambda x: x["product_id"]
    ).alias("list")
    asked = requests.select("request_id", F.col("product_id").alias("seed"), "branch_id")
    if everywhere:
        asked = asked.withColumn("list", short.where(F.col("store_id") == EVERYWHERE).agg(packed).scalar())
    else:
        per_branch = short.groupBy(F.col("store_id").alias("branch_id")).agg(packed)
        asked = asked.join(per_branch, "branch_id")
    others = F.slice(F.filter("list", lambda p: p != F.col("seed")), 1, k)
    picked = asked.select("request_id", F.posexplode(others).alias("place", "product_id"))
    return picked.select("request_id", "product_id", (F.col("place") + 1).alias("rank"))


def stock_availability(recommendations: DataFrame) -> DataFrame:
    """Share of recommended rows that are in stock."""
    ok = F.col("is_available") & (F.col("stock_quantity") > 0)
    return recommendations.agg(F.avg(F.when(ok, 1.0).otherwise(0.0)).alias("stock_availability_rate"))
