"""Guard-railed price recommendation: candidate grid, rescored demand, best profit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import linspace

KEEP_BAND = 0.01


def price_grid(df: DataFrame) -> DataFrame:
    """One row per candidate price between the floor and the largest allowed change.

    Needs current_price, unit_cost, min_margin_rate, max_change_rate, candidate_steps and
    price_index_28. ``unit_price`` and ``price_index_28`` become the candidate's.
    """
    price = F.col("current_price")
    floor = F.col("unit_cost") * (1 + F.col("min_margin_rate"))
    out = df.withColumn("minimum_allowed_price", floor).withColumn(
        "_low", F.greatest(price * (1 - F.col("max_change_rate")), floor)
    )
    out = out.withColumn("maximum_allowed_price", F.greatest(price * (1 + F.col("max_change_rate")), F.col("_low")))
    grid = linspace(F.col("_low"), F.col("maximum_allowed_price"), F.col("candidate_steps"))
    reference = F.greatest(price / F.greatest("price_index_28", F.lit(0.01)), F.lit(0.01))
    out = out.withColumn("_reference", reference)
    out = out.select("*", F.posexplode(grid).alias("candidate_no", "candidate_price"))
    return out.withColumns(
        {
            "unit_price": F.col("candidate_price"),
            "price_index_28": F.col("candidate_price") / F.col("_reference"),
        }
    ).drop("_low", "_reference")


def recommend_price(
    df: DataFrame, keys: list[str], score: Callable[[DataFrame], DataFrame], demand: str = "demand"
) -> DataFrame:
    """Best-profit candidate per key, first one on ties.

    ``score`` adds the ``demand`` column to the candidate rows. Candidates of a row stay in its task
    until the partial aggregation has reduced them to one, so the grid is never shuffled.
    """
    scored = score(price_grid(df)).withColumn(
        "profit", (F.col("candidate_price") - F.col("unit_cost")) * F.col(demand)
    )
    best = F.max_by(
        F.struct("candidate_price", F.col(demand).alias("demand"), "profit"),
        F.struct("profit", -F.col("candidate_no")),
    )
    picked = scored.groupBy(*keys, "current_price", "minimum_allowed_price", "maximum_allowed_price").agg(
        best.alias("b")
    )
    change = (F.col("b.candidate_price") - F.col("current_price")) / F.col("current_price")
    return picked.select(
        *keys, "current_price",
        F.col("b.candidate_price").alias("recommended_price"),
        F.col("b.demand").alias("expected_daily_demand"),
        F.col("b.profit").alias("expected_daily_profit"),
        change.alias("price_change_rate"),
        F.when(F.abs(change) < KEEP_BAND, "keep").when(change > 0, "increase").otherwise("decrease").alias("decision"),
        "minimum_allowed_price", "maximum_allowed_price",
    )
