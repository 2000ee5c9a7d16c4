"""Replenishment: direct horizon forecasts, curve calibration, stock plans, period roll-ups."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions.columns import array_mean, array_std, last_n, normal_quantile

HORIZONS = (7, 14, 30)
# fixed values: history length classes (days below, maturity, confidence, advice)
READINESS = (
    (28, "cold_start", "low", "Collect at least 28 daily observations and require review."),
    (90, "limited_history", "low", "Refresh daily and keep purchase approval manual."),
    (365, "developing", "medium", "Continue collecting local seasonal and promotion history."),
)
MATURE = ("annual_history_available", "medium",
          "Retrain and backtest on own sales data before production approval.")


def z_score(service_level: float | Column) -> Column:
    if isinstance(service_level, Column):
        return normal_quantile(service_level)
    return F.lit(NormalDist().inv_cdf(service_level))


def data_readiness(df: DataFrame, days: str = "history_days") -> DataFrame:
    """Maturity, confidence, production flag (always false) and advice by history length."""
    def pick(place: int) -> Column:
        out = F.lit(MATURE[place])
        for bound, *texts in reversed(READINESS):
            out = F.when(F.col(days) < bound, texts[place]).otherwise(out)
        return out

    return df.withColumns(
        {
            "maturity": pick(0), "confidence": pick(1), "production_ready": F.lit(False),
            "recommended_action": pick(2),
        }
    )


def history_series(panel: DataFrame, keys: list[str], value: str = "quantity") -> DataFrame:
    """One row per series with its ordered history; a series has one entry per calendar day."""
    packed = panel.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("date", value))).alias("h"))
    return packed.select(
        *keys, F.col(f"h.{value}").cast("array<double>").alias("history"),
        F.size("h").alias("history_days"), F.element_at("h", -1)["date"].alias("last_date"),
    )


def direct_horizons(series: DataFrame, service_level: float | str = 0.95) -> DataFrame:
    """Series repeated per horizon: point = mean of the last 28 days * H, with a planning band."""
    level = F.col(service_level) if isinstance(service_level, str) else service_level
    recent = last_n(F.col("history"), 28)
    floor_rate = F.when(F.size("history") < 90, 0.30).otherwise(0.20)
    base = series.withColumns({"_mean": array_mean(recent), "_std": array_std(recent)})
    h = F.col("horizon_days")
    rows = base.withColumn("horizon_days", F.explode(F.array(*[F.lit(x) for x in HORIZONS])))
    point = F.col("_mean") * h
    width = F.greatest(z_score(level) * F.col("_std") * F.sqrt(h.cast("double")), point * floor_rate)
    return rows.withColumns(
        {
            "predicted_demand": point,
            "lower_bound": F.greatest(point - width, F.lit(0.0)),
            "upper_bound": point + width,
        }
    ).drop("_mean", "_std")


def calibrate_curve(curve: DataFrame, series: DataFrame, keys: list[str]) -> DataFrame:
    """Scale each stretch of the daily curve to the direct totals.

    ``curve`` has (keys, offset from 0, predicted_demand). Stretches: days 0-6, 7-13, 14-29, then
    blocks of 30. A stretch without any demand is spread flat.
    """
    mean = series.select(*keys, array_mean(last_n(F.col("history"), 28)).alias("_mean"))
    offset = F.col("offset")
    block = (
        F.when(offset < 7, 0).when(offset < 14, 1).when(offset < 30, 2)
        .otherwise(F.floor(offset / 30).cast("int") + 2)
    )
    rows = curve.withColumn("_block", block).join(mean, keys)
    whole = Window.partitionBy(*keys, "_block")
    total, length = F.sum("predicted_demand").over(whole), F.count(F.lit(1)).over(whole)
    t7, t14, t30 = (F.col("_mean") * h for h in HORIZONS)
    target = (
        F.when(F.col("_block") == 0, t7)
        .when(F.col("_block") == 1, F.greatest(t14 - t7, F.lit(0.0)))
        .when(F.col("_block") == 2, F.greatest(t30 - t14, F.lit(0.0)))
        .otherwise(t30 / 30 * length)
    )
    return rows.withColumn(
        "predicted_demand",
        F.when(total <= 0, target / length).otherwise(F.col("predicted_demand") * (target / total)),
    ).drop("_block", "_mean")


def plan_from_day(
    df: DataFrame, service_level: float = 0.95, demand: str = "predicted_daily_demand",
    spread: str = "rolling_std_7",
) -> DataFrame:
    """Stock plan from one scored day. Needs current_stock, lead_time_days, review_period_days."""
    d, lead, review = F.col(demand), F.col("lead_time_days"), F.col("review_period_days")
    sigma = F.greatest(F.col(spread), d * 0.10)
    safety = z_score(service_level) * sigma * F.sqrt(F.greatest(lead, F.lit(1)).cast("double"))
    return _plan(df, d * lead, d * (lead + review), safety)


def _plan(df: DataFrame, lead_demand: Column, cover_demand: Column, safety: Column) -> DataFrame:
    stock = F.col("current_stock")
    out = df.withColumns({"lead_time_demand": lead_demand, "_cover": cover_demand, "safety_stock": safety})
    out = out.withColumns(
        {
            "reorder_point": F.col("lead_time_demand") + F.col("safety_stock"),
            "target_stock": F.col("_cover") + F.col("safety_stock"),
        }
    )
    return out.withColumns(
        {
            "recommended_order_quantity": F.greatest(F.col("target_stock") - stock, F.lit(0.0)),
            "stockout_risk": F.when(stock <= 0, 1.0).otherwise(
                F.least(F.col("reorder_point") / stock, F.lit(1.0))
            ),
            "status": F.when(stock <= F.col("reorder_point"), "reorder_now")
            .when(stock <= F.col("target_stock"), "monitor")
            .otherwise("healthy"),
        }
    ).drop("_cover")


def plan_from_curve(
    curve: DataFrame, series: DataFrame, policy: DataFrame, keys: list[str], service_level: float = 0.95
) -> DataFrame:
    """Stock plan from a calibrated curve: sums over lead time and lead plus review time."""
    offset, q = F.col("offset"), F.col("predicted_demand")
    lead, cover = F.col("lead_time_days"), F.col("lead_time_days") + F.col("review_period_days")
    sums = (
        curve.select(*keys, "offset", "predicted_demand").join(policy, keys)
        .groupBy(*keys, "current_stock", "lead_time_days", "review_period_days")
        .agg(
            F.sum(F.when(offset < lead, q).otherwise(0.0)).alias("_lead"),
            F.sum(F.when(offset < cover, q).otherwise(0.0)).alias("_cover_demand"),
            F.avg(F.when(offset < 7, q)).alias("_mean7"),
        )
    )
    spread = series.select(*keys, array_std(last_n(F.col("history"), 7)).alias("_std7"))
    rows = sums.join(spread, keys)
    sigma = F.greatest(F.col("_std7"), F.col("_mean7") * 0.10)
    safety = z_score(service_level) * sigma * F.sqrt(lead.cast("double"))
    return _plan(rows, F.col("_lead"), F.col("_cover_demand"), safety).drop(
        "_lead", "_cover_demand", "_mean7", "_std7"
    )


def period_rollup(curve: DataFrame, keys: list[str], days: DataFrame | None = None) -> DataFrame:
    """Week, month, quarter and year totals of a daily curve in one pass, bounds cut to the curve."""
    span = Window.partitionBy(*keys)
    rows = curve.select(
        *keys, "predicted_demand", F.min("date").over(span).alias("_first"), F.max("date").over(span).alias("_last"),
        F.explode(cal.period_structs(F.col("date"))).alias("p"),
    )
    return rows.groupBy(*keys, F.col("p.kind").alias("kind"), F.col("p.label").alias("label")).agg(
        F.greatest(F.min("p.period_start"), F.min("_first")).alias("start_date"),
        F.least(F.max("p.period_end"), F.max("_last")).alias("end_date"),
        F.sum("predicted_demand").alias("total_demand"),
        F.avg("predicted_demand").alias("average_daily_demand"),
    )


def forecast_summary(curve: DataFrame, keys: list[str]) -> DataFrame:
    """Total, mean, first 7 and 30 days, and the first day of the highest demand."""
    offset, q = F.col("offset"), F.col("predicted_demand")
    return curve.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("forecast_days"),
        F.sum(q).alias("total_predicted_demand"),
        F.avg(q).alias("average_daily_demand"),
        F.sum(F.when(offset < 7, q).otherwise(0.0)).alias("next_7_days_demand"),
        F.sum(F.when(offset < 30, q).otherwise(0.0)).alias("next_30_days_demand"),
        F.max_by("date", F.struct(q, -offset)).alias("peak_demand_date"),
        F.max(q).alias("peak_daily_demand"),
    )
