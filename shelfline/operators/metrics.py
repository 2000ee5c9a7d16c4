"""Forecast accuracy as single-pass aggregates, optionally per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clip


def _grouped(df: DataFrame, keys: Sequence[str]):
    return df.groupBy(*keys) if keys else df.groupBy()


def regression_metrics(
    df: DataFrame, actual: str = "actual", predicted: str = "predicted", keys: Sequence[str] = ()
) -> DataFrame:
    """MAE, RMSE and WAPE (denominator sum of absolute actuals, floored)."""
    a, error = F.col(actual), F.col(predicted) - F.col(actual)
    return _grouped(df, keys).agg(
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        (F.sum(F.abs(error)) / F.greatest(F.sum(F.abs(a)), F.lit(1e-9))).alias("wape"),
        F.count(F.lit(1)).alias("n"),
    )


def seasonal_scale(
    history: DataFrame, value: str, order: str, series: Sequence[str], seasonality: int = 7
) -> DataFrame:
    """Mean absolute seasonal difference within each series, over all series."""
    span = Window.partitionBy(*series).orderBy(order)
    clean = history.where(F.col(value).isNotNull())
    step = F.abs(F.col(value) - F.lag(value, seasonality).over(span))
    return clean.select(step.alias("d")).agg(F.avg("d").alias("scale"))


def forecasting_metrics(
    df: DataFrame, actual: str = "actual", predicted: str = "predicted",
    scale: DataFrame | None = None, digits: bool = True,
) -> DataFrame:
    """MAE, RMSE, WAPE (null unless actuals sum above zero) and MASE; null pairs are left out."""
    a, p = F.col(actual), F.col(predicted)
    error = F.abs(a - p)
    out = df.where(a.isNotNull() & p.isNotNull()).agg(
        F.avg(error).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.when(F.sum(a) > 0, F.sum(error) / F.sum(a)).alias("wape"),
    )
    unit = F.lit(None).cast("double") if scale is None else scale.select("scale").scalar()
    out = out.withColumn("mase", F.when(unit > 0, F.col("mae") / unit))
    if digits:
        places = {"mae": 4, "rmse": 4, "wape": 6, "mase": 6}
        out = out.withColumns({c: F.round(c, d) for c, d in places.items()})
    return out


def lag7_baseline(open_flag: str = "is_open", lag: str = "demand_lag_7") -> Column:
    """Last week's value, never negative, zero on closed days."""
    return F.when(F.col(open_flag) == 0, 0.0).otherwise(clip(F.col(lag), 0.0))


def fva_metrics(
    df: DataFrame, actual: str = "actual", predicted: str = "predicted", baseline: str = "baseline",
    keys: Sequence[str] = (),
) -> DataFrame:
    """Regression metrics next to the baseline's, and forecast value added = 1 - MAE/MAE_base."""
    a = F.abs(F.col(actual))
    error = F.col(predicted) - F.col(actual)
    base = F.abs(F.col(baseline) - F.col(actual))
    total = F.greatest(F.sum(a), F.lit(1e-9))
    out = _grouped(df, keys).agg(
        (F.sum(F.abs(error)) / total).alias("wape"),
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(base).alias("baseline_mae"),
        (F.sum(base) / total).alias("baseline_wape"),
    )
    return out.withColumn(
        "fva",
        F.when(F.col("baseline_mae") > 0, 1 - F.col("mae") / F.col("baseline_mae")).otherwise(0.0),
    )


def horizon_metrics(
    df: DataFrame, horizons: tuple[int, ...] = (7, 14, 30), date: str = "date", **names: str
) -> DataFrame:
    """FVA metrics on the first 7/14/30 dates of the set and on all of it.

    Only the distinct dates are ranked; each row then joins the (at most four) horizons it is in.
    """
    from .splits import date_positions

    position = date_positions(df, date).select(date, "position")
    labels = F.array(
        *[F.struct(F.lit(f"horizon_{h}d").alias("label"), F.lit(h).alias("h")) for h in horizons],
        F.struct(F.lit("overall_test").alias("label"), F.lit(2**31 - 1).alias("h")),
    )
    rows = df.join(position, date).withColumn(
        "horizon", F.explode(F.filter(labels, lambda x: F.col("position") <= x["h"]))
    )
    return fva_metrics(rows.withColumn("horizon", F.col("horizon.label")), keys=["horizon"], **names)


def direct_horizon_backtest(
    panel: DataFrame, start, end, horizons: tuple[int, ...] = (7, 14, 30),
    keys: Sequence[str] = ("product_id",),
) -> DataFrame:
    """At each origin day: sum of the next H days against H times the mean of the 28 days before."""
    order = Window.partitionBy(*keys).orderBy("date")
    start = start if isinstance(start, Column) else F.to_date(F.lit(str(start)))
    end = end if isinstance(end, Column) else F.to_date(F.lit(str(end)))
    # sums of stretches are differences of running sums: a day costs the same whatever the horizons
    sofar = order.rowsBetween(Window.unboundedPreceding, 0)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    running = {"_sum": F.coalesce("quantity", F.lit(0)), "_n": F.col("quantity").isNotNull().cast("long")}
    windowed = panel.select("date", *keys, "quantity").withColumns(
        {
            "row": F.row_number().over(order),
            **{n: F.sum(c).over(sofar) for n, c in running.items()},
            **{f"{n}_all": F.sum(c).over(whole) for n, c in running.items()},
        }
    )

    def until(name: str, days: int) -> Column:
        """The running value ``days`` rows on, or back; a series' own end and start bound it."""
        if days >= 0:
            return F.coalesce(F.lead(name, days).over(order), F.col(f"{name}_all"))
        return F.coalesce(F.lag(name, -days).over(order), F.lit(0))

    def stretch(first: int, last: int) -> tuple[Column, Column]:
        return tuple(until(name, last) - until(name, first - 1) for name in running)

    past, days = stretch(-28, -1)
    columns = {"_mean": F.when(days > 0, past / days)}
    for h in horizons:
        total, known = stretch(0, h - 1)
        columns[f"_s{h}"] = F.when(known > 0, total)
    windowed = windowed.withColumns(columns)
    cases = F.array(
        *[
            F.struct(
                F.lit(h).alias("horizon_days"),
                F.col(f"_s{h}").alias("actual"),
                (F.col("_mean") * h).alias("predicted"),
            )
            for h in horizons
        ]
    )
    origins = windowed.select("date", "row", F.explode(cases).alias("case")).where(
        (F.col("row") > 28)
        & (F.col("date") >= start)
        & (F.col("date") <= F.date_sub(end, F.col("case.horizon_days") - 1))
    )
    rows = origins.select("case.*")
    return rows.groupBy("horizon_days").agg(
        F.avg(F.abs(F.col("predicted") - F.col("actual"))).alias("mae"),
        F.sqrt(F.avg((F.col("predicted") - F.col("actual")) ** 2)).alias("rmse"),
        (
            F.sum(F.abs(F.col("predicted") - F.col("actual")))
            / F.greatest(F.sum(F.abs("actual")), F.lit(1e-9))
        ).alias("wape"),
        F.count(F.lit(1)).alias("origins"),
        F.avg(F.col("predicted") - F.col("actual")).alias("bias"),
        F.sum("actual").alias("actual_total"),
        F.sum("predicted").alias("predicted_total"),
    )


def pinball_loss(
    df: DataFrame, actual: str = "actual", predicted: str = "predicted",
    levels: tuple[float, ...] = (0.5, 0.9),
) -> DataFrame:
    """Mean quantile loss per level."""
    error = F.col(actual) - F.col(predicted)
    levels_col = F.array(*[F.lit(q) for q in levels])
    return (
        df.select(error.alias("e"), F.explode(levels_col).alias("level"))
        .groupBy("level")
        .agg(
            F.avg(F.greatest(F.col("level") * F.col("e"), (F.col("level") - 1) * F.col("e"))).alias(
                "pinball_loss"
            )
        )
    )
