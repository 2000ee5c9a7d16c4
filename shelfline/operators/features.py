"""Leakage-safe feature builders.

All lag and rolling features of a builder share one partitioning and one ordering, so the plan has
one exchange and one sort. Row frames equal day frames because the inputs are dense panels; a series
has at most one row per calendar day, which bounds every window partition.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions.columns import clip, finite, forbid_columns, require_columns, with_defaults
from ..sources.schemas import (
    DEMAND_FEATURES,
    DEMAND_FORBIDDEN,
    DEMAND_LAGS,
    DEMAND_WINDOWS,
    STOCK_FEATURES,
)


def trailing(order, aggregate: Column, counted: Column, window: int, minimum: int) -> Column:
    """Aggregate of the ``window`` rows before the current one, null below ``minimum`` values."""
    frame = order.rowsBetween(-window, -1)
    return F.when(F.count(counted).over(frame) >= minimum, aggregate.over(frame))


def trailing_median(order, value: Column, window: int, minimum: int) -> Column:
    """:func:`trailing` median, from the few sorted values of the frame; a percentile would build a map of counts for each row."""
    listed = F.sort_array(F.collect_list(value).over(order.rowsBetween(-window, -1)))

    def middle(values: Column) -> Column:
        n = F.size(values)
        low, high = (F.get(values, F.floor(x).cast("int")) for x in ((n - 1) / 2, n / 2))
        return F.when(n >= minimum, F.when(low == high, low).otherwise(0.5 * low + 0.5 * high))

    # the values are sorted once where the median is named more than once
    return F.get(F.transform(F.array(listed), middle), F.lit(0))


def stock_features(panel: DataFrame, drop_incomplete: bool = True) -> DataFrame:
    order = Window.partitionBy("product_id").orderBy("date")
    q, price = F.col("quantity"), F.col("unit_price")
    median = trailing_median(order, price, 28, 7)
    out = panel.withColumns(
        {
            **{f"demand_lag_{k}": F.lag(q, k).over(order) for k in (1, 7, 14)},
            "rolling_mean_7": trailing(order, F.avg(q), q, 7, 3),
            "rolling_mean_28": trailing(order, F.avg(q), q, 28, 7),
            "rolling_std_7": trailing(order, F.stddev_samp(q), q, 7, 3),
            "price_index_28": price / clip(median, 0.01),
            "orders_lag_1": F.lag("orders").over(order).cast("double"),
            "customers_lag_1": F.lag("customers").over(order).cast("double"),
            "day_of_week": cal.weekday(F.col("date")),
            "month": F.month("date"),
            "is_weekend": cal.is_weekend(F.col("date")),
        }
    )
    doubles = [c for c, t in out.dtypes if t == "double" and c in STOCK_FEATURES]
    out = out.withColumns({c: finite(F.col(c)) for c in doubles})
    return out.na.drop(subset=STOCK_FEATURES) if drop_incomplete else out


def demand_features(
    panel: DataFrame,
    drop_incomplete_lags: bool = True,
    poya: Iterable | None = None,
    public: Iterable = (),
    mercantile: Iterable = (),
) -> DataFrame:
    forbid_columns(panel, DEMAND_FORBIDDEN, "Data leakage detected, forbidden demand columns")
    order = Window.partitionBy("organization_id", "branch_id", "product_id").orderBy("date")
    q, price, day = F.col("quantity"), F.col("unit_price"), F.col("date")
    columns: dict[str, Column] = {f"demand_lag_{k}": F.lag(q, k).over(order) for k in DEMAND_LAGS}
    for w in DEMAND_WINDOWS:
        columns[f"rolling_mean_{w}"] = trailing(order, F.avg(q), q, w, 1)
        columns[f"rolling_std_{w}"] = F.coalesce(
            trailing(order, F.stddev_samp(q), q, w, 2), F.lit(0.0)
        )
        columns[f"rolling_max_{w}"] = trailing(order, F.max(q), q, w, 1)
    median = trailing_median(order, price, 28, 1)
    ratio = price / F.when(median != 0, median)
    selling, cost = F.col("selling_price"), F.col("cost_price")
    columns |= {
        "price_index_28": clip(F.coalesce(ratio, F.lit(1.0)), 0.1, 10.0),
        "margin_rate": clip((selling - cost) / clip(selling, 0.01), -1.0, 1.0),
        "has_scheduled_discount": F.coalesce(F.col("has_scheduled_discount").cast("int"), F.lit(0)),
        "discount_rate": clip(F.coalesce("discount_rate", F.lit(0.0)), 0.0, 1.0),
        "day_of_week": cal.weekday(day),
        "day_of_month": F.dayofmonth(day),
        "month": F.month(day),
        "is_weekend": cal.is_weekend(day),
        "is_month_start": cal.is_month_start(day),
        "is_month_end": cal.is_month_end(day),
        "is_payday_window": cal.is_payday_window(day),
        **cal.holiday_flags(day, poya, public, mercantile),
        "is_in_stock": F.coalesce(F.col("is_in_stock").cast("int"), F.lit(1)),
        "is_branch_open": F.coalesce(F.col("is_branch_open").cast("int"), F.lit(1)),
    }
    out = panel.withColumns(columns)
    if drop_incomplete_lags:
        out = out.na.drop(subset=[f"demand_lag_{k}" for k in DEMAND_LAGS])
    return out


def feature_vector(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Exactly the contract columns, in contract order."""
    columns = columns or DEMAND_FEATURES
    return require_columns(df, columns, "required feature").select(*columns)


def dense_branch_days(revenue: DataFrame) -> DataFrame:
    """Fill the gaps of each branch between its first and last day with closed zero-revenue days."""
    keys = ["organization_id", "branch_id"]
    spine = revenue.groupBy(*keys).agg(F.min("date").alias("a"), F.max("date").alias("b")).select(
        *keys, F.explode(F.sequence("a", "b")).alias("date")
    )
    observed = with_defaults(revenue, {"is_operating_day": F.lit(1)})
    return spine.join(observed, [*keys, "date"], "left").na.fill(
        0, ["daily_revenue", "active_discount_count", "is_operating_day"]
    )


def sales_features(
    revenue: DataFrame, min_history_days: int = 28, rounded: bool = True, age_offset: int = 0
) -> DataFrame:
    """25 revenue features per branch and day; the first ``min_history_days`` rows are warm-up.

    ``rounded`` keeps money at 2, ratios and angles at 4 decimals.
    """
    require_columns(revenue, ["organization_id", "branch_id", "date", "daily_revenue"], "revenue")
    order = Window.partitionBy("organization_id", "branch_id").orderBy("date")
    r, day = F.col("daily_revenue"), F.col("date")
    exact = r.cast("decimal(28,6)")  # money adds up the same in any order

    def mean(low: int, high: int) -> Column:
        frame = order.rowsBetween(low, high)
        return F.sum(exact).over(frame).cast("double") / F.count(r).over(frame)

    std = lambda w: F.coalesce(F.stddev_samp(r).over(order.rowsBetween(-w, -1)), F.lit(0.0))
    r2 = (lambda c: F.round(c, 2)) if rounded else (lambda c: c)
    r4 = (lambda c: F.round(c, 4)) if rounded else (lambda c: c)
    dow_sin, dow_cos = cal.cyclic(cal.weekday(day), 7)
    month_sin, month_cos = cal.cyclic(F.month(day) - 1, 12)
    previous = mean(-14, -8)
    out = revenue.withColumns(
        {
            "_row": F.row_number().over(order),
            "day_of_week": cal.weekday(day),
            "day_of_month": F.dayofmonth(day),
            "month": F.month(day),
            "week_of_year": F.weekofyear(day),
            "is_weekend": cal.is_weekend(day),
            "is_month_start": cal.is_month_start(day),
            "is_month_end": cal.is_month_end(day),
            "day_of_week_sin": r4(dow_sin),
            "day_of_week_cos": r4(dow_cos),
            "month_sin": r4(month_sin),
            "month_cos": r4(month_cos),
            **{f"revenue_lag_{k}": F.lag(r, k).over(order) for k in (1, 7, 14, 28)},
            **{f"rolling_mean_{w}": r2(mean(-w, -1)) for w in (7, 14, 28)},
            **{f"rolling_std_{w}": r2(std(w)) for w in (7, 28)},
            "weekly_momentum_ratio": F.when(previous > 0, r4(mean(-7, -1) / previous)).otherwise(1.0),
            "branch_age_days": F.datediff(
                day, F.min(day).over(order.rowsBetween(Window.unboundedPreceding, 0))
            )
            + age_offset,
            "branch_historical_avg_sales": r2(mean(Window.unboundedPreceding, -1)),
            "is_operating_day": F.col("is_operating_day").cast("int"),
            "active_discount_count": F.col("active_discount_count").cast("int"),
        }
    )
    return out.where(F.col("_row") > min_history_days).drop("_row")
