"""Dense daily demand panel per organization, branch and product."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clip, flag, require_columns, to_day, to_number, with_defaults
from ..session import cut_lineage

SERIES = ["organization_id", "branch_id", "product_id"]
CELL = [*SERIES, "date"]
LATEST = ["cost_price", "selling_price", "reorder_level"]
EARLIEST = ["category_id", "brand_id"]
PANEL_COLUMNS = [
    *CELL, "quantity", "unit_price", *LATEST, *EARLIEST, "has_scheduled_discount",
    "discount_rate", "is_in_stock", "is_branch_open",
]


def demand_records(df: DataFrame) -> DataFrame:
    """Typed records with defaults for the optional columns."""
    require_columns(df, [*CELL, "quantity"], "demand record")
    zero = F.lit(0.0)
    number = lambda name, otherwise: F.coalesce(to_number(df, name), otherwise) if name in df.columns else otherwise
    price = number("unit_price", zero)
    df = df.withColumns(
        {
            "date": to_day(df, "date"),
            "quantity": clip(F.coalesce(to_number(df, "quantity"), zero), 0.0),
            "unit_price": price,
            "cost_price": number("cost_price", zero),
            "selling_price": number("selling_price", price),
            "reorder_level": number("reorder_level", zero),
            "discount_rate": number("discount_rate", zero),
        }
    )
    blank = F.lit(None).cast("string")
    return with_defaults(
        df,
        {
            "category_id": blank,
            "brand_id": blank,
            "has_scheduled_discount": F.lit(0),
            "sequence_no": F.lit(0),
        },
    )


def _latest(name: str, *order: str) -> Column:
    key = F.struct(*order, name)
    return F.max_by(name, F.when(F.col(name).isNotNull(), key)).alias(name)


def _earliest(name: str, *order: str) -> Column:
    key = F.struct(*order, name)
    return F.min_by(name, F.when(F.col(name).isNotNull(), key)).alias(name)


def daily_demand(records: DataFrame) -> DataFrame:
    """One row per cell with a sale: sums, median price, last and first attributes, maxima."""
    return (
        demand_records(records)
        .where(" and ".join(f"{c} is not null" for c in CELL))
        .groupBy(*CELL)
        .agg(
            F.sum("quantity").alias("quantity"),
            F.percentile("unit_price", F.lit(0.5)).alias("unit_price"),
            *[_latest(c, "sequence_no") for c in LATEST],
            *[_earliest(c, "sequence_no") for c in EARLIEST],
            F.max(F.col("has_scheduled_discount").cast("int")).alias("has_scheduled_discount"),
            F.max("discount_rate").alias("discount_rate"),
        )
    )


def product_attributes(daily: DataFrame) -> DataFrame:
    """Catalogue attributes per organization and product, in (branch, date) order."""
    return daily.groupBy("organization_id", "product_id").agg(
        *[_latest(c, "branch_id", "date") for c in LATEST],
        *[_earliest(c, "branch_id", "date") for c in EARLIEST],
    )


def build_demand_panel(
    records: DataFrame,
    start: date | str | None = None,
    end: date | str | None = None,
    closed_days: DataFrame | None = None,
    out_of_stock_days: DataFrame | None = None,
    attribute_fill: str = "constant",
) -> DataFrame:
    """Every series gets every day of the range; closed days sell nothing.

    ``closed_days`` has (organization_id, branch_id, date), ``out_of_stock_days`` also product_id.
    ``attribute_fill='constant'`` gives a product one set of attributes for all days;
    ``'as_known'`` uses the last value known on the day (else the first known later).
    """
    # read for the range, the series, the attributes and the join
    daily = cut_lineage(daily_demand(records), "daily-demand")
    first = F.to_date(F.lit(str(start))) if start else daily.agg(F.min("date")).scalar()
    last = F.to_date(F.lit(str(end))) if end else daily.agg(F.max("date")).scalar()
    if start and end and str(start) > str(end):
        raise ValueError(f"start_date ({start}) must not be after end_date ({end})")
    spine = daily.select(*SERIES).distinct().select(
        *SERIES, F.explode(F.sequence(first, last)).alias("date")
    )
    panel = spine.join(daily, CELL, "left").na.fill(
        0, ["quantity", "has_scheduled_discount", "discount_rate"]
    )
    if attribute_fill == "constant":
        panel = panel.drop(*LATEST, *EARLIEST).join(
            product_attributes(daily), ["organization_id", "product_id"], "left"
        )
    else:
        order = Window.partitionBy(*SERIES).orderBy("date")
        past = order.rowsBetween(Window.unboundedPreceding, 0)
        whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        panel = panel.withColumns(
            {
                c: F.coalesce(F.last(c, True).over(past), F.first(c, True).over(whole))
                for c in [*LATEST, *EARLIEST]
            }
        )
    panel = panel.withColumn(
        "unit_price", F.coalesce("unit_price", "selling_price", F.lit(0.0))
    )
    panel = _marked(panel, closed_days, ["organization_id", "branch_id", "date"], "is_branch_open")
    panel = _marked(panel, out_of_stock_days, CELL, "is_in_stock")
    return panel.withColumn(
        "quantity", F.when(F.col("is_branch_open") == 0, 0.0).otherwise(F.col("quantity"))
    ).select(*PANEL_COLUMNS)


def _marked(panel: DataFrame, days: DataFrame | None, keys: list[str], name: str) -> DataFrame:
    if days is None:
        return panel.withColumn(name, F.lit(1))
    hit = days.select(*keys).distinct().withColumn("_hit", F.lit(True))
    return panel.join(hit, keys, "left").withColumn(name, flag(F.col("_hit").isNull())).drop("_hit")
