"""Transaction cleaning and the daily product panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import decimal_sum, require_columns, to_number
from ..functions.ranking import quantiles
from ..session import cut_lineage
from ..sources.schemas import TRANSACTIONS

OUTLIER_QUANTILE = 0.995
#: Rows of a dense panel that one task makes.
PANEL_TASK_ROWS = 500_000


def typed_transactions(df: DataFrame) -> DataFrame:
    """Trim ids, default texts, coerce numbers and dates (null where they do not parse)."""
    require_columns(df, TRANSACTIONS.fieldNames(), "transaction")
    kinds = dict(df.dtypes)
    when = (
        F.expr("try_cast(invoice_date as timestamp)")
        if kinds["invoice_date"] == "string"
        else F.col("invoice_date")
    )
    return df.select(
        F.trim(F.col("invoice_no").cast("string")).alias("invoice_no"),
        F.trim(F.col("product_id").cast("string")).alias("product_id"),
        F.coalesce(F.col("description").cast("string"), F.lit("Unknown product")).alias("description"),
        to_number(df, "quantity").alias("quantity"),
        when.alias("invoice_date"),
        to_number(df, "unit_price").alias("unit_price"),
        F.col("customer_id").cast("string").alias("customer_id"),
        F.coalesce(F.col("country").cast("string"), F.lit("Unknown")).alias("country"),
    )


def valid_sales(df: DataFrame) -> DataFrame:
    """Dated, priced, positive sales that are not cancellations; a null invoice counts as a sale."""
    cancelled = F.coalesce(F.upper("invoice_no").startswith("C"), F.lit(False))
    return df.where(
        F.col("invoice_date").isNotNull()
        & F.col("product_id").isNotNull()
        & ~cancelled
        & (F.col("quantity") > 0)
        & (F.col("unit_price") > 0)
    )


def outlier_caps(df: DataFrame, quantile: float = OUTLIER_QUANTILE) -> dict[str, float | None]:
    """Exact upper caps of quantity and unit price."""
    return quantiles(df, {"quantity": quantile, "unit_price": quantile})


def clean_transactions(df: DataFrame, caps_from: DataFrame | None = None) -> DataFrame:
    """Valid sales at or below both caps, with revenue and day.

    ``caps_from`` takes the caps from another set of raw rows (say, the training part only).
    """
    valid = valid_sales(typed_transactions(df))
    basis = valid if caps_from is None else valid_sales(typed_transactions(caps_from))
    caps = outlier_caps(basis)
    if caps["quantity"] is not None:
        valid = valid.where(
            (F.col("quantity") <= caps["quantity"]) & (F.col("unit_price") <= caps["unit_price"])
        )
    return valid.withColumns(
        {
            "revenue": F.col("quantity") * F.col("unit_price"),
            "date": F.col("invoice_date").cast("date"),
        }
    )


def daily_product_sales(clean: DataFrame) -> DataFrame:
    """Units, revenue, distinct invoices and customers, latest description per day and product.

    Lines go to their day and product first; each aggregate then ends where it stands. Two distinct counts in one aggregate
    would multiply the lines by three before a shuffle, and the latest description needs a text-valued buffer, which would push
    the others off the hash path: the three are aggregated on their own and joined on the partitioning they share.
    """
    keys = ["date", "product_id"]
    dated = clean.where(F.col("date").isNotNull() & F.col("product_id").isNotNull())
    at_home = lambda *names: dated.select(*keys, *names).repartition(*keys).groupBy(*keys)
    sums = at_home("quantity", "revenue", "invoice_no").agg(
        F.sum("quantity").alias("quantity"),
        decimal_sum(F.col("revenue"), 6).alias("revenue"),
        F.count_distinct("invoice_no").alias("orders"),
    )
    customers = at_home("customer_id").agg(F.count_distinct("customer_id").alias("customers"))
    order = F.struct("invoice_date", "invoice_no", "description")
    texts = at_home("invoice_date", "invoice_no", "description").agg(F.max_by("description", order).alias("description"))
    return sums.join(customers, keys).join(texts, keys).withColumn(
        "unit_price", F.col("revenue") / F.greatest("quantity", F.lit(1.0))
    )


def top_products(clean: DataFrame, n: int = 200) -> DataFrame:
    """The ``n`` products with most units; ties go to the smaller id."""
    return (
        clean.groupBy("product_id")
        .agg(F.sum("quantity").alias("quantity"))
        .orderBy(F.desc("quantity"), "product_id")
        .limit(n)
    )


def daily_product_panel(
    clean: DataFrame, top: int | None = None, fallback_price: float | None = None, last_days: int | Column | None = None
) -> DataFrame:
    """Dense product-by-day panel of all products, or of the ``top`` ones, over the common date range.

    ``last_days`` keeps that many days at the end of the range, with the values they have in the whole panel.
    """
    # the optimizer knows the size of a limited list, and sends it to every task only if it is small
    chosen = clean if top is None else clean.join(top_products(clean, top).select("product_id"), "product_id", "left_semi")
    # at most one row per product and day, read for the range and for the join
    return dense_panel(cut_lineage(daily_product_sales(chosen), "daily-sales"), fallback_price, last_days)


def sales_calendar(daily: DataFrame) -> DataFrame:
    """Every day from the first to the last one of daily sales."""
    span = daily.agg(F.min("date").alias("first"), F.max("date").alias("last"))
    return span.select(F.explode(F.sequence("first", "last")).alias("date"))


def _panel_rows(daily: DataFrame, last_days: int | Column | None) -> int:
    """Rows of a dense panel: products times days."""
    span = F.datediff(F.max("date"), F.min("date")) + 1
    size = daily.agg(F.count_distinct("product_id").alias("products"), span.alias("days"))
    days = F.col("days") if last_days is None else F.least("days", last_days if isinstance(last_days, Column) else F.lit(last_days))
    return size.select(F.col("products") * F.greatest(days, F.lit(0))).first()[0] or 0


def dense_panel(
    daily: DataFrame, fallback_price: float | None = None, last_days: int | Column | None = None
) -> DataFrame:
    """Daily sales of a product with a row for each day, prices and descriptions carried forward, then backward.

    Only rows of sales are shuffled, sorted and filled: each then expands in place to its day and the days without sales
    that follow it (a product's first row also to those before it). A panel of the last days expands to those days alone.
    A panel of no sales has no rows.
    """
    span = daily.agg(F.min("date").alias("first"), F.max("date").alias("last"))
    opens, closes = span.select("first").scalar(), span.select("last").scalar()
    if last_days is not None:
        days = last_days if isinstance(last_days, Column) else F.lit(last_days)
        opens = F.greatest(opens, F.date_sub(closes, days.cast("int") - 1))
    # a row of sales becomes many days: tasks are made for the panel's rows, which the small input does not show
    parts = -(-_panel_rows(daily, last_days) // PANEL_TASK_ROWS)
    order = Window.partitionBy("product_id").orderBy("date")
    before = order.rowsBetween(Window.unboundedPreceding, 0)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    dated = lambda name: F.when(F.col("date").isNotNull(), F.col(name))
    filled = {n: F.coalesce(F.last(dated(n), True).over(before), F.first(dated(n), True).over(whole))
              for n in ("description", "unit_price")}
    if fallback_price is not None:
        filled["unit_price"] = F.coalesce(filled["unit_price"], F.lit(fallback_price))
    runs = daily.repartition(max(parts, 1), "product_id").withColumns({
        **filled, "_opens": opens, "_start": F.when(F.row_number().over(order) == 1, opens).otherwise(F.col("date")),
        "_end": F.greatest("date", F.coalesce(F.date_sub(F.lead("date").over(order), 1), closes))})
    # rows whose days all lie before the panel leave here
    shown = runs.where(F.col("_end") >= F.col("_opens")).withColumn("_sold", F.col("date"))
    spread = shown.withColumn("date", F.explode(F.sequence(F.greatest("_start", "_opens"), "_end")))
    sold = {n: F.when(F.col("date") == F.col("_sold"), F.col(n)).alias(n) for n in daily.columns}
    kept = [F.col(n) if n in filled else sold[n] for n in daily.columns if n not in ("product_id", "date")]
    return spread.select("product_id", "date", *kept).na.fill(0, ["quantity", "revenue", "orders", "customers"])
