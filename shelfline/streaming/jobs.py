"""Structured Streaming versions of the daily aggregates.

Aggregations run in update mode: every micro-batch writes only the groups it changed to its own
folder, named by batch id, so a replayed batch overwrites itself. :func:`latest` folds the folders
to the newest row per group. Those aggregations have no watermark: files may arrive in any order, and
no row is too late to count. State holds one row per group, as many as the result.

:func:`event_days` bounds its state by an event-time watermark and still loses nothing: rows behind
the watermark go to a side table that is merged back. :func:`customer_totals` keeps one small state a
customer, in which an order is remembered for a time only.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from datetime import date

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pyspark.sql.streaming.state import GroupStateTimeout

from ..session import checkpoint_root


def file_stream(spark: SparkSession, folder: str, table: str, files_per_trigger: int = 1000) -> DataFrame:
    """Stream of one table, a single Parquet file or a directory of part files; the schema comes from
    the files' own footer once, not from each batch."""
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    # a pattern, because a stream does not start from a path that is a plain file
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(f"{folder}/{table}.parque[t]")
    )


def event_time(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.col(column).cast("timestamp"))


def _folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_root(spark)}/streams/{name}-{uuid.uuid4().hex}"


def _result_table(spark: SparkSession, folder: str, schema: T.StructType, *parts: str) -> Callable[[], DataFrame]:
    """Reader of the batch folders, with ``batch_id``; a stream without rows gives an empty table."""
    spark.createDataFrame([], schema).write.partitionBy(*parts).parquet(f"{folder}/table/batch_id=-1")
    whole = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
    return lambda: spark.read.schema(whole).option("basePath", f"{folder}/table").parquet(f"{folder}/table")


def run_available(
    df: DataFrame, write: Callable[[DataFrame, int], None], mode: str, checkpoint: str
) -> None:
    """Process everything that has arrived, then stop."""
    running = (
        df.writeStream.outputMode(mode)
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination()


def changed_groups(df: DataFrame, name: str) -> DataFrame:
    """Run an aggregation in update mode and return all changed rows with their ``batch_id``."""
    spark = df.sparkSession
    folder = _folder(spark, name)
    result = _result_table(spark, folder, df.schema)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/table/batch_id={batch_id}")

    run_available(df, write, "update", f"{folder}/checkpoint")
    return result()


def latest(changes: DataFrame, keys: list[str]) -> DataFrame:
    """Newest row per group."""
    values = [c for c in changes.columns if c not in (*keys, "batch_id")]
    newest = changes.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_id").alias("v"))
    return newest.select(*keys, "v.*")


def daily_totals(
    df: DataFrame, time: str, keys: list[str], value: Column, every: str = "1 day"
) -> DataFrame:
    """Streaming sum and count per key and window (tumbling by default)."""
    return (
        df.groupBy(F.window(time, every).alias("w"), *keys)
        .agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").cast("date").alias("date"), *keys, "total", "n")
    )


def event_days(df: DataFrame, time: str, keys: list[str], value: Column, allowed_days: int = 7, name: str = "event-days",
               ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Daily totals (date, keys, total, n) under an event-time watermark: (closed, open, late) tables.

    The watermark is the latest day of the batches before, less ``allowed_days``. A batch adds its rows to the open
    days, moves the days that fall behind the watermark to the closed table, and writes rows of days closed before it came,
    or without a time, to the late table. What is open is all the state there is: days within the allowance. Each
    batch reads the open days of the batch before and writes folders named by its own id, so a replay gives the same.
    :func:`merged_days` adds the three up.
    """
    spark = df.sparkSession
    folder = _folder(spark, name)
    days = df.select(F.to_date(time).alias("date"), *keys, value.alias("value"))
    schema = _day_sums(days.select("date", *keys, F.col("value").alias("total"), F.lit(1).cast("long").alias("n")), keys).schema
    parts = ("closed", "open", "late")

    def of(part: str, batch_id: int) -> str:
        return f"{folder}/{part}/batch_id={batch_id}"

    empty = spark.createDataFrame([], schema)
    for part in parts:
        empty.write.parquet(of(part, -1))
    mark_schema = "mark date"
    spark.createDataFrame([(None,)], mark_schema).write.parquet(of("marks", -1))

    def write(batch: DataFrame, batch_id: int) -> None:
        own = batch.sparkSession
        before = own.read.schema(mark_schema).parquet(of("marks", batch_id - 1)).first()[0]
        sums = _day_sums(batch.select("date", *keys, F.col("value").alias("total"), F.lit(1).cast("long").alias("n")), keys)
        sums.write.mode("overwrite").parquet(of("arrived", batch_id))  # read three times
        sums = own.read.schema(schema).parquet(of("arrived", batch_id))
        closed_before = F.lit(before) if before is None else F.date_sub(F.lit(before), allowed_days)
        late = F.col("date").isNull() | F.coalesce(F.col("date") < closed_before, F.lit(False))
        newest = sums.agg(F.max("date")).first()[0]
        mark = max((d for d in (before, newest) if d is not None), default=None)
        known = own.read.schema(schema).parquet(of("open", batch_id - 1)).unionByName(sums.where(~late))
        known = _day_sums(known, keys)
        done = F.lit(False) if mark is None else F.col("date") < F.date_sub(F.lit(mark), allowed_days)
        sums.where(late).write.mode("overwrite").parquet(of("late", batch_id))
        known.where(done).write.mode("overwrite").parquet(of("closed", batch_id))
        known.where(~done).write.mode("overwrite").parquet(of("open", batch_id))
        own.createDataFrame([(mark,)], mark_schema).write.mode("overwrite").parquet(of("marks", batch_id))
        last.append(batch_id)

    last = [-1]
    run_available(days, write, "append", f"{folder}/checkpoint")
    whole = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
    closed, late = (spark.read.schema(whole).option("basePath", f"{folder}/{p}").parquet(f"{folder}/{p}").drop("batch_id") for p in ("closed", "late"))
    return closed, spark.read.schema(schema).parquet(of("open", max(last))), late


def _day_sums(days: DataFrame, keys: list[str]) -> DataFrame:
    return days.groupBy("date", *keys).agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def merged_days(closed: DataFrame, still_open: DataFrame, late: DataFrame, keys: list[str]) -> DataFrame:
    """Totals of all rows, late ones included."""
    return _day_sums(closed.unionByName(still_open).unionByName(late), keys)


def velocity_from_days(days: DataFrame, key: str, short_days: int = 7, long_days: int = 30) -> DataFrame:
    """(key, s_short, s_long, velocity) as of the last day in the streamed :func:`daily_totals`.

    A 30-day window sliding by a day would copy each event 30 times into state; daily totals are kept
    once, and both sliding sums are taken over those few rows per key.
    """
    last = days.agg(F.max("date")).scalar()
    within = lambda n: F.sum(F.when(F.col("date") > F.date_sub(last, n), F.col("total")).otherwise(0))
    sums = days.groupBy(key).agg(within(short_days).alias("s_short"), within(long_days).alias("s_long"))
    return sums.withColumn(
        "velocity",
        (F.col("s_short") / short_days + 0.1) / (F.col("s_long") / long_days + 0.1),
    )


def split_late(df: DataFrame, event: str, arrival: str, allowed_days: int, name: str = "late") -> DataFrame:
    """Route rows that arrived more than ``allowed_days`` after their event to a table of their own.

    Both tables are written per batch; the result is their union with ``is_late``.
    """
    spark = df.sparkSession
    folder = _folder(spark, name)
    late = F.datediff(F.col(arrival), F.col(event)) > allowed_days
    marked = df.withColumn("is_late", F.when(late, "late").otherwise("on_time"))
    result = _result_table(spark, folder, marked.schema, "is_late")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").partitionBy("is_late").parquet(f"{folder}/table/batch_id={batch_id}")

    run_available(marked, write, "append", f"{folder}/checkpoint")
    return result().drop("batch_id")


def live_accuracy(
    actuals: DataFrame, forecasts: DataFrame, keys: list[str], time: str, actual: str, forecast: str,
    alert_above: float, every: str = "7 days", scale: float | None = None,
) -> DataFrame:
    """Streaming WAPE per window of actuals joined to a static forecast table, with an alert flag.

    ``scale`` (the mean seasonal difference of the history, one number) adds the MASE.
    """
    joined = actuals.join(forecasts, keys)
    error = F.abs(F.col(actual) - F.col(forecast))
    out = (
        joined.groupBy(F.window(time, every).alias("w"))
        .agg(F.sum(error).alias("absolute_error"), F.sum(actual).alias("actual_total"), F.count(F.lit(1)).alias("n"))
        .select(
            F.col("w.start").cast("date").alias("window_start"), "absolute_error", "actual_total", "n",
            F.try_divide("absolute_error", "actual_total").alias("wape"),
            (F.try_divide("absolute_error", "actual_total") > alert_above).alias("alert"),
        )
    )
    return out if scale is None else out.withColumn("mase", mase(scale))


def mase(scale: float) -> Column:
    """Mean absolute error of a window relative to the scale; null for a scale of zero."""
    return F.try_divide(F.col("absolute_error").cast("double") / F.col("n"), F.lit(float(scale)))


def order_totals(df: DataFrame, key: str, order_id: str, amount: Column, time: str) -> DataFrame:
    """Streaming spend and last day per customer and order; an order's lines may come in any batch."""
    return df.groupBy(key, order_id).agg(F.sum(amount).alias("spend"), F.max(time).cast("date").alias("last_day"))


def running_totals(orders: DataFrame, key: str, order_id: str) -> DataFrame:
    """Orders, spend and last day per customer from the newest rows of :func:`order_totals`."""
    return orders.groupBy(key).agg(
        F.count(order_id).alias("orders"), F.sum("spend").alias("spend"), F.max("last_day").alias("last_day")
    )


#: What a customer's state holds: the totals, and the orders of late with the time (ms) each came first.
CUSTOMER_STATE = "orders long, spend long, last_day date, seen array<string>, seen_at array<long>"


def customer_totals(df: DataFrame, key: str, order_id: str, cents: str, time: str, remember_ms: int = 30 * 86_400_000,
                    timers: bool = False, name: str = "customers") -> DataFrame:
    """Orders, spend and last day per customer, from one small state each: (key, orders, spend in cents, last_day).

    An order's lines may come in any batch within ``remember_ms`` of its first line (by the clock); until then the state
    knows that the order has been counted. What is older leaves when the customer comes again, so a state is three
    numbers and the orders of late, however long the stream runs. ``timers`` also clears customers that stay away; it is
    for streams that never end, since Spark goes on with batches as long as a timer may fire.
    """
    spark = df.sparkSession
    folder = _folder(spark, name)
    kind = dict(df.dtypes)[key]
    rows = df.select(key, F.col(order_id).cast("string").alias("order_id"), F.col(cents).cast("long").alias("cents"),
                     F.to_date(time).alias("day"))

    def update(customer, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = state.getCurrentProcessingTimeMs()
        orders, spend, last_day, seen, seen_at = state.get if state.exists else (0, 0, None, [], [])
        known = {o: t for o, t in zip(seen, seen_at) if t + remember_ms > now}
        arrived = not state.hasTimedOut
        if arrived:
            for pdf in batches:
                spend += int(pdf["cents"].fillna(0).sum())
                days = [d for d in pdf["day"] if isinstance(d, date)]
                last_day = max([*days, *([last_day] if last_day else [])], default=None)
                for order in pdf["order_id"].dropna().unique():
                    if order not in known:
                        orders += 1
                        known[order] = now
        state.update((orders, spend, last_day, list(known), list(known.values())))
        if timers and known:
            state.setTimeoutDuration(max(1, min(known.values()) + remember_ms - now))
        if arrived:
            yield pd.DataFrame({key: [customer[0]], "orders": [orders], "spend": [spend], "last_day": [last_day]})

    changed = rows.groupBy(key).applyInPandasWithState(
        update, f"{key} {kind}, orders long, spend long, last_day date", CUSTOMER_STATE, "update",
        GroupStateTimeout.ProcessingTimeTimeout if timers else GroupStateTimeout.NoTimeout)
    result = _result_table(spark, folder, changed.schema)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/table/batch_id={batch_id}")

    run_available(changed, write, "update", f"{folder}/checkpoint")
    return latest(result(), [key])


def score_batches(
    df: DataFrame, recommend: Callable[[DataFrame], DataFrame], name: str = "scored"
) -> DataFrame:
    """Score each micro-batch of request rows with static index tables; results per batch folder."""
    spark = df.sparkSession
    folder = _folder(spark, name)
    result = _result_table(spark, folder, recommend(spark.createDataFrame([], df.schema)).schema)

    def write(batch: DataFrame, batch_id: int) -> None:
        recommend(batch).write.mode("overwrite").parquet(f"{folder}/table/batch_id={batch_id}")

    run_available(df, write, "append", f"{folder}/checkpoint")
    return result().drop("batch_id")
