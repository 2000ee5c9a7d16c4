"""Chronological splits: only the distinct dates are ordered, rows are labelled by filters."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def date_positions(df: DataFrame, column: str = "date") -> DataFrame:
    """Distinct dates with their 1-based position and the total. One row per calendar day."""
    dates = df.select(column).where(F.col(column).isNotNull()).distinct()
    order = Window.partitionBy(F.lit(0)).orderBy(column)
    return dates.select(
        column,
        F.row_number().over(order).alias("position"),
        F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))).alias("n_dates"),
    )


def fraction_cutoffs(
    df: DataFrame, train: float = 0.70, validation: float = 0.15, column: str = "date"
) -> DataFrame:
    """One row: last training date and last validation date by share of distinct dates."""
    n = F.col("n_dates")
    first = F.greatest(F.lit(1), F.floor(n * train).cast("int"))
    second = F.greatest(F.lit(2), F.floor(n * (train + validation)).cast("int"))
    return date_positions(df, column).agg(
        F.max(F.when(F.col("position") == first, F.col(column))).alias("train_end"),
        F.max(F.when(F.col("position") == second, F.col(column))).alias("validation_end"),
        F.max("n_dates").alias("n_dates"),
    )


def count_cutoffs(
    df: DataFrame, train: float = 0.70, validation: float = 0.15, column: str = "date"
) -> DataFrame:
    """Like :func:`fraction_cutoffs`, but both parts are whole counts of dates."""
    n = F.col("n_dates")
    first = F.floor(n * train).cast("int")
    second = first + F.floor(n * validation).cast("int")
    return date_positions(df, column).agg(
        F.max(F.when(F.col("position") == first, F.col(column))).alias("train_end"),
        F.max(F.when(F.col("position") == second, F.col(column))).alias("validation_end"),
        F.max("n_dates").alias("n_dates"),
    )


def tail_cutoffs(
    df: DataFrame, test_days: int = 30, validation_days: int = 30, min_train: int = 30,
    column: str = "date",
) -> DataFrame:
    """Last ``test_days`` dates test, the ones before validate; null cut-offs when too short."""
    n = F.col("n_dates")
    enough = n >= test_days + validation_days + min_train
    at = lambda k: F.max(F.when(enough & (F.col("position") == n - k), F.col(column)))
    return date_positions(df, column).agg(
        at(test_days + validation_days).alias("train_end"),
        at(test_days).alias("validation_end"),
        F.max("n_dates").alias("n_dates"),
    )


def label_split(df: DataFrame, cutoffs: DataFrame, column: str = "date") -> DataFrame:
    """Add ``split`` = train / validation / test. The cut-offs are one row of scalars."""
    day = F.col(column)
    return df.withColumn(
        "split",
        F.when(day <= cutoffs.select("train_end").scalar(), "train")
        .when(day <= cutoffs.select("validation_end").scalar(), "validation")
        .when(day.isNotNull(), "test"),
    )


def label_fixed(
    df: DataFrame, validation_start: date | str, test_start: date | str, column: str = "transaction_date"
) -> DataFrame:
    """Add ``split`` by two given dates (each the first day of its part)."""
    day = F.col(column)
    return df.withColumn(
        "split",
        F.when(day < F.to_date(F.lit(str(validation_start))), "train")
        .when(day < F.to_date(F.lit(str(test_start))), "validation")
        .when(day.isNotNull(), "test"),
    )


def split_summary(labelled: DataFrame, column: str = "date") -> DataFrame:
    """Rows, dates and range per part."""
    return labelled.where(F.col("split").isNotNull()).groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct(column).alias("n_dates"),
        F.min(column).alias("first_date"),
        F.max(column).alias("last_date"),
    )


def expanding_folds(
    df: DataFrame, train_days: tuple[int, ...] = (180, 210, 240, 270), test_days: int = 30,
    column: str = "date",
) -> DataFrame:
    """Rows repeated per fold: training days 1..n, the next ``test_days`` days test."""
    start = df.agg(F.min(column)).scalar()
    day_no = F.datediff(F.col(column), start)
    folds = F.array(
        *[F.struct(F.lit(i + 1).alias("fold"), F.lit(n).alias("n")) for i, n in enumerate(train_days)]
    )
    marked = df.withColumn("_day", day_no).withColumn(
        "_f", F.explode(F.filter(folds, lambda f: F.col("_day") < f["n"] + test_days))
    )
    return marked.select(
        "*",
        F.col("_f.fold").alias("fold"),
        F.when(F.col("_day") < F.col("_f.n"), "train").otherwise("test").alias("split"),
    ).drop("_day", "_f")


def first_stores(df: DataFrame, n: int, column: str = "store_id") -> DataFrame:
    """Rows of the ``n`` smallest store ids (a sampling operator; the id list has ``n`` rows)."""
    chosen = df.select(column).distinct().orderBy(column).limit(n)
    return df.join(chosen, column, "left_semi")


def chronological_split(
    df: DataFrame, validation_start: date | str, test_start: date | str, column: str = "date"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(training, validation, test) rows by two first days; rows without a date are in none of them.

    The parts are filters on the rows, so a part costs no shuffle and files can be skipped by date.
    """
    day = F.col(column).cast("date")
    opens, closes = (F.to_date(F.lit(str(d))) for d in (validation_start, test_start))
    return df.where(day < opens), df.where((day >= opens) & (day < closes)), df.where((day >= opens) & (day >= closes))
