"""Readers and writers for the logical tables. Schemas are given, never inferred."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import require_columns, with_defaults
from . import schemas


def _suffix(path: str) -> str:
    return path.rstrip("/").rsplit(".", 1)[-1].lower()


def _csv_text(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, every column a string."""
    return spark.read.csv(path, header=True, inferSchema=False)


def read_transactions(spark: SparkSession, path: str) -> DataFrame:
    """Raw transaction lines from CSV or Parquet, export headers renamed, columns checked."""
    kind = _suffix(path)
    if kind == "csv":
        df = _csv_text(spark, path)
    elif kind in {"parquet", "pq"}:
        df = spark.read.parquet(path)
    else:
        raise ValueError(f"Unsupported transaction file: {path}")
    df = df.withColumnsRenamed(schemas.RETAIL_EXPORT_NAMES)
    names = schemas.TRANSACTIONS.fieldNames()
    return require_columns(df, names, "transaction").select(*names)


def read_sheet_export(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Split a spreadsheet exported as CSV into (accepted rows, rejected rows with a reason).

    Dates may be spreadsheet serial numbers (days since 1899-12-30) or ISO text.
    """
    df = _csv_text(spark, path).withColumnsRenamed(schemas.RETAIL_EXPORT_NAMES)
    df = require_columns(df, schemas.TRANSACTIONS.fieldNames(), "transaction")
    serial = F.expr("try_cast(invoice_date as double)")
    from_serial = F.expr(
        "timestamp'1899-12-30' + make_dt_interval(0, 0, 0, "
        "cast(round(try_cast(invoice_date as double) * 86400) as decimal(18,6)))"
    )
    typed = df.select(
        F.trim("invoice_no").alias("invoice_no"),
        F.trim("product_id").alias("product_id"),
        "description",
        F.expr("try_cast(quantity as double)").alias("quantity"),
        F.when(serial.isNotNull(), from_serial)
        .otherwise(F.expr("try_cast(invoice_date as timestamp)"))
        .alias("invoice_date"),
        F.expr("try_cast(unit_price as double)").alias("unit_price"),
        "customer_id",
        "country",
    )
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    reason = (
        F.when(blank("invoice_no"), "blank_invoice")
        .when(F.upper("invoice_no").startswith("C"), "cancelled")
        .when(blank("product_id"), "blank_product")
        .when(F.col("invoice_date").isNull(), "bad_date")
        .when(F.col("quantity").isNull() | F.col("unit_price").isNull(), "not_a_number")
        .when((F.col("quantity") <= 0) | (F.col("unit_price") <= 0), "not_positive")
    )
    marked = typed.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def ingest_counts(accepted: DataFrame, rejected: DataFrame) -> DataFrame:
    """Rows per outcome: ``written`` or the reject reason."""
    return (
        accepted.select(F.lit("written").alias("outcome"))
        .unionByName(rejected.select(F.col("reason").alias("outcome")))
        .groupBy("outcome")
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )


def read_rec_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """One of catalog, customers, baskets, inventory, with its columns checked."""
    names = schemas.REC_TABLES[table].fieldNames()
    return require_columns(spark.read.parquet(path), names, table).select(*names)


def read_features(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Only the wanted columns leave the Parquet scan."""
    return require_columns(spark.read.parquet(path), columns, "feature").select(*columns)


def read_store_days(spark: SparkSession, days_path: str, stores_path: str) -> DataFrame:
    """Store-day sales joined to store attributes, fields cleaned."""
    days = _csv_text(spark, days_path)
    stores = _csv_text(spark, stores_path)
    require_columns(days, schemas.STORE_DAYS_CSV.fieldNames(), "store-day")
    require_columns(stores, schemas.STORES_CSV.fieldNames(), "store")
    number = lambda c, kind="int": F.expr(f"try_cast({c} as {kind})")
    days = days.select(
        number("Store").alias("store_id"),
        F.expr("try_cast(Date as date)").alias("date"),
        number("DayOfWeek").alias("day_of_week_iso"),
        F.coalesce(number("Open"), F.lit(1)).alias("is_open"),
        F.coalesce(number("Customers"), F.lit(0)).alias("customers"),
        F.coalesce(number("Promo"), F.lit(0)).alias("is_promo"),
        F.coalesce(number("SchoolHoliday"), F.lit(0)).alias("school_holiday"),
        F.regexp_replace(F.coalesce("StateHoliday", F.lit("0")), r"^0\.0$", "0").alias(
            "state_holiday"
        ),
    )
    stores = stores.select(
        number("Store").alias("store_id"),
        F.coalesce("StoreType", F.lit("a")).alias("store_type"),
        F.coalesce("Assortment", F.lit("a")).alias("assortment"),
        F.coalesce(number("Promo2"), F.lit(0)).alias("promo2"),
    )
    return days.join(stores, "store_id", "left")


def check_csv_header(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """One row: missing header columns, rows, ok."""
    df = _csv_text(spark, path)
    missing = sorted(set(columns) - set(df.columns))
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit(",".join(missing)).alias("missing_columns"),
        "n_rows",
        ((F.col("n_rows") > 0) & F.lit(not missing)).alias("ok"),
    )


def write_parquet(df: DataFrame, path: str, keys: list[str] | None = None) -> None:
    """Snappy Parquet; with keys, rows of a key range land together. Range partitioning on the
    keys plus a row hash lets one hot key spread over several files."""
    if keys:
        df = df.repartitionByRange(*keys, F.xxhash64(*df.columns)).sortWithinPartitions(*keys)
    df.write.mode("overwrite").option("compression", "snappy").parquet(path)


def write_feature_table(df: DataFrame, folder: str) -> None:
    """The same table as Parquet and as CSV."""
    write_parquet(df, f"{folder}/parquet")
    df.write.mode("overwrite").option("header", True).csv(f"{folder}/csv")


def table_stats(df: DataFrame) -> DataFrame:
    """Rows, columns, files and bytes of a file-based table."""
    sized = df.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes")
    )
    files = sized.groupBy("path").agg(F.count(F.lit(1)).alias("rows"), F.max("bytes").alias("bytes"))
    return files.agg(
        F.sum("rows").alias("n_rows"),
        F.lit(len(df.columns)).alias("n_columns"),
        F.count(F.lit(1)).alias("n_files"),
        F.sum("bytes").alias("n_bytes"),
    )


def fingerprint(df: DataFrame) -> DataFrame:
    """Order-free 16-hex-digit fingerprint of the whole table, plus its row count."""
    row = F.xxhash64(*df.columns)
    # xor alone cancels equal row pairs; the sum of a second hash keeps them apart
    mixed = F.sum(F.xxhash64(row, F.lit(1)).cast("decimal(38,0)"))
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.lower(
            F.lpad(F.hex(F.xxhash64(F.bit_xor(row), mixed.cast("string"))), 16, "0")
        ).alias("fingerprint"),
    )


def save_model(model: PipelineModel, path: str, metrics: dict, metadata: dict) -> None:
    """Pipeline plus one JSON row with its metrics and metadata."""
    model.write().overwrite().save(f"{path}/model")
    record = {**metadata, "trained_at": datetime.now(timezone.utc).isoformat()}
    spark = SparkSession.getActiveSession()
    row = spark.createDataFrame(
        [(json.dumps(metrics, sort_keys=True), json.dumps(record, sort_keys=True))],
        "metrics string, metadata string",
    )
    row.coalesce(1).write.mode("overwrite").json(f"{path}/record")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, dict, dict]:
    try:
        row = spark.read.schema("metrics string, metadata string").json(f"{path}/record").first()
    except Exception as error:  # noqa: BLE001 - Spark raises AnalysisException for a missing path
        raise FileNotFoundError(f"Model not found: {path}") from error
    return PipelineModel.load(f"{path}/model"), json.loads(row[0]), json.loads(row[1])


def save_index(df: DataFrame, path: str, source: str) -> None:
    """Index table (rules, neighbours, scores) laid out by its lookup key."""
    write_parquet(df, path, [source])


def load_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def append_run(
    spark: SparkSession, path: str, system: str, status: str, seconds: float, details: dict
) -> None:
    """One row per training run in an append-only table."""
    row = [(system, status, float(seconds), json.dumps(details, sort_keys=True),
            datetime.now(timezone.utc).isoformat())]
    spark.createDataFrame(
        row, "system string, status string, seconds double, details string, finished_at string"
    ).coalesce(1).write.mode("append").json(path)


def with_catalog_defaults(df: DataFrame) -> DataFrame:
    """Fill absent optional catalogue columns with typed nulls or neutral values."""
    blank = {f.name: F.lit(None).cast(f.dataType) for f in schemas.CATALOG.fields}
    blank["is_active"] = F.lit(True)
    blank["popularity_weight"] = F.lit(1.0)
    return with_defaults(df, blank)
