"""Named queries of this package and their SQL counterparts."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

MODULES = ("sharding", "lm_scoring", "quality_rules", "decontamination", "packing", "language_id", "html_wrappers",
           "toxicity", "substring_dedup", "ngram_join", "conversation_repair",
           "token_alignment", "license_scan")


def query(name: str, sql: str | None = None):
    """Register a query under a name, with its SQL where SQL can say it."""

    def register(function):
        QUERIES[name] = lambda spark, folder: function(tune(spark), folder)
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def load_all() -> None:
    for module in MODULES:
        importlib.import_module(f"{__package__}.{module}")
