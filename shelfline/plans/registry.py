"""Query registry."""

from __future__ import annotations

import importlib
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Common table expressions of the check SQL: name -> (names it reads, text).
CTES: dict[str, tuple[tuple[str, ...], str]] = {}

MODULES = ("sales", "panels", "baskets", "recommend", "scores", "loyalty", "stock", "quality", "reports", "learning",
           "streams")


def query(name: str, sql: str | None = None, dates: tuple[str, ...] = ()):
    """Register a query. Date columns leave as ISO text; ``dates`` names them for the SQL side."""

    def register(function):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            df = function(tune(spark), folder)
            days = {n: F.col(n).cast("string") for n, t in df.dtypes if t == "date"}
            return df.withColumns(days) if days else df

        QUERIES[name] = run
        if sql is not None:
            casts = ", ".join(f"CAST({d} AS VARCHAR) AS {d}" for d in dates)
            ORACLES[name] = f"SELECT * REPLACE ({casts}) FROM (\n{sql}\n)" if casts else sql
        return function

    return register


def cte(name: str, text: str, *reads: str) -> None:
    CTES[name] = (reads, text)


def sql(body: str, *names: str) -> str:
    """Check SQL: the body preceded by the table expressions it needs, in dependency order."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name not in ordered:
            for read in CTES[name][0]:
                visit(read)
            ordered.append(name)

    for name in names:
        visit(name)
    head = ",\n".join(f"{n} AS MATERIALIZED ({CTES[n][1]})" for n in ordered)
    return f"WITH {head}\n{body}" if head else body


def derived_ctes(source: str, replacement: str, suffix: str, *names: str) -> None:
    """Copies of table expressions, and of what they read, with ``replacement`` in the place of ``source``.

    A copy is called like its original with the suffix; expressions that do not read ``source`` are shared. A copy's
    text renames only what the original reads, so columns of the same name as some other expression stay.
    """
    def reads_source(name: str) -> bool:
        return name == source or any(reads_source(read) for read in CTES[name][0])

    def copy(name: str) -> str:
        if name == source:
            return replacement
        if not reads_source(name):
            return name
        if name + suffix not in CTES:
            reads, text = CTES[name]
            new = {read: copy(read) for read in reads}
            cte(name + suffix, renamed(text, new), *new.values())
        return name + suffix

    for name in names:
        copy(name)


def renamed(text: str, names: dict[str, str]) -> str:
    """SQL with whole words replaced."""
    return re.sub(r"\b\w+\b", lambda word: names.get(word[0], word[0]), text)


def rounded(df: DataFrame, digits: int = 6, only: tuple[str, ...] = (), **per_column: int) -> DataFrame:
    """Round the double columns (or some of them), so both engines print the same value."""
    def place(name: str) -> Column:
        return F.round(F.col(name), per_column.get(name, digits)).alias(name)

    wanted = {n for n, t in df.dtypes if t == "double" and (not only or n in only)}
    return df.select(*[place(n) if n in wanted else F.col(n) for n in df.columns])


def load_all() -> None:
    for module in MODULES:
        importlib.import_module(f"{__package__}.{module}")
