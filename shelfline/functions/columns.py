"""Small column expressions shared by the operators. Everything here stays inside codegen."""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require_columns(df: DataFrame, names: Iterable[str], what: str = "input") -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"Missing {what} columns: {', '.join(missing)}")
    return df


def forbid_columns(df: DataFrame, names: Iterable[str], message: str) -> DataFrame:
    present = sorted({c for c in df.columns if c.lower() in {n.lower() for n in names}})
    if present:
        raise ValueError(f"{message}: {', '.join(present)}")
    return df


def with_defaults(df: DataFrame, defaults: Mapping[str, Column]) -> DataFrame:
    """Add each absent column with its default."""
    return df.withColumns({n: c for n, c in defaults.items() if n not in df.columns})


def clip(column: Column, low: float | Column | None = None, high: float | Column | None = None) -> Column:
    """Clamp that keeps nulls (``greatest``/``least`` alone would replace them by the bound)."""
    out = column
    if low is not None:
        out = F.greatest(out, low if isinstance(low, Column) else F.lit(low))
    if high is not None:
        out = F.least(out, high if isinstance(high, Column) else F.lit(high))
    return F.when(column.isNotNull(), out)


def finite(column: Column) -> Column:
    """NaN and infinities become null."""
    bad = F.isnan(column) | (F.abs(column) == F.lit(float("inf")))
    return F.when(~bad, column)


def to_number(df: DataFrame, name: str) -> Column:
    """Double, null where the text is not a number."""
    return F.expr(f"try_cast(`{name}` as double)")


def to_day(df: DataFrame, name: str) -> Column:
    """Date from a date, a timestamp or an ISO string (first ten characters)."""
    kind = dict(df.dtypes)[name]
    if kind == "string":
        return F.expr(f"try_cast(substring(`{name}`, 1, 10) as date)")
    return F.col(name).cast("date")


def flag(condition: Column) -> Column:
    """1 or 0, never null."""
    return F.when(condition, 1).otherwise(0)


def decimal_sum(column: Column, scale: int = 2) -> Column:
    """Order-free money sum: cast to decimal before adding, back to double after."""
    return F.sum(column.cast(f"decimal(28,{scale})")).cast("double")


def safe_ratio(top: Column, bottom: Column, floor: float) -> Column:
    return top / F.greatest(bottom, F.lit(floor))


def normal_quantile(p: Column) -> Column:
    """Inverse standard normal CDF as a column (P. J. Acklam's rational approximation,
    without refinement: relative error below 1.15e-9). Null outside (0, 1)."""
    # fixed values: coefficients of the published approximation
    a = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
         1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
    b = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02,
         6.680131188771972e01, -1.328068155288572e01)
    c = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
         -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
    d = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00,
         3.754408661907416e00)

    def poly(x: Column, coefficients: Sequence[float], tail: float | None = None) -> Column:
        out = F.lit(coefficients[0])
        for value in coefficients[1:]:
            out = out * x + F.lit(value)
        return out if tail is None else out * x + F.lit(tail)

    low = F.sqrt(-2.0 * F.log(p))
    high = F.sqrt(-2.0 * F.log(1.0 - p))
    mid = p - 0.5
    r = mid * mid
    return (
        F.when((p <= 0) | (p >= 1), F.lit(None).cast("double"))
        .when(p < 0.02425, poly(low, c) / poly(low, d, 1.0))
        .when(p > 1 - 0.02425, -poly(high, c) / poly(high, d, 1.0))
        .otherwise(poly(r, a) * mid / poly(r, b, 1.0))
    )


def linspace(low: Column, high: Column, steps: Column) -> Column:
    """Array of evenly spaced values, both ends included."""
    return F.transform(
        F.sequence(F.lit(0), steps - 1),
        lambda i: F.when(i == steps - 1, high).otherwise(low + i * (high - low) / (steps - 1)),
    )


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def array_mean(values: Column) -> Column:
    return array_sum(values) / F.size(values)


def array_std(values: Column) -> Column:
    """Sample standard deviation of an array; 0 for a single value."""
    mean = array_mean(values)
    squares = F.aggregate(values, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean))
    return F.when(F.size(values) > 1, F.sqrt(squares / (F.size(values) - 1))).otherwise(F.lit(0.0))


def last_n(values: Column, n: int) -> Column:
    """The last ``n`` entries of an array (all of it when shorter)."""
    return F.slice(values, F.greatest(F.size(values) - n + 1, F.lit(1)), F.lit(n))


def tile_history(values: Column, minimum: int = 28) -> Column:
    """Repeat a short history until it holds ``minimum`` entries; keep the newest ones."""
    repeats = F.ceil(F.lit(float(minimum)) / F.size(values)).cast("int")
    tiled = F.flatten(F.array_repeat(values, repeats))
    return F.when(F.size(values) >= minimum, values).otherwise(last_n(tiled, minimum))


def lead_with_first(values: Column, minimum: int = 28) -> Column:
    """Extend a short history at the front with its earliest value."""
    gap = F.greatest(F.lit(minimum) - F.size(values), F.lit(0))
    return F.concat(F.array_repeat(F.element_at(values, 1), gap), values)


TAU = 2 * math.pi
