"""Request validation as column rules: every request row leaves with its list of reasons."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import with_defaults


def between(name: str, low: float | None = None, high: float | None = None, open_low: bool = False) -> Column:
    """Violation of a numeric range; null violates too."""
    c = F.col(name)
    ok = F.lit(True)
    if low is not None:
        ok = ok & ((c > low) if open_low else (c >= low))
    if high is not None:
        ok = ok & (c <= high)
    return ~F.coalesce(ok, F.lit(False))


def blank(name: str) -> Column:
    return F.trim(F.coalesce(F.col(name), F.lit(""))) == ""


def not_in(name: str, values: list) -> Column:
    return ~F.coalesce(F.col(name).isin(values), F.lit(False))


def increasing(dates: Column) -> Column:
    return F.forall(
        F.sequence(F.lit(1), F.greatest(F.size(dates) - 1, F.lit(1))),
        lambda i: (F.size(dates) < 2) | (F.get(dates, i - 1) < F.get(dates, i)),
    )


FEATURES = ("demand_lag_1", "demand_lag_7", "demand_lag_14", "rolling_mean_7", "rolling_mean_28",
            "rolling_std_7", "orders_lag_1", "customers_lag_1")


def _stock_policy() -> dict[str, Column]:
    level = F.col("service_level")
    return {
        "lead_time_days": between("lead_time_days", 1, 180),
        "review_period_days": between("review_period_days", 1, 365),
        "service_level": ~F.coalesce((level > 0.5) & (level < 0.999), F.lit(False)),
        "unit_price": between("unit_price", 0, open_low=True),
        "price_index_28": between("price_index_28", 0, open_low=True),
        "orders_lag_1": between("orders_lag_1", 0),
        "customers_lag_1": between("customers_lag_1", 0),
    }


def stock_rules() -> dict[str, Column]:
    return {
        "blank_product": blank("product_id"),
        "current_stock": between("current_stock", 0),
        **_stock_policy(),
        **{name: between(name, 0) for name in FEATURES},
    }


def horizon_rules() -> dict[str, Column]:
    history = F.col("recent_daily_demand")
    return {
        "blank_product": blank("product_id"),
        "forecast_days": between("forecast_days", 30, 730),
        "history_length": ~F.coalesce(F.size(history).between(7, 365), F.lit(False)),
        "negative_history": F.coalesce(F.exists(history, lambda x: x < 0), F.lit(False)),
        "current_stock": between("current_stock", 0),
        **_stock_policy(),
        "horizon_too_short": F.col("forecast_days") < F.col("lead_time_days") + F.col("review_period_days"),
    }


def pricing_rules() -> dict[str, Column]:
    return {
        "blank_product": blank("product_id"),
        "current_price": between("current_price", 0, open_low=True),
        "unit_cost": between("unit_cost", 0, open_low=True),
        "min_margin_rate": between("min_margin_rate", 0, 1),
        "max_change_rate": between("max_change_rate", 0, 0.5, open_low=True),
        "candidate_steps": between("candidate_steps", 5, 101),
        "price_not_above_cost": F.col("current_price") <= F.col("unit_cost"),
        **{name: between(name, 0) for name in FEATURES},
        "price_index_28": between("price_index_28", 0, open_low=True),
    }


def loyalty_rules() -> dict[str, Column]:
    return {"blank_customer": blank("customer_id"), "top_k": between("top_k", 1, 50)}


def sales_rules() -> dict[str, Column]:
    return {
        "blank_organization": blank("organization_id"),
        "blank_branch": blank("branch_id"),
        "forecast_horizon": not_in("forecast_horizon", [1, 7, 14, 30]),
        "calendar_not_increasing": ~F.coalesce(increasing(F.col("future_dates")), F.lit(False)),
        "no_revenue_history": ~F.coalesce(F.exists("recent_daily_revenue", lambda x: x > 0), F.lit(False)),
    }


def demand_rules() -> dict[str, Column]:
    return {
        "blank_product": blank("product_id"),
        "blank_store": blank("store_id"),
        "blank_category": blank("category"),
        "base_unit_price": between("base_unit_price", 0, open_low=True),
        "unit_price": F.col("unit_price").isNotNull() & between("unit_price", 0, open_low=True),
        "store_type": not_in("store_type", ["a", "b", "c", "d"]),
        "assortment": not_in("assortment", ["a", "b", "c"]),
        "promo2": between("promo2", 0, 1),
        "horizon": not_in("horizon", [1, 7, 14, 30]),
    }


def recommendation_rules() -> dict[str, Column]:
    context = F.col("context")
    return {
        "blank_organization": blank("organization_id"),
        "unknown_context": not_in("context", ["PRODUCT", "CART_READY", "CUSTOMER", "BRANCH", "TRENDING", "POPULAR", "COLD_START"]),
        "top_n": between("top_n", 1, 20),
        "product_required": (context == "PRODUCT") & blank("product_id"),
        "cart_required": (context == "CART_READY") & (F.coalesce(F.size("product_ids"), F.lit(0)) < 1),
        "branch_required": (context == "BRANCH") & blank("branch_id"),
        "customer_required": (context == "CUSTOMER") & blank("customer_id"),
    }


RULES: dict[str, Callable[[], dict[str, Column]]] = {
    "stock": stock_rules, "horizon": horizon_rules, "pricing": pricing_rules, "loyalty": loyalty_rules,
    "sales": sales_rules, "demand": demand_rules, "recommendation": recommendation_rules,
}
DEFAULTS = {
    "stock": {"lead_time_days": 7, "review_period_days": 14, "service_level": 0.95},
    "horizon": {"forecast_days": 365, "lead_time_days": 7, "review_period_days": 14,
                "service_level": 0.95, "price_index_28": 1.0},
    "pricing": {"min_margin_rate": 0.10, "max_change_rate": 0.15, "candidate_steps": 13},
    "loyalty": {"top_k": 10},
    "demand": {"store_type": "a", "assortment": "a", "promo2": 0, "horizon": 7},
    "recommendation": {"top_n": 5},
}
FORBIDDEN = {"demand": ("customers",)}


def validate(df: DataFrame, kind: str) -> DataFrame:
    """Add ``reasons`` (empty = accepted); absent optional columns get their defaults first."""
    banned = [c for c in FORBIDDEN.get(kind, ()) if c in df.columns]
    if banned:
        raise ValueError(f"Forbidden request columns: {', '.join(banned)}")
    df = with_defaults(df, {n: F.lit(v) for n, v in DEFAULTS.get(kind, {}).items()})
    reasons = F.array(*[F.when(rule, F.lit(name)) for name, rule in RULES[kind]().items()])
    return df.withColumn("reasons", F.filter(reasons, lambda r: r.isNotNull()))


def accepted(validated: DataFrame) -> DataFrame:
    return validated.where(F.size("reasons") == 0).drop("reasons")


def rejected(validated: DataFrame) -> DataFrame:
    return validated.where(F.size("reasons") > 0)
