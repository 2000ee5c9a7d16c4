"""Logical table schemas and fixed column contracts."""

from __future__ import annotations

from pyspark.sql import types as T

S, D, I, L, B = T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType(), T.BooleanType()
DAY, TS = T.DateType(), T.TimestampType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


TRANSACTIONS = struct(
    invoice_no=S, product_id=S, description=S, quantity=D, invoice_date=TS, unit_price=D,
    customer_id=S, country=S,
)
#: Same table as text: nothing is inferred, casts happen (and may fail to null) in cleaning.
TRANSACTIONS_TEXT = struct(**{f.name: S for f in TRANSACTIONS.fields})

# fixed values: header names of the public online-retail export
RETAIL_EXPORT_NAMES = {
    "InvoiceNo": "invoice_no",
    "StockCode": "product_id",
    "Description": "description",
    "Quantity": "quantity",
    "InvoiceDate": "invoice_date",
    "UnitPrice": "unit_price",
    "CustomerID": "customer_id",
    "Country": "country",
}

CATALOG = struct(
    product_id=S, organization_id=S, sku=S, name=S, category_level_1=S, category_level_2=S,
    category_level_3=S, brand=S, cost_price=D, base_unit_price=D, current_unit_price=D,
    specifications_json=S, compatibility_tags=T.ArrayType(S), is_active=B, popularity_weight=D,
    domain=S,
)
CUSTOMERS = struct(
    customer_id=S, organization_id=S, customer_number=S, segment=S, archetype=S,
    price_sensitivity=D, preferred_branch_id=S, preferred_categories=T.ArrayType(S),
    affinity_brands=T.ArrayType(S), total_transactions=I, lifetime_spend=D, avg_basket_size=D,
    last_purchase_date=DAY,
)
BASKETS = struct(
    transaction_id=S, organization_id=S, store_id=S, customer_id=S, transaction_date=DAY,
    timestamp=TS, line_item_id=I, product_id=S, quantity=I, unit_price=D, line_total=D,
    is_promo_applied=B,
)
INVENTORY = struct(
    branch_id=S, product_id=S, organization_id=S, stock_quantity=I, reorder_level=I, is_available=B
)
REC_TABLES = {
    "catalog": CATALOG, "customers": CUSTOMERS, "baskets": BASKETS, "inventory": INVENTORY
}

STORE_DAYS_CSV = struct(
    Store=I, DayOfWeek=I, Date=S, Sales=D, Customers=I, Open=I, Promo=I, StateHoliday=S,
    SchoolHoliday=I,
)
STORES_CSV = struct(
    Store=I, StoreType=S, Assortment=S, CompetitionDistance=D, CompetitionOpenSinceMonth=D,
    CompetitionOpenSinceYear=D, Promo2=I, Promo2SinceWeek=D, Promo2SinceYear=D, PromoInterval=S,
)
UNIT_DEMAND = struct(
    date=S, store_id=I, product_id=S, product_name=S, category=S, units_sold=I,
    unit_price=T.FloatType(), base_unit_price=T.FloatType(), is_open=T.ByteType(), customers=I,
    is_promo=T.ByteType(), promo2=T.ByteType(), day_of_week=T.ByteType(), state_holiday=S,
    school_holiday=T.ByteType(), store_type=S, assortment=S,
)

# fixed values: model column contracts, in order
STOCK_FEATURES = [
    "demand_lag_1", "demand_lag_7", "demand_lag_14", "rolling_mean_7", "rolling_mean_28",
    "rolling_std_7", "unit_price", "price_index_28", "orders_lag_1", "customers_lag_1",
    "day_of_week", "month", "is_weekend",
]
DEMAND_LAGS = (1, 2, 3, 7, 14, 21, 28)
DEMAND_WINDOWS = (7, 14, 28)
DEMAND_FEATURES = [
    *[f"demand_lag_{k}" for k in DEMAND_LAGS],
    *[f"rolling_{s}_{w}" for s in ("mean", "std", "max") for w in DEMAND_WINDOWS],
    "unit_price", "price_index_28", "cost_price", "selling_price", "margin_rate", "reorder_level",
    "has_scheduled_discount", "discount_rate",
    "day_of_week", "day_of_month", "month", "is_weekend", "is_month_start", "is_month_end",
    "is_payday_window",
    "is_public_holiday", "is_mercantile_holiday", "is_poya_day", "is_festive_peak",
    "is_in_stock", "is_branch_open",
]
SALES_FEATURES = [
    "day_of_week", "day_of_month", "month", "week_of_year", "is_weekend", "is_month_start",
    "is_month_end", "day_of_week_sin", "day_of_week_cos", "month_sin", "month_cos",
    "revenue_lag_1", "revenue_lag_7", "revenue_lag_14", "revenue_lag_28",
    "rolling_mean_7", "rolling_mean_14", "rolling_mean_28", "rolling_std_7", "rolling_std_28",
    "weekly_momentum_ratio", "branch_age_days", "branch_historical_avg_sales",
    "is_operating_day", "active_discount_count",
]
UNIT_DEMAND_FEATURES = [
    "category", "unit_price", "base_unit_price", "is_open", "is_promo", "promo2", "day_of_week",
    "state_holiday", "school_holiday", "store_type", "assortment",
]
UNIT_DEMAND_LEVELS = {
    "category": ["Beverages", "Health", "Household Cleaning", "Packaged Foods", "Personal Care"],
    "state_holiday": ["0", "a", "b", "c"],
    "store_type": ["a", "b", "c", "d"],
    "assortment": ["a", "b", "c"],
}
DEMAND_FORBIDDEN = {
    "discount_application", "discount_applications", "discountapplication", "actual_discount",
    "actual_discount_amount", "sale_item_discount_total", "future_sale", "future_quantity",
}
SALES_FORBIDDEN = {
    "Store", "store_id", "StoreType", "Assortment", "CompetitionDistance",
    "CompetitionOpenSinceMonth", "CompetitionOpenSinceYear", "Promo", "Customers", "StateHoliday",
    "SchoolHoliday", "Promo2", "Promo2SinceWeek", "Promo2SinceYear", "PromoInterval", "Open",
}
