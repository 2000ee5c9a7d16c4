"""Data-quality gates and table checks as aggregates: each check is one row of
(check, passed, metric map), computed where the data is."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import cumulative_counts
from ..session import release, settled
from .baskets import pair_counts

MIN_CORRELATION = 0.85
TOP_SHARE_RANGE = (0.70, 0.82)


def _row(df: DataFrame, name: str, passed: Column, **metrics: Column) -> DataFrame:
    entries = [x for n, c in metrics.items() for x in (F.lit(n), c.cast("double"))]
    return df.select(
        F.lit(name).alias("check"), F.coalesce(passed, F.lit(False)).alias("passed"),
        F.create_map(*entries).alias("metrics"),
    )


def long_metrics(report: DataFrame) -> DataFrame:
    """(check, passed, metric, value)."""
    return report.select("check", "passed", F.explode("metrics").alias("metric", "value"))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _count(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0))


# ---- unit-demand gates ---------------------------------------------------------------------------


def physical_integrity(demand: DataFrame) -> DataFrame:
    """Whole non-negative units; closed rows sell nothing."""
    whole = dict(demand.dtypes)["units_sold"] in {"tinyint", "smallint", "int", "bigint"}
    closed = F.col("is_open") == 0
    facts = demand.agg(
        F.min("units_sold").alias("min_units"), _count(closed).alias("closed"),
        _count(closed & (F.col("units_sold") != 0)).alias("bad"),
    )
    return _row(
        facts, "physical_integrity",
        (F.col("min_units") >= 0) & F.lit(whole) & (F.col("bad") == 0),
        min_units=F.col("min_units"), is_integer_type=F.lit(whole), closed_store_rows=F.col("closed"),
        non_zero_closed_units=F.col("bad"),
        closed_day_compliance=F.when(F.col("closed") == 0, 1.0).otherwise(
            (F.col("closed") - F.col("bad")) / F.col("closed")
        ),
    )


def store_days(demand: DataFrame) -> DataFrame:
    """Units per store and day with the day's shared context."""
    return demand.groupBy("store_id", "date").agg(
        F.sum("units_sold").alias("total_units"), F.max("customers").alias("customers"),
        F.max("is_open").alias("is_open"), F.max("day_of_week").alias("day_of_week"),
    )


def behavioural_correlation(demand: DataFrame, minimum: float = MIN_CORRELATION) -> DataFrame:
    """Customers and units move together on open store-days (ten at least)."""
    facts = store_days(demand).where("is_open = 1").agg(
        F.corr("customers", "total_units").alias("r"), F.count(F.lit(1)).alias("n")
    )
    return _row(
        facts, "behavioural_correlation", (F.col("n") >= 10) & (F.col("r") >= minimum),
        correlation_r=F.col("r"), open_store_days=F.col("n"), target_threshold=F.lit(minimum),
    )


def weekday_profile(demand: DataFrame) -> DataFrame:
    """Mean units and customers per weekday on open store-days."""
    return store_days(demand).where("is_open = 1").groupBy("day_of_week").agg(
        F.avg("total_units").alias("mean_units"), F.avg("customers").alias("mean_customers")
    )


def promotion_lift(demand: DataFrame) -> DataFrame:
    """Mean units with and without promotion per product; a class without rows counts as 0."""
    means = demand.where("is_open = 1").groupBy("product_id").agg(
        F.coalesce(F.avg(F.when(F.col("is_promo") == 1, F.col("units_sold"))), F.lit(0.0)).alias("promo"),
        F.coalesce(F.avg(F.when(F.col("is_promo") == 0, F.col("units_sold"))), F.lit(0.0)).alias("regular"),
    )
    return means.withColumn("lift", F.col("promo") / F.greatest("regular", F.lit(0.01)))


def promotional_effects(demand: DataFrame, elastic_product: str, staple_product: str) -> DataFrame:
    """Promotions raise demand, and more for the elastic product than for the staple."""
    lift = promotion_lift(demand)
    of = lambda p: F.coalesce(F.max(F.when(F.col("product_id") == p, F.col("lift"))), F.lit(1.0))
    sides = lift.agg(of(elastic_product).alias("elastic"), of(staple_product).alias("staple"))
    units = F.col("units_sold")
    facts = demand.where("is_open = 1").agg(
        F.avg(F.when(F.col("is_promo") == 1, units)).alias("promo"),
        F.avg(F.when(F.col("is_promo") == 0, units)).alias("regular"),
    ).withColumns({c: sides.select(c).scalar() for c in ("elastic", "staple")})
    return _row(
        facts, "promotional_effects",
        (F.col("promo") > F.col("regular")) & (F.col("elastic") > F.col("staple")),
        promo_mean_units=F.col("promo"), non_promo_mean_units=F.col("regular"),
        aggregate_promo_lift=F.col("promo") / F.greatest("regular", F.lit(1e-6)),
        sample_high_elasticity_lift=F.col("elastic"), sample_staple_elasticity_lift=F.col("staple"),
    )


def catalogue_velocity(
    demand: DataFrame, top_products: list[str], tail_products: list[str], staple: str,
    share_range: tuple[float, float] = TOP_SHARE_RANGE, tail_minimum: float = 0.20,
) -> DataFrame:
    """Head products carry most volume; tail products often sell nothing on open days."""
    product, units = F.col("product_id"), F.col("units_sold")
    is_open = F.col("is_open") == 1
    zero_share = lambda rows: F.coalesce(
        F.avg(F.when(is_open & rows, F.when(units == 0, 1.0).otherwise(0.0))), F.lit(0.0)
    )
    facts = demand.agg(
        F.sum(units).alias("total"),
        F.sum(F.when(product.isin(top_products), units).otherwise(0)).alias("head"),
        zero_share(product.isin(tail_products)).alias("tail_zero"),
        zero_share(product == staple).alias("staple_zero"),
    ).withColumn("share", F.when(F.col("total") != 0, F.col("head") / F.col("total")))
    return _row(
        facts, "catalogue_velocity",
        F.col("share").between(*share_range) & (F.col("tail_zero") > tail_minimum),
        top_share=F.col("share"), long_tail_zero_demand_pct=F.col("tail_zero"),
        top_staple_zero_demand_pct=F.col("staple_zero"),
    )


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: rows beyond the first of their key."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates")
    )


def panel_feasibility(demand: DataFrame, min_dates: int = 100) -> DataFrame:
    """Unique keys, every series long enough for its lags, enough dates to split.

    The lag test counts rows per series instead of sorting one: lag 7 and the 7-day mean exist from
    the eleventh row on exactly when a series has at least eleven rows, or has none to check.
    """
    keys = ["product_id", "store_id", "date"]
    series = demand.groupBy("product_id", "store_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("units_sold").isNull(), 1).otherwise(0)).alias("nulls")
    ).agg(_count(F.col("nulls") > 0).alias("broken"), F.count(F.lit(1)).alias("n_series"))
    dates = demand.select("date").distinct().agg(F.count(F.lit(1)).alias("n_dates"))
    facts = demand.agg(F.count(F.lit(1)).alias("n_rows")).withColumns(
        {
            "duplicates": duplicate_keys(demand, keys).scalar(),
            "broken": series.select("broken").scalar(),
            "n_dates": dates.scalar(),
        }
    )
    n = F.col("n_dates")
    train, val = F.floor(n * 0.70), F.floor(n * 0.85)
    return _row(
        facts, "panel_feasibility",
        (F.col("duplicates") == 0) & (F.col("broken") == 0) & (n >= min_dates),
        total_rows=F.col("n_rows"), duplicate_keys=F.col("duplicates"), series_without_lags=F.col("broken"),
        total_dates=n, train_dates_count=train, val_dates_count=val - train, test_dates_count=n - val,
    )


def demand_gates(
    demand: DataFrame, elastic_product: str, staple_product: str, top_products: list[str],
    tail_products: list[str],
) -> DataFrame:
    """All five gates, one row each."""
    return _union(
        [
            physical_integrity(demand),
            behavioural_correlation(demand),
            promotional_effects(demand, elastic_product, staple_product),
            catalogue_velocity(demand, top_products, tail_products, staple_product),
            panel_feasibility(demand),
        ]
    )


# ---- recommendation tables -----------------------------------------------------------------------


def recommendation_checks(
    catalog: DataFrame, customers: DataFrame, baskets: DataFrame, inventory: DataFrame,
    as_of=None, min_category_match: float = 0.40,
) -> DataFrame:
    """Seventeen checks of the four recommendation tables.

    Each table is read once for all row-wise facts; keys, references and distributions add one
    aggregation each. Only those single-row facts reach the driver.
    """
    spark = catalog.sparkSession
    org = catalog.agg(F.min("organization_id")).first()[0]
    foreign = _count(F.col("organization_id") != F.lit(org)).alias("foreign")
    last = F.to_date(F.lit(str(as_of))) if as_of else F.current_date()
    stock = F.col("stock_quantity")

    def fact(df: DataFrame):
        """The row of a fact; the shuffle files that it took go before the next one."""
        row = df.first()
        release(spark)
        return row

    c = catalog.agg(
        foreign, F.count_distinct("product_id").alias("products"),
        F.count_distinct(F.when(~F.col("is_active"), F.col("product_id"))).alias("inactive"),
        _count(~((F.col("cost_price") > 0) & (F.col("base_unit_price") > 0) & (F.col("current_unit_price") > 0))).alias("prices"),
    ).first()
    u = customers.agg(foreign, _count(~F.col("customer_id").rlike(r"^CUST-\d+$")).alias("bad_ids")).first()
    b = baskets.agg(
        foreign, _count(~(F.col("quantity") > 0)).alias("quantity"),
        _count(~((F.col("unit_price") > 0) & (F.col("line_total") > 0))).alias("prices"),
        _count(F.col("transaction_date").cast("date") > last).alias("future"),
    ).first()
    i = inventory.agg(
        foreign, _count(~(stock >= 0)).alias("negative"), _count(F.col("is_available") != (stock > 0)).alias("inconsistent"),
        _count(stock == 0).alias("out"), _count(stock > 0).alias("positive"),
    ).first()
    dup = lambda df, *keys: fact(duplicate_keys(df, list(keys)))[0]
    # lines per product and customer: the base of every reference and distribution check
    sold = settled(lambda: baskets.groupBy("product_id", "customer_id").agg(F.count(F.lit(1)).alias("n")), "sold")
    per_product = sold.groupBy("product_id").agg(F.sum("n").alias("n"))
    per_customer = sold.where("customer_id is not null").groupBy("customer_id").agg(F.sum("n").alias("n"))
    per_branch = baskets.groupBy("store_id").agg(
        F.count(F.lit(1)).alias("lines"), F.count_distinct("transaction_id").alias("n")
    )
    missing = lambda df, column, other, key, weight: fact(df.join(
        other.select(F.col(key).alias(column)).distinct(), column, "left_anti"
    ).agg(F.coalesce(F.sum(weight), F.lit(0)).alias("lines"), F.count(F.lit(1)).alias("keys")))
    no_branch = missing(per_branch, "store_id", inventory, "branch_id", "lines")
    stocked = inventory.groupBy("product_id").agg(F.count(F.lit(1)).alias("n"))
    sold_inactive = per_product.join(catalog.where("not is_active").select("product_id"), "product_id", "left_semi").agg(
        F.coalesce(F.sum("n"), F.lit(0))
    ).first()[0]
    sizes = fact(
        baskets.groupBy("transaction_id").agg(F.sum("quantity").alias("units"))
        .groupBy("units").agg(F.count(F.lit(1)).alias("n"))
        .agg(F.try_divide(F.sum(F.col("units") * F.col("n")), F.sum("n")).alias("mean"),
             F.percentile("units", F.lit(0.5), F.col("n")).alias("median"), F.min("units").alias("low"), F.max("units").alias("high"))
    )
    bought = per_product.agg(F.count(F.lit(1))).first()[0]
    buyers = per_customer.agg(F.count(F.lit(1))).first()[0]
    # the pairs' items and counts go when their two numbers are known
    pairs = settled(lambda: pair_counts(baskets).agg(F.count(F.lit(1)).alias("n"), F.max("n").alias("best")), "pairs").first()
    matched = fact(
        sold.join(catalog.select("product_id", "category_level_1"), "product_id")
        .join(customers.select("customer_id", "preferred_categories").where(F.size("preferred_categories") > 0), "customer_id")
        .agg(F.coalesce(F.sum(F.when(F.array_contains("preferred_categories", F.col("category_level_1")), F.col("n")).otherwise(0)), F.lit(0)).alias("hit"),
             F.coalesce(F.sum("n"), F.lit(0)).alias("all"))
    )
    volume = per_branch.agg(
        F.count(F.lit(1)).alias("n"), F.min("n").alias("low"), F.max("n").alias("high"), F.stddev_samp("n").alias("std")
    ).first()
    tags = catalog.select(F.explode("compatibility_tags").alias("t")).agg(F.count_distinct("t")).first()[0]
    head = _head_share(per_product, bought)
    suspicious = [n for n in customers.columns if any(w in n.lower() for w in ("email", "phone", "name", "address", "ssn"))]
    selling = c["products"] - c["inactive"]
    ratio = matched["hit"] / max(matched["all"], 1)
    none = lambda **m: (all(v == 0 for v in m.values()), m)

    report = {
        "primary_keys_unique": none(catalog=dup(catalog, "product_id"), customers=dup(customers, "customer_id"),
                                    basket_lines=dup(baskets, "transaction_id", "line_item_id"), inventory=dup(inventory, "branch_id", "product_id")),
        "foreign_keys_valid": none(basket_products=missing(per_product, "product_id", catalog, "product_id", "n")["lines"],
                                   basket_customers=missing(per_customer, "customer_id", customers, "customer_id", "n")["lines"],
                                   basket_branches=no_branch["lines"],
                                   inventory_products=missing(stocked, "product_id", catalog, "product_id", "n")["lines"]),
        "quantities_valid": none(basket_quantity=b["quantity"], stock_quantity=i["negative"]),
        "prices_valid": none(catalog_prices=c["prices"], basket_prices=b["prices"]),
        "no_inactive_products_sold": none(inactive_sold_count=sold_inactive),
        "valid_branch_assignment": none(invalid_branch_count=no_branch["keys"]),
        "reference_integrity": (bought > 0 and buyers > 0, {"products_bought": bought, "customers_buying": buyers,
                                "active_catalog_coverage": bought / selling if selling else None}),
        "tenant_consistency": none(catalog=c["foreign"], customers=u["foreign"], baskets=b["foreign"], inventory=i["foreign"]),
        "basket_size_distribution": (
            sizes["low"] is not None and 1.5 <= sizes["mean"] <= 5.0 and 1.0 <= sizes["median"] <= 4.0 and sizes["low"] >= 1,
            {"mean_basket_size": sizes["mean"], "median_basket_size": sizes["median"], "min_basket_size": sizes["low"], "max_basket_size": sizes["high"]}),
        "long_tail_distribution": (head is not None and head >= 0.35, {"top_20pct_volume_share": head}),
        "co_purchase_signals": (pairs["n"] >= 5 and pairs["best"] >= 10, {"n_pairs": pairs["n"], "best_pair": pairs["best"]}),
        "customer_preference_influence": (ratio >= min_category_match, {"match_ratio": ratio}),
        "branch_behavior_differences": (volume["n"] > 1 and volume["std"] > 0, {"branch_count": volume["n"], "min_branch_txns": volume["low"],
                                        "max_branch_txns": volume["high"], "std_branch_txns": volume["std"]}),
        "compatibility_relationships": (tags >= 10, {"unique_tags": tags}),
        "inventory_validity": (i["inconsistent"] == 0 and i["out"] > 0 and i["positive"] > 0,
                               {"inconsistent": i["inconsistent"], "out_of_stock": i["out"], "in_stock": i["positive"]}),
        "no_pii_exists": none(bad_ids=u["bad_ids"], suspicious_columns=len(suspicious)),
        "temporal_consistency": none(future_rows=b["future"]),
    }
    rows = [
        (name, bool(passed), {m: None if v is None else float(v) for m, v in metrics.items()})
        for name, (passed, metrics) in report.items()
    ]
    return spark.createDataFrame(rows, "check string, passed boolean, metrics map<string,double>")


def _head_share(counts: DataFrame, n_products: int) -> float | None:
    """Share of lines held by the most sold fifth of the products.

    Ties at the edge do not matter: equal counts add the same. Products collapse to distinct counts
    first, so the running position is taken over few rows.
    """
    ranked = cumulative_counts(counts.select((-F.col("n")).alias("m")), "m")
    head = max(1, int(n_products * 0.20))
    taken = F.least(F.greatest(F.lit(head) - F.col("before"), F.lit(0)), F.col("n"))
    return ranked.agg(F.try_divide(F.sum(taken * -F.col("m")), F.sum(F.col("n") * -F.col("m")))).first()[0]


def recommendation_summary(
    catalog: DataFrame, customers: DataFrame, baskets: DataFrame, inventory: DataFrame
) -> DataFrame:
    """One row of report metrics."""
    scalar = lambda df, c: df.agg(c).scalar()
    return customers.agg(
        F.count(F.lit(1)).alias("total_customers"),
        _count(F.col("total_transactions") > 1).alias("repeat_customers"),
    ).withColumns(
        {
            "repeat_customer_ratio": F.col("repeat_customers") / F.greatest("total_customers", F.lit(1)),
            "unique_products": scalar(catalog, F.count_distinct("product_id")),
            "active_products": scalar(catalog.where("is_active"), F.count_distinct("product_id")),
            "unique_branches": scalar(baskets, F.count_distinct("store_id")),
            "total_transactions": scalar(baskets, F.count_distinct("transaction_id")),
            "total_line_items": scalar(baskets, F.count(F.lit(1))),
            "inventory_in_stock_rate": scalar(inventory, F.avg(F.col("is_available").cast("double"))),
        }
    )


def sales_training_problems(df: DataFrame, features: list[str], forbidden: set[str], target: str = "daily_revenue") -> DataFrame:
    """(problem, n): missing and forbidden columns, null or negative targets, null features."""
    spark = df.sparkSession
    problems = [(f"missing:{c}", 1) for c in [target, "branch_id", "date", *features] if c not in df.columns]
    problems += [(f"forbidden:{c}", 1) for c in sorted(forbidden & set(df.columns))]
    fixed = spark.createDataFrame(problems, "problem string, n long")
    counted = [(f"null:{c}", F.col(c).isNull()) for c in features if c in df.columns]
    if target in df.columns:
        counted += [(f"null:{target}", F.col(target).isNull()), (f"negative:{target}", F.col(target) < 0)]
    sums = df.agg(*[_count(cond).cast("long").alias(name) for name, cond in counted])
    entries = F.array(*[F.struct(F.lit(n).alias("problem"), F.col(f"`{n}`").alias("n")) for n, _ in counted])
    found = sums.select(F.explode(entries).alias("e")).select("e.*").where("n > 0")
    return fixed.unionByName(found)
