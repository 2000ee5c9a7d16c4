"""Quality gates, table checks and request rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality as ops
from ..operators import requests
from ..session import cut_lineage, settled
from ..sources import files
from ..sources import star_schema as star
from . import recommend  # noqa: F401 - registers the table expressions read here
from .registry import cte, query, rounded, sql

HEAD = [f"Brand#{i}" for i in range(1, 11)]
TAIL = [f"Brand#{i}" for i in range(16, 26)]
ELASTIC, STAPLE = "Brand#3", "Brand#2"
AS_OF = "2001-08-01"
quoted = lambda names: ", ".join(f"'{n}'" for n in names)

cte("ud", """
SELECT c.*, sum(lines) OVER (PARTITION BY store_id, date) AS customers, CASE WHEN isodow(date) = 7 THEN 0 ELSE 1 END AS is_open,
  isodow(date) - 1 AS day_of_week, CASE WHEN isodow(date) = 7 THEN 0 ELSE units END AS units_sold FROM (
SELECT branch_key AS store_id, CAST(o_orderdate AS DATE) AS date, p_brand AS product_id, CAST(sum(l_quantity) AS INTEGER) AS units, count(*) AS lines,
  max(CASE WHEN l_discount >= 0.08 THEN 1 ELSE 0 END) AS is_promo
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN branch_of ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey GROUP BY ALL) c""", "branch_of")
cte("ud_days", """
SELECT store_id, date, sum(units_sold) AS total_units, max(customers) AS customers, max(is_open) AS is_open, max(day_of_week) AS day_of_week
FROM ud GROUP BY store_id, date""", "ud")


def unit_table(spark, folder):
    """Unit demand, written once: a gate reads it several times."""
    return cut_lineage(star.unit_demand(spark, folder), "unit-demand")


def gate(*checks):
    """One query: the checks' metrics in long form."""
    return rounded(ops.long_metrics(ops._union(list(checks))), 6)


def rows_sql(check: str, passed: str, source: str, **metrics: str) -> str:
    parts = [
        f"SELECT '{check}' AS \"check\", coalesce({passed}, false) AS passed, '{n}' AS metric, round(CAST({e} AS DOUBLE), 6) AS value FROM facts"
        for n, e in metrics.items()
    ]
    return f"SELECT * FROM (WITH facts AS ({source}) {' UNION ALL '.join(parts)})"


G1 = rows_sql("physical_integrity", "lo >= 0 AND bad = 0",
    "SELECT min(units_sold) AS lo, sum(CASE WHEN is_open = 0 THEN 1 ELSE 0 END) AS closed, sum(CASE WHEN is_open = 0 AND units_sold <> 0 THEN 1 ELSE 0 END) AS bad, min(CASE WHEN units_sold = floor(units_sold) THEN 1 ELSE 0 END) AS whole FROM ud",
    min_units="lo", is_integer_type="whole", closed_store_rows="closed", non_zero_closed_units="bad",
    closed_day_compliance="CASE WHEN closed = 0 THEN 1 ELSE (closed - bad) / closed END")
G2 = rows_sql("behavioural_correlation", "n >= 10 AND r >= 0.85",
    "SELECT corr(customers, total_units) AS r, count(*) AS n FROM ud_days WHERE is_open = 1",
    correlation_r="r", open_store_days="n", target_threshold="0.85")
LIFT = f"""SELECT max(CASE WHEN product_id = '{ELASTIC}' THEN lift END) AS e, max(CASE WHEN product_id = '{STAPLE}' THEN lift END) AS s FROM (
  SELECT product_id, coalesce(avg(CASE WHEN is_promo = 1 THEN units_sold END), 0) / greatest(coalesce(avg(CASE WHEN is_promo = 0 THEN units_sold END), 0), 0.01) AS lift
  FROM ud WHERE is_open = 1 GROUP BY product_id)"""
G3 = rows_sql("promotional_effects", "p > q AND coalesce(e, 1) > coalesce(s, 1)",
    f"SELECT * FROM (SELECT avg(CASE WHEN is_promo = 1 THEN units_sold END) AS p, avg(CASE WHEN is_promo = 0 THEN units_sold END) AS q FROM ud WHERE is_open = 1), ({LIFT})",
    promo_mean_units="p", non_promo_mean_units="q", aggregate_promo_lift="p / greatest(q, 0.000001)",
    sample_high_elasticity_lift="coalesce(e, 1)", sample_staple_elasticity_lift="coalesce(s, 1)")
G4 = rows_sql("catalogue_velocity", "share BETWEEN 0.70 AND 0.82 AND tail > 0.20",
    f"""SELECT sum(CASE WHEN product_id IN ({quoted(HEAD)}) THEN units_sold ELSE 0 END) / sum(units_sold) AS share,
 coalesce(avg(CASE WHEN is_open = 1 AND product_id IN ({quoted(TAIL)}) THEN CASE WHEN units_sold = 0 THEN 1.0 ELSE 0.0 END END), 0) AS tail,
 coalesce(avg(CASE WHEN is_open = 1 AND product_id = '{STAPLE}' THEN CASE WHEN units_sold = 0 THEN 1.0 ELSE 0.0 END END), 0) AS staple FROM ud""",
    top_share="share", long_tail_zero_demand_pct="tail", top_staple_zero_demand_pct="staple")
G5 = rows_sql("panel_feasibility", "d = 0 AND broken = 0 AND n >= 100",
    """SELECT count(*) AS rows_, count(*) - count(DISTINCT (product_id, store_id, date)) AS d,
 (SELECT count(*) FROM (SELECT 1 FROM ud GROUP BY product_id, store_id HAVING count(*) > count(units_sold))) AS broken, count(DISTINCT date) AS n FROM ud""",
    total_rows="rows_", duplicate_keys="d", series_without_lags="broken", total_dates="n", train_dates_count="floor(n * 0.70::DOUBLE)",
    val_dates_count="floor(n * 0.85::DOUBLE) - floor(n * 0.70::DOUBLE)", test_dates_count="n - floor(n * 0.85::DOUBLE)")


@query("gate_physical_integrity", sql(G1, "ud"))
def gate_1(spark, folder):
    return gate(ops.physical_integrity(unit_table(spark, folder)))


@query("gate_behavioural_correlation", sql(G2, "ud_days"))
def gate_2(spark, folder):
    return gate(ops.behavioural_correlation(unit_table(spark, folder)))


@query("gate_promotional_effects", sql(G3, "ud"))
def gate_3(spark, folder):
    return gate(ops.promotional_effects(unit_table(spark, folder), ELASTIC, STAPLE))


@query("gate_catalogue_velocity", sql(G4, "ud"))
def gate_4(spark, folder):
    return gate(ops.catalogue_velocity(unit_table(spark, folder), HEAD, TAIL, STAPLE))


@query("gate_panel_feasibility", sql(G5, "ud"))
def gate_5(spark, folder):
    return gate(ops.panel_feasibility(unit_table(spark, folder)))


@query("demand_gates", sql(" UNION ALL ".join([G1, G2, G3, G4, G5]), "ud", "ud_days"))
def demand_gates(spark, folder):
    report = ops.demand_gates(unit_table(spark, folder), ELASTIC, STAPLE, HEAD, TAIL)
    return rounded(ops.long_metrics(report), 6)


@query("weekday_profile", sql("""
SELECT CAST(day_of_week AS INTEGER) AS day_of_week, round(avg(total_units), 6) AS mean_units, round(avg(customers), 6) AS mean_customers
FROM ud_days WHERE is_open = 1 GROUP BY day_of_week""", "ud_days"))
def weekday_profile(spark, folder):
    return rounded(ops.weekday_profile(unit_table(spark, folder)))


@query("promotion_lift", sql("""
SELECT product_id, round(p, 6) AS promo, round(q, 6) AS regular, round(p / greatest(q, 0.01), 6) AS lift FROM (
SELECT product_id, coalesce(avg(CASE WHEN is_promo = 1 THEN units_sold END), 0) AS p, coalesce(avg(CASE WHEN is_promo = 0 THEN units_sold END), 0) AS q
FROM ud WHERE is_open = 1 GROUP BY product_id)""", "ud"))
def promotion_lift(spark, folder):
    return rounded(ops.promotion_lift(unit_table(spark, folder)))


def rec_tables(spark, folder):
    """Catalogue, customers (with preferences and totals), baskets, inventory."""
    from ..operators.baskets import customer_totals

    # one after the other, so that the shuffle files of one are gone when the next is made
    baskets = settled(lambda: star.baskets(spark, folder), "baskets")
    preferences = settled(lambda: star.customer_preferences(spark, folder), "preferences")
    customers = star.table(spark, folder, "customer").select(
        F.col("c_custkey").cast("string").alias("customer_id"), F.lit(star.ORGANIZATION).alias("organization_id")
    )
    known = settled(lambda: customer_totals(baskets, customers).join(preferences, "customer_id", "left"), "customers")
    stock = settled(lambda: star.inventory(spark, folder), "inventory")
    return star.catalog(spark, folder), known, baskets, stock


cte("inv", """
SELECT DISTINCT branch_id, CAST(l_partkey AS VARCHAR) AS product_id, CAST((l_partkey * 7 + branch_key * 13) % 20 AS INTEGER) AS stock
FROM lineitem JOIN branch_of ON l_suppkey = s_suppkey""", "branch_of")
REC_CHECKS = [
    rows_sql("primary_keys_unique", "a = 0 AND b = 0 AND c = 0 AND d = 0",
        """SELECT (SELECT count(*) - count(DISTINCT p_partkey) FROM part) AS a, (SELECT count(*) - count(DISTINCT c_custkey) FROM customer) AS b,
 (SELECT count(*) - count(DISTINCT (transaction_id, line_item_id)) FROM bk) AS c, (SELECT count(*) - count(DISTINCT (branch_id, product_id)) FROM inv) AS d""",
        catalog="a", customers="b", basket_lines="c", inventory="d"),
    rows_sql("foreign_keys_valid", "a = 0 AND b = 0 AND c = 0 AND d = 0",
        """SELECT (SELECT count(*) FROM bk WHERE product_id NOT IN (SELECT CAST(p_partkey AS VARCHAR) FROM part)) AS a,
 (SELECT count(*) FROM bk WHERE customer_id NOT IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer)) AS b,
 (SELECT count(*) FROM bk WHERE store_id NOT IN (SELECT branch_id FROM inv)) AS c, (SELECT count(*) FROM inv WHERE product_id NOT IN (SELECT CAST(p_partkey AS VARCHAR) FROM part)) AS d""",
        basket_products="a", basket_customers="b", basket_branches="c", inventory_products="d"),
    rows_sql("quantities_valid", "a = 0 AND b = 0",
        "SELECT (SELECT count(*) FROM bk WHERE NOT quantity > 0) AS a, (SELECT count(*) FROM inv WHERE NOT stock >= 0) AS b", basket_quantity="a", stock_quantity="b"),
    rows_sql("prices_valid", "a = 0 AND b = 0",
        "SELECT (SELECT count(*) FROM part WHERE NOT p_retailprice > 0) AS a, (SELECT count(*) FROM bk WHERE NOT (unit_price > 0 AND line_total > 0)) AS b",
        catalog_prices="a", basket_prices="b"),
    rows_sql("no_inactive_products_sold", "a = 0", "SELECT count(*) AS a FROM bk WHERE product_id NOT IN (SELECT product_id FROM active)", inactive_sold_count="a"),
    rows_sql("valid_branch_assignment", "a = 0", "SELECT count(DISTINCT store_id) AS a FROM bk WHERE store_id NOT IN (SELECT branch_id FROM inv)", invalid_branch_count="a"),
    rows_sql("reference_integrity", "a > 0 AND b > 0",
        "SELECT count(DISTINCT product_id) AS a, count(DISTINCT customer_id) AS b, (SELECT count(*) FROM active) AS n FROM bk",
        products_bought="a", customers_buying="b", active_catalog_coverage="a / n"),
    rows_sql("tenant_consistency", "true", "SELECT 0 AS z", catalog="z", customers="z", baskets="z", inventory="z"),
    rows_sql("basket_size_distribution", "m BETWEEN 1.5 AND 5.0 AND d BETWEEN 1.0 AND 4.0 AND lo >= 1",
        "SELECT avg(u) AS m, median(u) AS d, min(u) AS lo, max(u) AS hi FROM (SELECT sum(quantity) AS u FROM bk GROUP BY transaction_id)",
        mean_basket_size="m", median_basket_size="d", min_basket_size="lo", max_basket_size="hi"),
    rows_sql("long_tail_distribution", "s >= 0.35",
        """SELECT sum(CASE WHEN r <= greatest(1, floor(t * 0.20::DOUBLE)) THEN n ELSE 0 END) / sum(n) AS s FROM (
 SELECT n, row_number() OVER (ORDER BY n DESC) AS r, count(*) OVER () AS t FROM (SELECT count(*) AS n FROM bk GROUP BY product_id))""", top_20pct_volume_share="s"),
    rows_sql("co_purchase_signals", "a >= 5 AND b >= 10", "SELECT count(*) AS a, max(n) AS b FROM pairs", n_pairs="a", best_pair="b"),
    rows_sql("customer_preference_influence", "r >= 0.40",
        """SELECT sum(CASE WHEN list_contains(cats, p_type) THEN 1 ELSE 0 END) / greatest(count(*), 1) AS r
 FROM bk JOIN part ON CAST(p_partkey AS VARCHAR) = product_id JOIN prefs USING (customer_id)""", match_ratio="r"),
    rows_sql("branch_behavior_differences", "s > 0 AND c > 1",
        "SELECT count(*) AS c, min(n) AS lo, max(n) AS hi, stddev_samp(n) AS s FROM (SELECT count(DISTINCT transaction_id) AS n FROM bk GROUP BY store_id)",
        branch_count="c", min_branch_txns="lo", max_branch_txns="hi", std_branch_txns="s"),
    rows_sql("compatibility_relationships", "n >= 10", "SELECT count(DISTINCT t) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS t FROM part)", unique_tags="n"),
    rows_sql("inventory_validity", "o > 0 AND i > 0", "SELECT sum(CASE WHEN stock = 0 THEN 1 ELSE 0 END) AS o, sum(CASE WHEN stock > 0 THEN 1 ELSE 0 END) AS i FROM inv",
        inconsistent="0", out_of_stock="o", in_stock="i"),
    rows_sql("no_pii_exists", "n = 0", r"SELECT count(*) AS n FROM customer WHERE NOT regexp_full_match(CAST(c_custkey AS VARCHAR), 'CUST-\d+')", bad_ids="n", suspicious_columns="0"),
    rows_sql("temporal_consistency", "n = 0", f"SELECT count(*) AS n FROM bk WHERE transaction_date > DATE '{AS_OF}'", future_rows="n"),
]


@query("rec_quality_checks", sql(" UNION ALL ".join(REC_CHECKS), "bk", "inv", "active", "pairs", "prefs"))
def rec_quality_checks(spark, folder):
    report = ops.recommendation_checks(*rec_tables(spark, folder), as_of=AS_OF)
    return rounded(ops.long_metrics(report), 6)


@query("rec_summary", sql("""
SELECT (SELECT count(*) FROM customer) AS total_customers, r AS repeat_customers, r / CAST((SELECT count(*) FROM customer) AS DOUBLE) AS repeat_customer_ratio,
  (SELECT count(*) FROM part) AS unique_products, (SELECT count(*) FROM active) AS active_products, (SELECT count(DISTINCT store_id) FROM bk) AS unique_branches,
  (SELECT count(DISTINCT transaction_id) FROM bk) AS total_transactions, (SELECT count(*) FROM bk) AS total_line_items,
  round((SELECT avg(CASE WHEN stock > 0 THEN 1.0 ELSE 0.0 END) FROM inv), 9) AS inventory_in_stock_rate
FROM (SELECT count(*) AS r FROM (SELECT customer_id FROM bk GROUP BY customer_id HAVING count(DISTINCT transaction_id) > 1))""", "bk", "inv", "active"))
def rec_summary(spark, folder):
    out = ops.recommendation_summary(*rec_tables(spark, folder))
    return rounded(out.withColumn("repeat_customers", F.col("repeat_customers").cast("long")), 9, only=("inventory_in_stock_rate",))


@query("duplicate_lines", """
SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicates FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)""")
def duplicate_lines(spark, folder):
    return ops.duplicate_keys(star.table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("pricing_request_rules", """
SELECT reasons, count(*) AS n FROM (
SELECT array_to_string(list_filter([
  CASE WHEN NOT l_extendedprice / l_quantity > 0 THEN 'current_price' END, CASE WHEN NOT p_retailprice * 0.6 > 0 THEN 'unit_cost' END,
  CASE WHEN NOT (l_tax * 20 >= 0 AND l_tax * 20 <= 1) THEN 'min_margin_rate' END, CASE WHEN NOT (l_discount * 6 > 0 AND l_discount * 6 <= 0.5) THEN 'max_change_rate' END,
  CASE WHEN NOT (CAST(l_quantity AS INTEGER) BETWEEN 5 AND 101) THEN 'candidate_steps' END,
  CASE WHEN l_extendedprice / l_quantity <= p_retailprice * 0.6 THEN 'price_not_above_cost' END], lambda x: x IS NOT NULL), ',') AS reasons
FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY reasons""")
def pricing_request_rules(spark, folder):
    part = star.table(spark, folder, "part").select("p_partkey", "p_retailprice")
    lines = star.table(spark, folder, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    zeros = {name: F.lit(0.0) for name in requests.FEATURES}
    asked = lines.select(
        F.col("l_partkey").cast("string").alias("product_id"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("current_price"),
        (F.col("p_retailprice") * 0.6).alias("unit_cost"), (F.col("l_tax") * 20).alias("min_margin_rate"),
        (F.col("l_discount") * 6).alias("max_change_rate"), F.col("l_quantity").cast("int").alias("candidate_steps"),
        F.lit(1.0).alias("price_index_28"),
    ).withColumns(zeros)
    checked = requests.validate(asked, "pricing")
    return checked.groupBy(F.array_join("reasons", ",").alias("reasons")).agg(F.count(F.lit(1)).alias("n"))


@query("recommendation_request_rules", """
SELECT reasons, count(*) AS n FROM (SELECT array_to_string(list_filter([
  CASE WHEN event_type = 'error' THEN 'unknown_context' END, CASE WHEN NOT (user_id % 25 BETWEEN 1 AND 20) THEN 'top_n' END,
  CASE WHEN event_type = 'click' AND event_id % 2 = 0 THEN 'product_required' END], lambda x: x IS NOT NULL), ',') AS reasons FROM events) GROUP BY reasons""")
def recommendation_request_rules(spark, folder):
    events = star.table(spark, folder, "events")
    context = F.when(F.col("event_type") == "error", "BROKEN").when(F.col("event_type") == "click", "PRODUCT").otherwise("TRENDING")
    asked = events.select(
        F.lit(star.ORGANIZATION).alias("organization_id"), context.alias("context"), (F.col("user_id") % 25).alias("top_n"),
        F.when(F.col("event_id") % 2 == 1, F.lit("1")).alias("product_id"), F.array().cast("array<string>").alias("product_ids"),
        F.lit(None).cast("string").alias("branch_id"), F.col("user_id").cast("string").alias("customer_id"),
    )
    checked = requests.validate(asked, "recommendation")
    return checked.groupBy(F.array_join("reasons", ",").alias("reasons")).agg(F.count(F.lit(1)).alias("n"))


@query("table_fingerprint")
def table_fingerprint(spark, folder):
    return files.fingerprint(star.table(spark, folder, "lineitem"))


@query("table_stats")
def table_stats(spark, folder):
    return files.table_stats(star.table(spark, folder, "lineitem"))
