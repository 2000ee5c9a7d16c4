"""Trend, popularity, personal ranking, hybrid recommendations and their offline evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation, hybrid, neighbours, personal, popularity, splits
from ..session import cut_lineage, discard, settled
from ..sources import star_schema as star
from . import baskets as basket_plans
from .registry import cte, derived_ctes, query, renamed, rounded, sql

SUPPORT, CONFIDENCE, LIFT = 0.0002, 0.05, 1.0
basket_plans.itemset_ctes("prod", "items", SUPPORT, 3)
basket_plans.rule_cte("prod", CONFIDENCE, LIFT)

cte("velocity", """
SELECT s.store_id, p.product_id,
       (coalesce(s7, 0) / 7.0::DOUBLE + 0.1::DOUBLE) / (coalesce(s30, 0) / 30.0::DOUBLE + 0.1::DOUBLE) AS v, s30
FROM (SELECT DISTINCT store_id FROM bk) s CROSS JOIN (SELECT DISTINCT product_id FROM bk) p
LEFT JOIN (SELECT store_id, product_id,
                  CAST(sum(CASE WHEN transaction_date > top - 7 THEN quantity ELSE 0 END) AS DOUBLE) AS s7,
                  CAST(sum(CASE WHEN transaction_date > top - 30 THEN quantity ELSE 0 END) AS DOUBLE) AS s30
           FROM bk, (SELECT max(transaction_date) AS top FROM bk) GROUP BY ALL) w USING (store_id, product_id)""", "bk")
cte("branch_trend", """
SELECT store_id, product_id, s30, (v - min(v) OVER w) / greatest(0.00001::DOUBLE, max(v) OVER w - min(v) OVER w) AS score
FROM velocity WINDOW w AS (PARTITION BY store_id)""", "velocity")
cte("trend", """
SELECT product_id, (v - min(v) OVER ()) / greatest(0.00001::DOUBLE, max(v) OVER () - min(v) OVER ()) AS score FROM (
SELECT product_id, (s7 / 7.0::DOUBLE + 0.1::DOUBLE) / (s30 / 30.0::DOUBLE + 0.1::DOUBLE) AS v FROM (
SELECT product_id, CAST(sum(CASE WHEN transaction_date > top - 7 THEN quantity ELSE 0 END) AS DOUBLE) AS s7,
       CAST(sum(CASE WHEN transaction_date > top - 30 THEN quantity ELSE 0 END) AS DOUBLE) AS s30
FROM bk, (SELECT max(transaction_date) AS top FROM bk) GROUP BY product_id))""", "bk")
cte("trend_lists", """
SELECT * FROM (
SELECT store_id, product_id, score, row_number() OVER (PARTITION BY store_id ORDER BY score DESC, product_id) AS rank FROM branch_trend
UNION ALL SELECT '*', product_id, score, row_number() OVER (ORDER BY score DESC, product_id) FROM trend) WHERE rank <= 25""",
    "branch_trend", "trend")
cte("org_pop", """
SELECT product_id, n, n / sum(n) OVER () AS share, (n / sum(n) OVER ()) / (max(n) OVER () / sum(n) OVER ()) AS score
FROM (SELECT product_id, CAST(sum(quantity) AS DOUBLE) AS n FROM bk GROUP BY product_id)""", "bk")
cte("branch_pop", """
SELECT store_id, product_id, raw / max(raw) OVER (PARTITION BY store_id) AS score, raw FROM (
SELECT b.store_id, o.product_id, (coalesce(u.n, 0) + 20.0::DOUBLE * o.share) / (b.total + 20.0::DOUBLE) AS raw
FROM (SELECT store_id, CAST(sum(quantity) AS DOUBLE) AS total FROM bk GROUP BY store_id) b CROSS JOIN org_pop o
LEFT JOIN (SELECT store_id, product_id, CAST(sum(quantity) AS DOUBLE) AS n FROM bk GROUP BY ALL) u
  ON u.store_id = b.store_id AND u.product_id = o.product_id)""", "bk", "org_pop")
cte("pop_lists", """
SELECT * FROM (
SELECT store_id, product_id, score, row_number() OVER (PARTITION BY store_id ORDER BY raw DESC, product_id) AS rank FROM branch_pop
UNION ALL SELECT '*', product_id, score, row_number() OVER (ORDER BY n DESC, product_id) FROM org_pop) WHERE rank <= 25""",
    "branch_pop", "org_pop")
cte("owned", """
SELECT customer_id, product_id, sum(quantity) AS q, sum(sum(quantity)) OVER (PARTITION BY customer_id) AS total
FROM bk WHERE customer_id IS NOT NULL GROUP BY customer_id, product_id""", "bk")
cte("prefs", """
SELECT customer_id, list(value) FILTER (WHERE kind = 'category') AS cats, list(value) FILTER (WHERE kind = 'brand') AS brands FROM (
SELECT customer_id, kind, value, row_number() OVER (PARTITION BY customer_id, kind ORDER BY u DESC, value) AS r FROM (
  SELECT customer_id, 'category' AS kind, p_type AS value, sum(quantity) AS u FROM bk JOIN part ON CAST(p_partkey AS VARCHAR) = product_id GROUP BY ALL
  UNION ALL
  SELECT customer_id, 'brand', p_brand, sum(quantity) FROM bk JOIN part ON CAST(p_partkey AS VARCHAR) = product_id GROUP BY ALL))
WHERE r <= 2 GROUP BY customer_id""", "bk")
cte("active", "SELECT CAST(p_partkey AS VARCHAR) AS product_id, p_type AS cat, p_brand AS brand FROM part WHERE p_size > 2")
cte("personal_scores", """
SELECT customer_id, product_id, sum(score) AS score FROM (
  SELECT customer_id, product_id, score FROM (
    SELECT o.customer_id, s.neighbour_id AS product_id, round(sum(o.q / CAST(o.total AS DOUBLE) * s.score * 2), 9) AS score
    FROM owned o JOIN sim_rank s ON s.product_id = o.product_id AND s.rank <= 8
    WHERE s.neighbour_id IN (SELECT product_id FROM active) GROUP BY ALL)
  UNION ALL
  SELECT customer_id, product_id, CASE WHEN list_contains(cats, cat) THEN 0.5 ELSE 0 END + CASE WHEN list_contains(brands, brand) THEN 0.5 ELSE 0 END
  FROM prefs, active WHERE list_contains(cats, cat) OR list_contains(brands, brand)) x
WHERE NOT EXISTS (SELECT 1 FROM owned o WHERE o.customer_id = x.customer_id AND o.product_id = x.product_id)
GROUP BY customer_id, product_id""", "owned", "sim_rank", "active", "prefs")
cte("personal_lists", """
SELECT customer_id, product_id, score / max(score) OVER (PARTITION BY customer_id) AS score, rank FROM (
SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY score DESC, product_id) AS rank FROM personal_scores)
WHERE rank <= 25""", "personal_scores")


cte("stock", """
SELECT DISTINCT branch_id, CAST(l_partkey AS VARCHAR) AS product_id, CAST((l_partkey * 7 + branch_key * 13) % 20 AS INTEGER) AS stock
FROM lineitem JOIN branch_of ON l_suppkey = s_suppkey""", "branch_of")


def units(spark, folder):
    """Sold units per branch and product, written once: lists, totals and ranks all read them."""
    return cut_lineage(popularity.item_units(star.baskets(spark, folder)), "units")


def sales(spark, folder):
    return cut_lineage(popularity.windowed_sales(star.baskets(spark, folder)), "sales")


def index(spark, folder, signals, query_size=1):
    baskets = settled(lambda: star.baskets(spark, folder), "baskets")
    built = hybrid.build_index(
        baskets, star.customer_preferences(spark, folder), star.catalog(spark, folder),
        min_support=SUPPORT, min_confidence=CONFIDENCE, min_lift=LIFT, query_size=query_size, signals=signals,
    )
    discard(baskets)
    return built


@query("trending_velocity", sql("SELECT product_id, round(score, 9) AS score FROM trend", "trend"))
def trending_velocity(spark, folder):
    return rounded(popularity.trending_scores(sales(spark, folder)), 9)


@query("branch_trending_sold", sql("""
SELECT store_id, product_id, round(score, 9) AS score FROM branch_trend WHERE s30 > 0""", "branch_trend"))
def branch_trending_sold(spark, folder):
    return rounded(popularity.branch_trending(sales(spark, folder)), 9)


@query("branch_trending", sql("""
SELECT store_id, product_id, round(score, 9) AS score, CAST(rank AS INTEGER) AS rank FROM trend_lists WHERE store_id <> '*'""", "trend_lists"))
def branch_trending(spark, folder):
    return rounded(popularity.branch_trending_top(sales(spark, folder), 25), 9)


@query("org_popularity", sql("SELECT product_id, n, share, round(score, 9) AS score FROM org_pop", "org_pop"))
def org_popularity(spark, folder):
    return rounded(popularity.org_popularity(units(spark, folder)), 9, only=("score",))


@query("branch_popularity", sql("""
SELECT store_id, product_id, round(score, 9) AS score, CAST(rank AS INTEGER) AS rank FROM pop_lists WHERE store_id <> '*'""", "pop_lists"))
def branch_popularity(spark, folder):
    return rounded(popularity.branch_popularity_top(units(spark, folder), 25, 20.0), 9)


@query("customer_preferences", sql("""
SELECT customer_id, array_to_string(list_sort(cats), ',') AS categories, array_to_string(list_sort(brands), ',') AS brands FROM prefs""", "prefs"))
def customer_preferences(spark, folder):
    return star.customer_preferences(spark, folder).select(
        "customer_id", F.array_join("preferred_categories", ",").alias("categories"),
        F.array_join("affinity_brands", ",").alias("brands"),
    )


@query("personalized_topk", sql("""
SELECT customer_id, product_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM personal_lists WHERE rank <= 10""", "personal_lists"))
def personalized_topk(spark, folder):
    baskets = settled(lambda: star.baskets(spark, folder), "baskets")
    similar = settled(lambda: neighbours.item_similarity(baskets), "item_similarity")
    top = settled(lambda: personal.personal_top(
        baskets, star.customer_preferences(spark, folder), star.catalog(spark, folder), similar, 10,
    ), "personal")
    discard(baskets, similar)
    return rounded(top)


# ---- hybrid requests: (request_id, context, customer_id, product_ids, branch_id) from the tables

HYBRID_CTES = ("prod_rules", "compat_rank", "sim", "content_rank", "personal_lists", "trend_lists", "pop_lists", "active", "bk")
WEIGHTS_SQL = ", ".join(
    f"('{c}', {', '.join(f'{w}::DOUBLE' for w in ws)})" for c, ws in hybrid.CONTEXT_WEIGHTS.items()
)
REASON_SQL = ", ".join(f"('{s}', '{r[0]}')" for s, r in hybrid.REASONS.items())


def hybrid_sql(requests: str, learned: dict[str, str] | None = None) -> str:
    """SQL of the answers to requests; ``learned`` names other table expressions to learn from, by those of all baskets."""
    learned = learned or {}
    body = renamed(HYBRID_BODY, learned).replace("<requests>", requests)
    return sql("", *[learned.get(n, n) for n in HYBRID_CTES], "branch_of").rstrip() + body


HYBRID_BODY = f"""
, weights(context, association, compatibility, similarity, personalized, trending, branch) AS (VALUES {WEIGHTS_SQL})
, reasons(signal, reason_code) AS (VALUES {REASON_SQL})
, stores AS (SELECT DISTINCT store_id FROM bk)
, asked AS (SELECT r.*, r.branch_id IN (SELECT store_id FROM stores) AS known FROM (<requests>) r)
, req AS (SELECT a.*, w.* EXCLUDE (context) FROM asked a JOIN weights w USING (context)
   WHERE NOT (context = 'CUSTOMER' AND (customer_id IS NULL OR customer_id NOT IN (SELECT customer_id FROM bk)))
     AND NOT (context = 'BRANCH' AND NOT coalesce(known, false))
     AND NOT (context = 'TRENDING' AND branch_id IS NOT NULL AND NOT known))
, ask AS (SELECT *, unnest(product_ids) AS q FROM req)
, rule_hits AS (
   SELECT r.request_id, p.consequent[1] AS product_id, max(p.confidence) AS value FROM ask r
   JOIN (SELECT *, unnest(antecedent) AS item FROM prod_rules WHERE len(consequent) = 1) p ON p.item = r.q
   WHERE r.association > 0 AND len(list_intersect(p.antecedent, r.product_ids)) = len(p.antecedent)
     AND NOT list_contains(r.product_ids, p.consequent[1]) GROUP BY ALL)
, signals AS (
   SELECT request_id, product_id, 'association' AS signal, value FROM (
     SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY value DESC, product_id) AS k FROM rule_hits) WHERE k <= 25
   UNION ALL SELECT request_id, product_id, 'compatibility', raw / max(raw) OVER (PARTITION BY request_id, q) FROM (
     SELECT request_id, q, candidate_id AS product_id, raw, row_number() OVER (PARTITION BY request_id, q ORDER BY raw DESC, candidate_id) AS k
     FROM ask JOIN compat_rank c ON c.product_id = q WHERE compatibility > 0 AND c.rank <= 40 AND NOT list_contains(product_ids, candidate_id)) WHERE k <= 15
   UNION ALL SELECT request_id, product_id, 'similarity', score FROM (
     SELECT request_id, q, neighbour_id AS product_id, score, row_number() OVER (PARTITION BY request_id, q ORDER BY score DESC, neighbour_id) AS k
     FROM ask JOIN sim c ON c.product_id = q WHERE similarity > 0 AND NOT list_contains(product_ids, neighbour_id)) WHERE k <= 15
   UNION ALL SELECT request_id, product_id, 'similarity', score FROM (
     SELECT request_id, q, candidate_id AS product_id, score, row_number() OVER (PARTITION BY request_id, q ORDER BY score DESC, candidate_id) AS k
     FROM ask JOIN content_rank c ON c.product_id = q WHERE similarity > 0 AND c.rank <= 40 AND NOT list_contains(product_ids, candidate_id)) WHERE k <= 15
   UNION ALL SELECT request_id, product_id, 'personalized', score FROM req JOIN personal_lists USING (customer_id)
     WHERE personalized > 0 AND NOT list_contains(product_ids, product_id)
   UNION ALL SELECT request_id, product_id, 'trending', score FROM req JOIN trend_lists l ON l.store_id =
       CASE WHEN known THEN branch_id WHEN branch_id IS NULL OR context NOT IN ('TRENDING', 'BRANCH') THEN '*' END
     WHERE trending > 0 AND NOT list_contains(product_ids, product_id)
   UNION ALL SELECT request_id, product_id, 'branch', score FROM req JOIN pop_lists l ON l.store_id =
       CASE WHEN known THEN branch_id WHEN context NOT IN ('TRENDING', 'BRANCH') THEN '*' END
     WHERE branch > 0 AND NOT list_contains(product_ids, product_id))
, wide AS (SELECT request_id, product_id, {', '.join(f"max(CASE WHEN signal = '{s}' THEN value END) AS s_{s}" for s in hybrid.SIGNALS)}
   FROM signals GROUP BY ALL)
, scored AS (SELECT r.request_id, r.context, product_id,
     least(1.0::DOUBLE, greatest(0.01::DOUBLE, round({' + '.join(f'{s} * coalesce(s_{s}, 0.0::DOUBLE)' for s in hybrid.SIGNALS)}, 4))) AS score,
     CASE WHEN r.branch_id IS NULL THEN 999 ELSE coalesce(stock, 0) END AS stock_quantity,
     CASE WHEN context IN ('PRODUCT', 'CART_READY') THEN coalesce(
       list_max(list_filter([{', '.join(f"CASE WHEN s_{s} > 0 THEN {{'c': {s} * s_{s}, 'o': {-i}, 's': '{s}'}} END" for i, s in enumerate(hybrid.GROUNDED))}], lambda x: x IS NOT NULL)).s, 'similarity')
     ELSE coalesce(list_max(list_filter([{', '.join(f"CASE WHEN s_{s} > 0 THEN {{'c': {s} * s_{s}, 'o': {-i}, 's': '{s}'}} END" for i, s in enumerate(hybrid.SIGNALS))}], lambda x: x IS NOT NULL)).s, 'fallback') END AS signal
   FROM wide JOIN req r USING (request_id) JOIN active USING (product_id)
   LEFT JOIN (SELECT DISTINCT branch_id AS store_id, CAST(l_partkey AS VARCHAR) AS product_id, CAST((l_partkey * 7 + branch_key * 13) % 20 AS INTEGER) AS stock
              FROM lineitem JOIN branch_of ON l_suppkey = s_suppkey) i ON i.store_id = r.branch_id AND i.product_id = wide.product_id
   WHERE (context NOT IN ('PRODUCT', 'CART_READY') OR coalesce(s_association, 0) > 0 OR coalesce(s_compatibility, 0) > 0 OR coalesce(s_similarity, 0) > 0)
     AND (r.branch_id IS NULL OR coalesce(stock, 0) > 0))
SELECT request_id, context, CAST(rank AS INTEGER) AS rank, product_id, score, reason_code, stock_quantity FROM (
SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, product_id) AS rank FROM scored) JOIN reasons USING (signal)
WHERE rank <= 10"""


def product_requests(spark, folder):
    nation = star.table(spark, folder, "nation").select("n_nationkey", F.col("n_name").alias("branch_id"))
    part = star.table(spark, folder, "part").select("p_partkey", (F.col("p_partkey") % 25).cast("int").alias("n_nationkey"))
    return part.join(nation, "n_nationkey", "left").select(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("request_id"), F.lit("PRODUCT").alias("context"),
        F.col("p_partkey").cast("string").alias("product_id"), "branch_id", F.lit(star.ORGANIZATION).alias("organization_id"),
    )


PRODUCT_REQUESTS = """SELECT 'p' || p_partkey AS request_id, 'PRODUCT' AS context, CAST(NULL AS VARCHAR) AS customer_id,
  [CAST(p_partkey AS VARCHAR)] AS product_ids, n_name AS branch_id FROM part LEFT JOIN nation ON n_nationkey = p_partkey % 25"""


def _answers(spark, folder, requests, signals, query_size=1):
    out = hybrid.recommend_batch(
        requests, index(spark, folder, signals, query_size), star.catalog(spark, folder), star.inventory(spark, folder)
    )
    return out.drop("organization_id", "reason", "is_available", "signal_breakdown")


@query("hybrid_recommend_product", hybrid_sql(PRODUCT_REQUESTS))
def hybrid_recommend_product(spark, folder):
    return _answers(spark, folder, product_requests(spark, folder),
                    ("association", "compatibility", "similarity", "trending", "branch"))


def cart_requests(spark, folder):
    """Each customer's latest order as the cart."""
    orders = star.table(spark, folder, "orders")
    latest = orders.groupBy("o_custkey").agg(
        F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("l_orderkey")
    )
    carts = (
        star.table(spark, folder, "lineitem").join(latest, "l_orderkey")
        .groupBy("o_custkey").agg(F.collect_set(F.col("l_partkey").cast("string")).alias("product_ids"))
    )
    customer = star.table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"))
    nation = star.table(spark, folder, "nation").select("n_nationkey", F.col("n_name").alias("branch_id"))
    return carts.join(customer, "o_custkey").join(nation, "n_nationkey").select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("request_id"), F.lit("CART_READY").alias("context"),
        F.col("o_custkey").cast("string").alias("customer_id"), "product_ids", "branch_id",
        F.lit(star.ORGANIZATION).alias("organization_id"),
    )


CART_REQUESTS = """SELECT 'c' || o_custkey AS request_id, 'CART_READY' AS context, CAST(o_custkey AS VARCHAR) AS customer_id,
  product_ids, n_name AS branch_id
FROM (SELECT o_custkey, list_distinct(list(CAST(l_partkey AS VARCHAR))) AS product_ids FROM lineitem JOIN (
        SELECT o_custkey, last(o_orderkey ORDER BY o_orderdate, o_orderkey) AS o FROM orders GROUP BY o_custkey) ON o = l_orderkey GROUP BY o_custkey)
JOIN customer ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey"""


@query("hybrid_recommend_cart", hybrid_sql(CART_REQUESTS))
def hybrid_recommend_cart(spark, folder):
    requests = cart_requests(spark, folder)
    size = requests.agg(F.max(F.size("product_ids"))).first()[0] or 1
    return _answers(spark, folder, requests, hybrid.SIGNALS, size)


@query("hybrid_recommend_customer", hybrid_sql("""
SELECT 'u' || c_custkey AS request_id, 'CUSTOMER' AS context, CAST(c_custkey AS VARCHAR) AS customer_id,
  CAST([] AS VARCHAR[]) AS product_ids, n_name AS branch_id FROM customer JOIN nation ON c_nationkey = n_nationkey"""))
def hybrid_recommend_customer(spark, folder):
    nation = star.table(spark, folder, "nation").select("n_nationkey", F.col("n_name").alias("branch_id"))
    customer = star.table(spark, folder, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    requests = customer.join(nation, "n_nationkey").select(
        F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("request_id"), F.lit("CUSTOMER").alias("context"),
        F.col("c_custkey").cast("string").alias("customer_id"), "branch_id", F.lit(star.ORGANIZATION).alias("organization_id"),
    )
    return _answers(spark, folder, requests, ("personalized", "trending", "branch"))


def place_requests(spark, folder, context):
    """One request per nation and one without a branch."""
    nation = star.table(spark, folder, "nation")
    places = nation.select(F.explode(F.array("n_name", F.when(F.col("n_nationkey") == 0, F.lit("")))).alias("branch_id"))
    return places.where("branch_id is not null").select(
        F.concat(F.lit("b"), "branch_id").alias("request_id"), F.lit(context).alias("context"),
        F.when(F.col("branch_id") != "", F.col("branch_id")).alias("branch_id"), F.lit(star.ORGANIZATION).alias("organization_id"),
    )


def _place_sql(context: str) -> str:
    return f"""SELECT 'b' || branch AS request_id, '{context}' AS context, CAST(NULL AS VARCHAR) AS customer_id,
  CAST([] AS VARCHAR[]) AS product_ids, nullif(branch, '') AS branch_id
FROM (SELECT n_name AS branch FROM nation UNION ALL SELECT '' FROM nation WHERE n_nationkey = 0)"""


def _place_query(name: str, context: str) -> None:
    @query(name, hybrid_sql(_place_sql(context)))
    def run(spark, folder):
        return _answers(spark, folder, place_requests(spark, folder, context), ("trending", "branch"))


_place_query("hybrid_recommend_branch", "BRANCH")
_place_query("hybrid_recommend_trending", "TRENDING")
_place_query("hybrid_recommend_cold_start", "COLD_START")


@query("request_sufficiency", sql("""
SELECT 'u' || c_custkey AS request_id, CASE WHEN CAST(c_custkey AS VARCHAR) IN (SELECT customer_id FROM bk) THEN 'ok'
  ELSE 'Insufficient historical data' END AS status FROM customer
UNION ALL SELECT 'b' || n_name, CASE WHEN n_name IN (SELECT store_id FROM bk) THEN 'ok' ELSE 'Insufficient historical data' END FROM nation
UNION ALL SELECT 'b', 'Insufficient historical data'""", "bk"))
def request_sufficiency(spark, folder):
    customers = star.table(spark, folder, "customer").select(
        F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("request_id"), F.lit("CUSTOMER").alias("context"),
        F.col("c_custkey").cast("string").alias("customer_id"), F.lit(None).cast("string").alias("branch_id"),
        F.lit(star.ORGANIZATION).alias("organization_id"),
    )
    places = place_requests(spark, folder, "BRANCH")
    requests = customers.unionByName(places, allowMissingColumns=True)
    return hybrid.request_status(requests, index(spark, folder, ())).select("request_id", "status")


def _status_sql(context: str, lists: str, anywhere: str) -> str:
    """Status of place requests: a list of the branch, or, where the context allows that, of all branches."""
    return f"""SELECT '{context}' AS context, 'b' || branch AS request_id,
  CASE WHEN (CASE WHEN branch = '' THEN {anywhere} ELSE branch END) IN (SELECT store_id FROM {lists}) THEN 'ok'
       ELSE 'Insufficient historical data' END AS status
FROM (SELECT n_name AS branch FROM nation UNION ALL SELECT '' FROM nation WHERE n_nationkey = 0)"""


@query("answer_status", sql(f"""
{_status_sql("BRANCH", "pop_lists", "'none'")}
UNION ALL {_status_sql("TRENDING", "trend_lists", "'*'")}
UNION ALL {_status_sql("COLD_START", "(SELECT store_id FROM pop_lists UNION ALL SELECT n_name FROM nation)", "'*'")}
UNION ALL SELECT 'CUSTOMER', 'u' || c_custkey, CASE WHEN CAST(c_custkey AS VARCHAR) IN (SELECT customer_id FROM bk) THEN 'ok'
  ELSE 'Insufficient historical data' END FROM customer""", "pop_lists", "trend_lists", "bk"))
def answer_status(spark, folder):
    """Customers, branches, trends and newcomers: whether anything answers them."""
    customers = star.table(spark, folder, "customer").select(
        F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("request_id"), F.lit("CUSTOMER").alias("context"),
        F.col("c_custkey").cast("string").alias("customer_id"), F.lit(None).cast("string").alias("branch_id"),
        F.lit(star.ORGANIZATION).alias("organization_id"),
    )
    places = [place_requests(spark, folder, context) for context in ("BRANCH", "TRENDING", "COLD_START")]
    requests = customers
    for one in places:
        requests = requests.unionByName(one, allowMissingColumns=True)
    # a place asks in three contexts: the context is part of the request's name while it is answered
    asked = requests.withColumn("request_id", F.concat_ws(":", "context", "request_id"))
    found = hybrid.answer_status(asked, index(spark, folder, ("personalized", "trending", "branch")))
    return found.select("context", F.substring_index("request_id", ":", -1).alias("request_id"), "status")


# evaluation: indexes learn from the first 70 % of the days, answers are judged on the baskets after 85 %
cte("basket_parts", """
SELECT max(CASE WHEN p = greatest(1, CAST(floor(n * 0.7) AS INTEGER)) THEN date END) AS train_end,
       max(CASE WHEN p = greatest(2, CAST(floor(n * (0.7 + 0.15)) AS INTEGER)) THEN date END) AS validation_end
FROM (SELECT transaction_date AS date, row_number() OVER (ORDER BY transaction_date) AS p, count(*) OVER () AS n
      FROM (SELECT DISTINCT transaction_date FROM bk))""", "bk")
cte("bk_train", "SELECT bk.* FROM bk, basket_parts WHERE transaction_date <= train_end", "bk", "basket_parts")
cte("bk_test", "SELECT bk.* FROM bk, basket_parts WHERE transaction_date > validation_end", "bk", "basket_parts")
derived_ctes("bk", "bk_train", "_train", "prod_rules", "sim", "personal_lists", "trend_lists", "pop_lists")
LEARNED = {n: f"{n}_train" for n in ("bk", "prod_rules", "sim", "personal_lists", "trend_lists", "pop_lists")}
cte("eval_items", """
SELECT transaction_id || '|' || store_id || '|' || customer_id AS request_id, store_id, product_id FROM bk_test GROUP BY ALL""", "bk_test")
cte("eval_seeds", """
SELECT request_id, min(product_id) AS seed, any_value(store_id) AS store_id FROM eval_items GROUP BY request_id HAVING count(*) >= 2""", "eval_items")
cte("eval_truth", """
SELECT request_id, product_id, seed FROM eval_items JOIN eval_seeds USING (request_id) WHERE product_id <> seed""", "eval_items", "eval_seeds")


def list_recs(lists: str, key: str) -> str:
    return f"""SELECT request_id, product_id, rank FROM (
   SELECT s.request_id, l.product_id, row_number() OVER (PARTITION BY s.request_id ORDER BY l.rank, l.product_id) AS rank
   FROM eval_seeds s JOIN {lists} l ON l.store_id = {key} WHERE l.product_id <> s.seed) WHERE rank <= 10"""


def eval_sql(recs: str) -> str:
    parts = []
    for k in (5, 10):
        hits = f"sum(CASE WHEN rank <= {k} THEN hit ELSE 0 END)"
        dcg = f"sum(CASE WHEN rank <= {k} THEN hit / log2(rank + 1) ELSE 0 END)"
        ideal = f"list_sum(list_transform(generate_series(1, least(n_truth, {k})), lambda i: 1.0 / log2(i + 1)))"
        ap = f"sum(CASE WHEN rank <= {k} AND hit = 1 THEN seen / CAST(rank AS DOUBLE) ELSE 0 END) / least(n_truth, {k})"
        parts.append(f"coalesce({hits}, 0) AS h{k}, coalesce({dcg}, 0) / {ideal} AS n{k}, coalesce({ap}, 0) AS m{k}")
    final = []
    for k in (5, 10):
        final += [f"round(avg(h{k} / {k}.0), 9) AS precision_at_{k}", f"round(avg(h{k} / CAST(n_truth AS DOUBLE)), 9) AS recall_at_{k}",
                  f"round(avg(CASE WHEN h{k} > 0 THEN 1.0 ELSE 0.0 END), 9) AS hit_rate_at_{k}", f"round(avg(n{k}), 9) AS ndcg_at_{k}",
                  f"round(avg(m{k}), 9) AS map_at_{k}"]
    return sql(f"""
, recs AS ({recs})
, marked AS (SELECT r.*, CAST(t.product_id IS NOT NULL AS INTEGER) AS hit, p_type AS cat FROM recs r
   LEFT JOIN eval_truth t USING (request_id, product_id) LEFT JOIN part ON CAST(p_partkey AS VARCHAR) = r.product_id)
, counted AS (SELECT *, sum(hit) OVER (PARTITION BY request_id ORDER BY rank) AS seen FROM marked)
, per AS (SELECT request_id, n_truth, {', '.join(parts)},
   count(DISTINCT CASE WHEN rank <= 5 THEN cat END) / CAST(greatest(1, coalesce(sum(CASE WHEN rank <= 5 THEN 1 END), 0)) AS DOUBLE) AS d
   FROM (SELECT request_id, count(*) AS n_truth FROM eval_truth GROUP BY request_id) LEFT JOIN counted USING (request_id) GROUP BY request_id, n_truth)
SELECT {', '.join(final)}, round(avg(d), 9) AS diversity_score, count(*) AS n_requests,
   round((SELECT count(DISTINCT product_id) FROM recs) / CAST((SELECT count(*) FROM active) AS DOUBLE), 9) AS catalog_coverage FROM per""",
        "eval_truth", "eval_seeds", "trend_lists_train", "pop_lists_train", "active").replace("\n\n, recs", "\n, recs").replace(")\n\n,", ")\n,")


def basket_parts(spark, folder):
    """(training baskets, test baskets, first day after training): both parts are filters on one written table."""
    baskets = settled(lambda: star.baskets(spark, folder), "baskets")
    # the row of cut-offs is one line of two days
    ends = splits.fraction_cutoffs(baskets, column="transaction_date").select(
        F.date_add("train_end", 1).alias("validation_start"), F.date_add("validation_end", 1).alias("test_start")
    ).first()
    train, _, test = splits.chronological_split(baskets, ends.validation_start, ends.test_start, "transaction_date")
    return train, test, ends.validation_start


def _baseline(spark, folder, lists, everywhere):
    train, test, _ = basket_parts(spark, folder)
    requests, truth = evaluation.evaluation_requests(test)
    recs = evaluation.list_recommender(requests, lists(train), 10, everywhere)
    return rounded(evaluation.ranking_metrics(recs, truth, star.catalog(spark, folder)), 9)


def _units(baskets):
    return cut_lineage(popularity.item_units(baskets), "units")


@query("baseline_popular_eval", eval_sql(list_recs("pop_lists_train", "'*'")))
def baseline_popular_eval(spark, folder):
    return _baseline(spark, folder, lambda train: popularity.org_popularity_top(_units(train), 25), True)


@query("baseline_branch_eval", eval_sql(list_recs("pop_lists_train", "s.store_id")))
def baseline_branch_eval(spark, folder):
    return _baseline(spark, folder, lambda train: popularity.branch_popularity_top(_units(train), 25, 20.0), False)


@query("baseline_trending_eval", eval_sql(list_recs("trend_lists_train", "'*'")))
def baseline_trending_eval(spark, folder):
    def trending(train):
        return popularity.trending_top(cut_lineage(popularity.windowed_sales(train), "sales"), 25)

    return _baseline(spark, folder, trending, True)


EVAL_REQUESTS = """SELECT request_id, 'PRODUCT' AS context, any_value(customer_id) AS customer_id, [seed] AS product_ids, any_value(s.store_id) AS branch_id
FROM eval_seeds s JOIN (SELECT DISTINCT transaction_id || '|' || store_id || '|' || customer_id AS request_id, customer_id FROM bk_test) USING (request_id)
GROUP BY request_id, seed"""


@query("ranking_metrics", eval_sql(f"SELECT request_id, product_id, rank FROM (\n{hybrid_sql(EVAL_REQUESTS, LEARNED)}\n)"))
def ranking_metrics(spark, folder):
    """Hybrid PRODUCT answers of an index of the training baskets, judged on the multi-item baskets of the test days."""
    train, test, day = basket_parts(spark, folder)
    requests, truth = evaluation.evaluation_requests(test)
    asked = requests.select(
        "request_id", F.lit("PRODUCT").alias("context"), "product_id", "branch_id", "customer_id",
        F.lit(star.ORGANIZATION).alias("organization_id"),
    )
    learned = hybrid.build_index(
        train, star.customer_preferences(spark, folder, until=day), star.catalog(spark, folder),
        min_support=SUPPORT, min_confidence=CONFIDENCE, min_lift=LIFT,
    )
    answers = hybrid.recommend_batch(asked, learned, star.catalog(spark, folder), star.inventory(spark, folder))
    recs = settled(lambda: answers.select("request_id", "product_id", "rank"), "answers")
    return rounded(evaluation.ranking_metrics(recs, truth, star.catalog(spark, folder)), 9)


@query("substitutes", sql("""
SELECT branch_id, product_id, substitute_id, score FROM (
SELECT o.branch_id, o.product_id, c.candidate_id AS substitute_id, c.score,
       row_number() OVER (PARTITION BY o.branch_id, o.product_id ORDER BY c.score DESC, c.candidate_id) AS k
FROM stock o JOIN content_rank c ON c.product_id = o.product_id
JOIN stock i ON i.branch_id = o.branch_id AND i.product_id = c.candidate_id AND i.stock > 0
JOIN active a ON a.product_id = c.candidate_id
WHERE o.stock = 0) WHERE k = 1""", "content_rank", "active", "stock"))
def substitutes(spark, folder):
    return hybrid.nearest_substitutes(star.catalog(spark, folder), star.inventory(spark, folder)).drop("organization_id")
