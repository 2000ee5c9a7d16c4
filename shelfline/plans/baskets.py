"""Basket statistics, itemsets, rules and similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import baskets as ops
from ..operators import compatibility, content, neighbours, rules
from ..sources import star_schema as star
from . import panels  # noqa: F401 - registers the table expressions read here
from .registry import cte, query, rounded, sql

cte("bk", """
SELECT CAST(l_orderkey AS VARCHAR) AS transaction_id, branch_id AS store_id, CAST(o_custkey AS VARCHAR) AS customer_id,
       CAST(o_orderdate AS DATE) AS transaction_date, l_linenumber AS line_item_id, CAST(l_partkey AS VARCHAR) AS product_id,
       CAST(l_quantity AS INTEGER) AS quantity, l_extendedprice / l_quantity AS unit_price, l_extendedprice AS line_total,
       l_discount >= 0.05 AS is_promo_applied
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN branch_of ON l_suppkey = s_suppkey""", "branch_of")
cte("items", "SELECT DISTINCT transaction_id, product_id FROM bk", "bk")
cte("icount", "SELECT product_id, count(*) AS n FROM items GROUP BY product_id", "items")
cte("pairs", """
SELECT a.product_id AS item_a, b.product_id AS item_b, count(*) AS n
FROM items a JOIN items b ON a.transaction_id = b.transaction_id AND a.product_id < b.product_id GROUP BY ALL""", "items")
cte("sim", """
SELECT x.product_id, x.neighbour_id, n / sqrt(CAST(n_a * n_b AS DOUBLE)) AS score FROM (
  SELECT item_a AS product_id, item_b AS neighbour_id, n FROM pairs WHERE n >= 2
  UNION ALL SELECT item_b, item_a, n FROM pairs WHERE n >= 2) x
JOIN (SELECT product_id, n AS n_a FROM icount) a ON a.product_id = x.product_id
JOIN (SELECT product_id AS neighbour_id, n AS n_b FROM icount) b ON b.neighbour_id = x.neighbour_id""", "pairs", "icount")
cte("brand_items", """
SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS transaction_id, p_brand AS product_id
FROM lineitem JOIN part ON l_partkey = p_partkey""")


def itemset_ctes(prefix: str, items: str, support: float, sizes: int = 4) -> None:
    """Level-wise itemsets in SQL, for the check only."""
    cte(f"{prefix}_n", f"""
SELECT count(DISTINCT transaction_id) AS total, greatest(1, CAST(floor({support} * count(DISTINCT transaction_id)) AS INTEGER)) AS min_count
FROM {items}""", items)
    cte(f"{prefix}_f", f"""
SELECT * FROM {items} WHERE product_id IN (SELECT product_id FROM {items} GROUP BY product_id
HAVING count(*) >= (SELECT min_count FROM {prefix}_n))""", items, f"{prefix}_n")
    levels = []
    for k in range(1, sizes + 1):
        names = [f"t{i}" for i in range(k)]
        joins = " ".join(
            f"JOIN {prefix}_f t{i} ON t{i}.transaction_id = t0.transaction_id AND t{i - 1}.product_id < t{i}.product_id"
            for i in range(1, k)
        )
        listed = ", ".join(f"{n}.product_id" for n in names)
        levels.append(
            f"SELECT [{listed}] AS items, count(*) AS n FROM {prefix}_f t0 {joins} GROUP BY ALL "
            f"HAVING count(*) >= (SELECT min_count FROM {prefix}_n)"
        )
    cte(f"{prefix}_sets", "\nUNION ALL\n".join(levels), f"{prefix}_f", f"{prefix}_n")
    cte(f"{prefix}_sides", f"""
SELECT items, n, mask, list_filter(items, lambda x, i: (mask >> (i - 1)) & 1 = 1) AS antecedent,
       list_filter(items, lambda x, i: (mask >> (i - 1)) & 1 = 0) AS consequent
FROM (SELECT items, n, unnest(generate_series(1, (1 << len(items)) - 2)) AS mask FROM {prefix}_sets WHERE len(items) >= 2)""",
        f"{prefix}_sets")


def rule_cte(prefix: str, confidence: float, lift: float) -> None:
    cte(f"{prefix}_rules", f"""
SELECT antecedent, consequent, s.n / CAST(total AS DOUBLE) AS support, s.n / CAST(a.n AS DOUBLE) AS confidence,
       (s.n / CAST(a.n AS DOUBLE)) / (b.n / CAST(total AS DOUBLE)) AS lift, s.n
FROM {prefix}_sides s JOIN {prefix}_sets a ON a.items = antecedent JOIN {prefix}_sets b ON b.items = consequent, {prefix}_n
WHERE s.n / CAST(a.n AS DOUBLE) >= {confidence} AND (s.n / CAST(a.n AS DOUBLE)) / (b.n / CAST(total AS DOUBLE)) >= {lift}""",
        f"{prefix}_sides", f"{prefix}_sets", f"{prefix}_n")


BRAND_SUPPORT, BRAND_CONFIDENCE, BRAND_LIFT = 0.0015, 0.1, 1.0
itemset_ctes("brand", "brand_items", BRAND_SUPPORT)
rule_cte("brand", BRAND_CONFIDENCE, BRAND_LIFT)


@query("item_frequencies", sql("SELECT * FROM icount", "icount"))
def item_frequencies(spark, folder):
    return ops.item_counts(ops.basket_items(star.baskets(spark, folder)))


@query("pair_counts", sql("SELECT * FROM pairs", "pairs"))
def pair_counts(spark, folder):
    return ops.pair_counts(star.baskets(spark, folder))


@query("top_pairs", sql("SELECT * FROM pairs ORDER BY n DESC, item_a, item_b LIMIT 10", "pairs"))
def top_pairs(spark, folder):
    return ops.top_pairs(star.baskets(spark, folder))


@query("basket_stats", sql("""
SELECT count(*) AS n_baskets, sum(units) / count(*) AS mean_units, median(units) AS median_units,
       CAST(min(units) AS BIGINT) AS min_units, CAST(max(units) AS BIGINT) AS max_units,
       (SELECT count(*) FROM bk) AS n_lines,
       (SELECT avg(CASE WHEN customer_id IS NULL THEN 1.0 ELSE 0.0 END) FROM bk) AS walk_in_share
FROM (SELECT sum(quantity) AS units FROM bk GROUP BY transaction_id)""", "bk"))
def basket_stats(spark, folder):
    return ops.basket_stats(star.baskets(spark, folder))


@query("customer_totals", sql("""
SELECT CAST(c_custkey AS VARCHAR) AS customer_id, coalesce(n, 0) AS total_transactions, coalesce(spend, 0) AS lifetime_spend,
       coalesce(items / n, 0) AS avg_basket_size, day AS last_purchase_date
FROM customer LEFT JOIN (
  SELECT customer_id, count(DISTINCT transaction_id) AS n, CAST(sum(CAST(line_total AS DECIMAL(28,2))) AS DOUBLE) AS spend,
         sum(quantity) AS items, max(transaction_date) AS day FROM bk GROUP BY customer_id)
  ON customer_id = CAST(c_custkey AS VARCHAR)""", "bk"), dates=("last_purchase_date",))
def customer_totals(spark, folder):
    customers = star.table(spark, folder, "customer").select(F.col("c_custkey").cast("string").alias("customer_id"))
    return ops.customer_totals(star.baskets(spark, folder), customers)


@query("top_sold_products", sql("""
SELECT product_id, count(*) AS n FROM bk GROUP BY product_id ORDER BY n DESC, product_id LIMIT 10""", "bk"))
def top_sold_products(spark, folder):
    return ops.value_counts(star.baskets(spark, folder), "product_id", 10)


@query("category_counts", sql("""
SELECT p_type AS category, count(*) AS n FROM bk JOIN part ON CAST(p_partkey AS VARCHAR) = product_id GROUP BY p_type""", "bk"))
def category_counts(spark, folder):
    named = star.baskets(spark, folder).join(
        star.catalog(spark, folder).select("product_id", F.col("category_level_1").alias("category")), "product_id"
    )
    return ops.value_counts(named, "category")


@query("entity_counts", """
SELECT 'products' AS entity, count(*) AS n_rows FROM part UNION ALL SELECT 'customers', count(*) FROM customer
UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'lines', count(*) FROM lineitem""")
def entity_counts(spark, folder):
    t = lambda n: star.table(spark, folder, n)
    return ops.entity_counts(products=t("part"), customers=t("customer"), orders=t("orders"), lines=t("lineitem"))


@query("item_similarity", sql("SELECT * FROM sim", "sim"))
def item_similarity(spark, folder):
    return neighbours.item_similarity(star.baskets(spark, folder))


cte("sim_rank", """
SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY score DESC, neighbour_id) AS rank FROM sim""", "sim")


@query("item_neighbors_topk", sql("SELECT * REPLACE (CAST(rank AS INTEGER) AS rank) FROM sim_rank WHERE rank <= 10", "sim_rank"))
def item_neighbors_topk(spark, folder):
    return neighbours.top_k(neighbours.item_similarity(star.baskets(spark, folder)), ["product_id"], "neighbour_id", 10)


def brand_itemsets(spark, folder):
    return rules.frequent_itemsets(star.brand_baskets(spark, folder), BRAND_SUPPORT)


@query("frequent_itemsets", sql("""
SELECT array_to_string(items, ',') AS items, n, CAST(len(items) AS INTEGER) AS size, n / CAST(total AS DOUBLE) AS support
FROM brand_sets, brand_n""", "brand_sets"))
def frequent_itemsets(spark, folder):
    return brand_itemsets(spark, folder).withColumn("items", F.array_join("items", ","))


@query("association_rules", sql("""
SELECT array_to_string(antecedent, ',') AS antecedent, array_to_string(consequent, ',') AS consequent, support, confidence, lift, n
FROM brand_rules""", "brand_rules"))
def association_rules(spark, folder):
    found = rules.association_rules(brand_itemsets(spark, folder), BRAND_CONFIDENCE, BRAND_LIFT)
    return found.withColumns({c: F.array_join(c, ",") for c in ("antecedent", "consequent")})


@query("rule_recommendations", sql("""
SELECT request_id, product_id, score, CAST(rank AS INTEGER) AS rank FROM (
SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, product_id) AS rank FROM (
SELECT m.request_id, m.product_id, max(confidence) AS score FROM (
  SELECT i.transaction_id AS request_id, r.product_id, r.confidence
  FROM (SELECT rid, unnest(antecedent) AS item, len(antecedent) AS size, product_id, confidence FROM (
          SELECT row_number() OVER () AS rid, antecedent, consequent[1] AS product_id, confidence FROM brand_rules WHERE len(consequent) = 1)) r
  JOIN brand_items i ON i.product_id = r.item
  GROUP BY i.transaction_id, r.rid, r.product_id, r.confidence, r.size HAVING count(*) = r.size) m
ANTI JOIN brand_items x ON x.transaction_id = m.request_id AND x.product_id = m.product_id
GROUP BY m.request_id, m.product_id)) WHERE rank <= 5""", "brand_rules", "brand_items"))
def rule_recommendations(spark, folder):
    found = rules.association_rules(brand_itemsets(spark, folder), BRAND_CONFIDENCE, BRAND_LIFT)
    # an order holds at most as many distinct brands as there are brands
    requests = (
        star.brand_baskets(spark, folder)
        .groupBy(F.col("transaction_id").alias("request_id"))
        .agg(F.collect_set("product_id").alias("product_ids"))
    )
    return rules.recommend_by_rules(requests, found, 5)


cte("docs", r"""
SELECT CAST(p_partkey AS VARCHAR) AS product_id, lower(concat_ws(' ', 'cat1_' || replace(p_type, ' ', '_'), 'brand_' || replace(p_brand, ' ', '_'),
  'price_' || CASE WHEN p_retailprice < 15 THEN 'tier_budget' WHEN p_retailprice < 75 THEN 'tier_everyday'
     WHEN p_retailprice < 300 THEN 'tier_midrange' WHEN p_retailprice < 900 THEN 'tier_premium' ELSE 'tier_flagship' END,
  array_to_string(list_transform(string_split(p_name, ' '), lambda t: 'tag_' || t), ' '),
  array_to_string(list_filter(string_split(p_name, ' '), lambda w: len(w) > 2), ' '),
  'spec_size_' || p_size)) AS document FROM part""")
cte("tf", r"""
SELECT product_id, term, count(*) AS tf FROM (
SELECT product_id, unnest(regexp_extract_all(document, '\b[\w.-]+\b')) AS term FROM docs) GROUP BY ALL""", "docs")
cte("idf", """
SELECT term, count(*) AS df, ln((1 + (SELECT count(*) FROM docs)) / CAST(1 + count(*) AS DOUBLE)) + 1 AS idf FROM tf GROUP BY term""", "tf", "docs")
cte("tfidf", """
SELECT product_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY product_id)) AS w
FROM (SELECT product_id, term, (1 + ln(tf)) * idf AS w FROM tf JOIN idf USING (term))""", "tf", "idf")
cte("content_rank", """
SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY score DESC, candidate_id) AS rank FROM (
SELECT a.product_id, b.product_id AS candidate_id, round(sum(a.w * b.w), 9) AS score
FROM tfidf a JOIN tfidf b ON a.term = b.term AND a.product_id <> b.product_id GROUP BY ALL)""", "tfidf")
cte("tags", """
SELECT product_id, tag, CASE WHEN tag IN ('usb_c', 'bluetooth', 'wireless') THEN 0.5
  WHEN starts_with(tag, 'socket_') OR tag IN ('magsafe', 'ddr5', 'hdmi21', 'nvme') THEN 2.0 ELSE 1.0 END AS w
FROM (SELECT DISTINCT CAST(p_partkey AS VARCHAR) AS product_id, lower(trim(unnest(string_split(p_name, ' ')))) AS tag FROM part)
WHERE tag NOT IN ('', 'staple', 'beverage', 'supermarket', 'general')""")
cte("compat_rank", """
SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY raw DESC, candidate_id) AS rank FROM (
SELECT a.product_id, b.product_id AS candidate_id, sum(a.w) AS raw
FROM tags a JOIN tags b ON a.tag = b.tag AND a.product_id <> b.product_id GROUP BY ALL)""", "tags")


@query("tfidf_vocabulary", sql("SELECT term, df, round(idf, 9) AS idf FROM idf", "idf"))
def tfidf_vocabulary(spark, folder):
    terms = content.vocabulary(content.documents(star.catalog(spark, folder)))
    return rounded(terms.withColumn("df", F.col("df").cast("long")), 9)


@query("product_documents", sql("SELECT * FROM docs", "docs"))
def product_documents(spark, folder):
    return content.documents(star.catalog(spark, folder))


@query("content_neighbors_topk", sql("""
SELECT product_id, candidate_id, score, CAST(rank AS INTEGER) AS rank FROM content_rank WHERE rank <= 10""", "content_rank"))
def content_neighbors_topk(spark, folder):
    return content.content_neighbours(star.catalog(spark, folder), 10)


@query("tag_compatibility", sql("""
SELECT product_id, candidate_id, CAST(raw / max(raw) OVER (PARTITION BY product_id) AS DOUBLE) AS score, CAST(rank AS INTEGER) AS rank
FROM compat_rank WHERE rank <= 10""", "compat_rank"))
def tag_compatibility(spark, folder):
    return compatibility.normalised(compatibility.compatible_products(star.catalog(spark, folder), 10), ["product_id"])


@query("unseen_product_neighbors", sql("""
SELECT request_id, candidate_id, score, CAST(rank AS INTEGER) AS rank FROM (
SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, candidate_id) AS rank FROM (
SELECT q.request_id, c.product_id AS candidate_id, round(sum(q.w * c.w), 9) AS score FROM (
  SELECT request_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY request_id)) AS w FROM (
    SELECT request_id, term, (1 + ln(count(*))) * idf AS w FROM (
      SELECT CAST(doc_id AS VARCHAR) AS request_id, unnest(regexp_extract_all(lower(text), '\\b[\\w.-]+\\b')) AS term FROM documents)
    JOIN idf USING (term) GROUP BY request_id, term, idf)) q
JOIN tfidf c ON c.term = q.term GROUP BY ALL) WHERE score > 0) WHERE rank <= 10""", "tfidf", "idf"))
def unseen_product_neighbors(spark, folder):
    texts = star.table(spark, folder, "documents").select(F.col("doc_id").alias("request_id"), F.col("text").alias("document"))
    return content.similar_to_documents(texts, star.catalog(spark, folder), 10)
