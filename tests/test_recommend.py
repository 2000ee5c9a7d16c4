"""Recommendation operators: literal cases and brute force, with hot groups."""

import itertools
import math
import os
import random
from collections import Counter, defaultdict
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfline import session
from shelfline.operators import (
    baskets, compatibility, content, evaluation, hybrid, neighbours, overlap, personal, popularity, rules,
)
from shelfline.session import cut_lineage, settled

D = date(2026, 1, 1)


def basket_frame(spark, sets):
    data = [(t, p) for t, items in sets.items() for p in items]
    return spark.createDataFrame(data, "transaction_id string, product_id string")


def test_association_literal(spark):
    sets = {"T1": "ABC", "T2": "AB", "T3": "ABD", "T4": "BC", "T5": "AD", "T6": "AB"}
    df = basket_frame(spark, sets)
    itemsets = rules.frequent_itemsets(df.unionByName(df.limit(1)), 0.25)  # a repeated line is one item
    assert itemsets.count() == 11
    found = rules.association_rules(itemsets, 0.4, 0.8)
    rule = found.where((F.col("antecedent") == F.array(F.lit("A"))) & (F.col("consequent") == F.array(F.lit("B")))).first()
    assert rule.confidence == pytest.approx(0.8) and rule.lift == pytest.approx(0.96)
    asked = spark.createDataFrame([("r", ["A"])], "request_id string, product_ids array<string>")
    got = [r.product_id for r in rules.recommend_by_rules(asked, found, 10).orderBy("rank").collect()]
    assert got[0] == "B" and "A" not in got


def test_rules_match_brute_force(spark):
    rng = random.Random(5)
    sets = {f"t{i}": set(rng.choices("ABCDEFG", [9, 5, 4, 3, 2, 1, 1], k=5)) for i in range(80)}
    total, least = len(sets), math.floor(0.06 * 80)
    counts = Counter(c for s in sets.values() for k in range(1, 6) for c in itertools.combinations(sorted(s), k))
    frequent = {c: n for c, n in counts.items() if n >= least}
    itemsets = rules.frequent_itemsets(basket_frame(spark, sets), 0.06)
    assert {tuple(r["items"]): r.n for r in itemsets.collect()} == frequent
    want = {}
    for c, n in frequent.items():
        for k in range(1, len(c)):
            for a in itertools.combinations(c, k):
                b = tuple(x for x in c if x not in a)
                confidence = n / frequent[a]
                if confidence >= 0.3 and confidence / (frequent[b] / total) >= 1.0:
                    want[(a, b)] = confidence
    got = {(tuple(r.antecedent), tuple(r.consequent)): r.confidence for r in rules.association_rules(itemsets, 0.3, 1.0).collect()}
    assert got == pytest.approx(want)
    asked = {"q1": ["A", "B"], "q2": ["C", "D", "E"], "q3": ["G"]}
    best = defaultdict(dict)
    for q, items in asked.items():
        for (a, b), confidence in want.items():
            if len(b) == 1 and set(a) <= set(items) and b[0] not in items:
                best[q][b[0]] = max(best[q].get(b[0], 0), confidence)
    frame = spark.createDataFrame(list(asked.items()), "request_id string, product_ids array<string>")
    found = rules.recommend_by_rules(frame, rules.association_rules(itemsets, 0.3, 1.0), 50).collect()
    assert {(r.request_id, r.product_id): r.score for r in found} == pytest.approx({(q, p): s for q, d in best.items() for p, s in d.items()})


def test_pairs_of_a_huge_basket(spark, monkeypatch):
    """One basket far beyond the chunk size holds most of the rows; counts stay exact."""
    monkeypatch.setattr(baskets, "CHUNK", 4)
    rng = random.Random(1)
    sets = {"huge": {f"p{i:03d}" for i in range(40)}}
    sets |= {f"t{i}": {f"p{rng.randrange(50):03d}" for _ in range(4)} for i in range(30)}
    want = Counter(c for s in sets.values() for c in itertools.combinations(sorted(s), 2))
    got = {(r.item_a, r.item_b): r.n for r in baskets.pair_counts(basket_frame(spark, sets)).collect()}
    assert got == dict(want)
    got = {(r.item_a, r.item_b): r.n for r in baskets.pair_counts(basket_frame(spark, sets), 3).collect()}
    assert got == {k: n for k, n in want.items() if n >= 3}


def test_item_similarity_literal(spark):
    df = basket_frame(spark, {"T1": ["P1", "P2"], "T2": ["P1", "P2"], "T3": ["P1", "P3"], "T4": ["P2", "P3"]})
    got = {(r.product_id, r.neighbour_id): r.score for r in neighbours.item_similarity(df, 1).collect()}
    assert got["P1", "P2"] == got["P2", "P1"] == pytest.approx(2 / 3) and ("P1", "P1") not in got


CATALOG = "product_id string, organization_id string, name string, category_level_1 string, brand string, current_unit_price double, specifications_json string, compatibility_tags array<string>, is_active boolean"


def catalog_frame(spark, *rows):
    return spark.createDataFrame([(p, "org", n, c, b, x, s, t, a) for p, n, c, b, x, s, t, a in rows], CATALOG)


def test_content_literal_and_spec_tokens(spark):
    df = catalog_frame(
        spark,
        ("L1", "Pro Laptop 14", "Computers", "Acme", 1500.0, '{"ram": "16 GB", "ports": ["usb c", "hdmi"], "x": null, "n": {"a": 1}}', ["usb_c"], True),
        ("L2", "Air Laptop 13", "Computers", "Acme", 1100.0, '{"ram": "16 GB", "ports": ["usb c"]}', ["usb_c"], True),
        ("C1", "Ground Coffee", "Groceries", "Bean", 8.0, "not json", ["beverage"], True),
    )
    got = content.content_neighbours(df, 2).where("product_id = 'L1'").orderBy("rank").collect()
    assert [r.candidate_id for r in got] == ["L2", "C1"] and got[0].score > got[1].score
    text = {r.product_id: r.document for r in content.documents(df).collect()}
    assert "spec_ram_16_gb spec_ports_usb_c spec_ports_hdmi" in text["L1"] and "spec_n" not in text["L1"]
    assert text["C1"] == "cat1_groceries brand_bean price_tier_budget tag_beverage ground coffee"


def test_content_matches_brute_force(spark):
    """Many copies of one document next to distinct ones, tiles far smaller than the data."""
    rng = random.Random(2)
    words = [f"word{i}" for i in range(12)]
    rows = [(f"p{i:03d}", "same old thing", "Toys", "B", 10.0, None, None, True) for i in range(25)]
    rows += [(f"q{i:03d}", " ".join(rng.choices(words, k=4)), rng.choice(["Toys", "Books"]), rng.choice("BC"), 10.0, None, None, True) for i in range(35)]
    df = catalog_frame(spark, *rows)
    docs = {r.product_id: r.document.lower().split() for r in content.documents(df).collect()}
    n = len(docs)
    dfs = Counter(t for d in docs.values() for t in set(d))
    vec = {}
    for p, d in docs.items():
        w = {t: (1 + math.log(c)) * (math.log((1 + n) / (1 + dfs[t])) + 1) for t, c in Counter(d).items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        vec[p] = {t: x / norm for t, x in w.items()}
    for tile in (3, 1024):
        got = defaultdict(list)
        for r in content.content_neighbours(df, 5, tile=tile).orderBy("product_id", "rank").collect():
            got[r.product_id].append((r.candidate_id, r.score))
        for p in docs:
            scores = {o: round(sum(x * vec[o].get(t, 0) for t, x in vec[p].items()), 7) for o in docs if o != p}
            want = sorted(scores, key=lambda o: (-scores[o], o))[:5]
            assert [c for c, _ in got[p]] == want


def test_unseen_document_uses_known_words_only(spark):
    df = catalog_frame(spark, ("L1", "Pro Laptop", "Computers", "Acme", 1500.0, None, None, True), ("C1", "Ground Coffee", "Groceries", "Bean", 8.0, None, None, True))
    asked = spark.createDataFrame([("r", "laptop unheard"), ("s", "nothing known")], "request_id string, document string")
    got = [(r.request_id, r.candidate_id) for r in content.similar_to_documents(asked, df, 5).collect()]
    assert got == [("r", "L1")]


def test_compatibility_literal(spark):
    tags = {"CPU": ["cpu", "socket_lga1700", "ddr5"], "BOARD": ["board", "Socket_LGA1700 ", "ddr5"], "RAM": ["ram", "ddr5"],
            "PHONE": ["magsafe", "staple"], "CASE": ["magsafe", "staple"], "MILK": ["staple"]}
    df = catalog_frame(spark, *[(p, p, "c", "b", 1.0, None, t, True) for p, t in tags.items()])
    got = defaultdict(dict)
    for r in compatibility.normalised(compatibility.compatible_products(df, 10), ["product_id"]).collect():
        got[r.product_id][r.candidate_id] = r.score
    assert got["CPU"] == {"BOARD": 1.0, "RAM": 0.5} and got["PHONE"] == {"CASE": 1.0} and "MILK" not in got


def test_overlap_padding_and_ties(spark):
    df = spark.createDataFrame([(f"p{i}", ["x"] if i < 3 else ["y"], [1.0]) for i in range(6)], "profile_id string, tokens array<string>, weights array<double>")
    got = overlap.top_profiles(df, df, 5, keep_zero=True, tile=2).where("query_id = 'p4'").orderBy("rank").collect()
    assert [r.profile_id for r in got] == ["p3", "p4", "p5", "p0", "p1"]


def test_pruned_overlap_with_a_hot_token(spark):
    """A token that all share, ties by the dozen, weights that are not normalised, more candidates than queries."""
    rng = random.Random(12)
    vectors = {}
    for i in range(150):
        own = {t: rng.choice([0.5, 1.0, 2.0]) for t in rng.sample([f"t{j}" for j in range(30)], rng.randrange(4))}
        vectors[f"p{i:03d}"] = {"hot": 1.0, **own}
    vectors["p900"] = {"alone": 1.0}
    frame = spark.createDataFrame([(p, list(v), list(v.values())) for p, v in vectors.items()], "profile_id string, tokens array<string>, weights array<double>")
    asks = frame.where("profile_id >= 'p100'")
    for k, tile, zero in ((1, 4, False), (7, 16, True), (200, 1024, True)):
        got = defaultdict(list)
        for r in overlap.top_profiles(asks, frame, k, keep_zero=zero, tile=tile).orderBy("query_id", "rank").collect():
            got[r.query_id].append((r.profile_id, r.score))
        for q in [p for p in vectors if p >= "p100"]:
            scores = {p: round(sum(w * v.get(t, 0.0) for t, w in vectors[q].items()), 9) for p, v in vectors.items()}
            want = [(p, scores[p]) for p in sorted(scores, key=lambda p: (-scores[p], p)) if zero or scores[p] > 0][:k]
            assert got[q] == want, (q, k)
    assert overlap.top_profiles(asks.limit(0), frame, 3, keep_zero=True).collect() == []
    assert overlap.top_profiles(asks, frame.limit(0), 3, keep_zero=True).collect() == []


def sale_frame(spark, rows):
    return spark.createDataFrame(rows, "store_id string, product_id string, quantity int, transaction_date string").withColumn("transaction_date", F.to_date("transaction_date"))


def test_trending_literal(spark):
    rows = [("S", "SURGE", 10, "2014-11-14"), ("S", "SURGE", 10, "2014-11-15"), ("S", "FUTURE", 99, "2014-12-01")]
    rows += [("S", "STABLE", 2, d) for d in ("2014-10-25", "2014-11-05", "2014-11-15")]
    sales = popularity.windowed_sales(sale_frame(spark, rows), "2014-11-15")
    assert [r.product_id for r in popularity.trending_top(sales, 5).orderBy("rank").collect()] == ["SURGE", "STABLE"]


def test_popularity_literal(spark):
    rows = [("B_HIGH", "LOCAL_FAV", 10, "2014-01-01"), ("B_HIGH", "GLOBAL", 5, "2014-01-01"), ("B_LOW", "RARE", 1, "2014-01-01"), ("B_OTHER", "GLOBAL", 50, "2014-01-01")]
    top = popularity.branch_popularity_top(popularity.item_units(sale_frame(spark, rows)), 2, 2.0)
    got = {(r.store_id, r.rank): r.product_id for r in top.collect()}
    assert got["B_HIGH", 1] == "LOCAL_FAV" and "GLOBAL" in (got["B_LOW", 1], got["B_LOW", 2])


def test_branch_lists_match_brute_force(spark):
    """One branch holds most sales, one sold a single product: unsold products still rank."""
    rng = random.Random(8)
    rows = [("hot", f"p{rng.randrange(12):02d}", rng.randrange(1, 5), f"2020-03-{rng.randrange(1, 29):02d}") for _ in range(150)]
    rows += [("cold", "p03", 2, "2020-03-28"), ("mid", "p11", 1, "2020-03-01"), ("mid", "p20", 3, "2020-03-27")]
    frame = sale_frame(spark, rows)
    products, stores = sorted({r[1] for r in rows}), sorted({r[0] for r in rows})
    top = popularity.branch_trending_top(popularity.windowed_sales(frame, "2020-03-28"), 6)
    got = defaultdict(list)
    for r in top.orderBy("store_id", "rank").collect():
        got[r.store_id].append((r.product_id, round(r.score, 9)))
    for s in stores:
        v = {}
        for p in products:
            short = sum(q for a, b, q, d in rows if (a, b) == (s, p) and d > "2020-03-21")
            long = sum(q for a, b, q, d in rows if (a, b) == (s, p))
            v[p] = (short / 7 + 0.1) / (long / 30 + 0.1)
        low, span = min(v.values()), max(1e-5, max(v.values()) - min(v.values()))
        want = sorted(((p, round((x - low) / span, 9)) for p, x in v.items()), key=lambda e: (-e[1], e[0]))[:6]
        assert got[s] == want
    top = popularity.branch_popularity_top(popularity.item_units(frame), 6, 5.0)
    got = defaultdict(list)
    for r in top.orderBy("store_id", "rank").collect():
        got[r.store_id].append((r.product_id, round(r.score, 9)))
    n = Counter()
    for a, b, q, _ in rows:
        n[b] += q
    total = sum(n.values())
    for s in stores:
        mine = Counter()
        for a, b, q, _ in rows:
            if a == s:
                mine[b] += q
        raw = {p: (mine[p] + 5.0 * n[p] / total) / (sum(mine.values()) + 5.0) for p in products}
        want = sorted(raw, key=lambda p: (-raw[p], p))[:6]
        assert got[s] == [(p, round(raw[p] / max(raw.values()), 9)) for p in want]


def test_personal_matches_brute_force(spark):
    rng = random.Random(4)
    cats, brands = ["A", "B"], ["x", "y", "z"]
    items = {f"p{i:02d}": (rng.choice(cats), rng.choice(brands), rng.random() > 0.1) for i in range(40)}
    catalog = catalog_frame(spark, *[(p, p, c, b, 1.0, None, None, a) for p, (c, b, a) in items.items()])
    customers = {f"c{i}": (rng.sample(cats, 1), rng.sample(brands, rng.randrange(0, 3))) for i in range(8)} | {"big": (["A"], ["x"]), "new": ([], [])}
    prefs = spark.createDataFrame([(c, *p) for c, p in customers.items()], "customer_id string, preferred_categories array<string>, affinity_brands array<string>")
    bought = [(f"t{i}", rng.choice(list(customers)[:8]), p, rng.randrange(1, 4)) for i in range(25) for p in rng.sample(list(items), 3)]
    bought += [("tb", "big", p, 1) for p in list(items)[:30]]  # owns most of every list
    frame = spark.createDataFrame(bought, "transaction_id string, customer_id string, product_id string, quantity int")
    similar = neighbours.item_similarity(frame, 1)
    near = defaultdict(list)
    for r in similar.collect():
        near[r.product_id].append((-r.score, r.neighbour_id))
    got = defaultdict(dict)
    for r in personal.personal_top(frame, prefs, catalog, similar, 5).collect():
        got[r.customer_id][r.product_id] = r.score
    for c, (pc, pb) in customers.items():
        own = Counter()
        for _, who, p, q in bought:
            if who == c:
                own[p] += q
        score = defaultdict(float)
        for p, q in own.items():
            for s, other in sorted(near[p])[:8]:
                if items[other][2] and other not in own:
                    score[other] += q / sum(own.values()) * -s * 2
        score = defaultdict(float, {p: round(s, 9) for p, s in score.items()})
        for p, (cat, brand, active) in items.items():
            boost = 0.5 * (cat in pc) + 0.5 * (brand in pb)
            if active and p not in own and boost:
                score[p] += boost
        best = sorted(score, key=lambda p: (-score[p], p))[:5]
        want = {p: score[p] / score[best[0]] for p in best}
        assert got.get(c, {}) == pytest.approx(want), c


@pytest.fixture(scope="module")
def shop(spark):
    """Three baskets around a queried product; one neighbour in stock, one out, one inactive."""
    rows = []
    for i in range(3):
        for p in ("P_QUERY", ("P_IN", "P_OUT", "P_OFF")[i], "P_IN"):
            rows.append((f"t{i}", "org", "B1", "CUST-1", "2020-01-0%d" % (i + 1), p, 1))
    frame = spark.createDataFrame(rows, "transaction_id string, organization_id string, store_id string, customer_id string, transaction_date string, product_id string, quantity int")
    frame = frame.withColumn("transaction_date", F.to_date("transaction_date"))
    catalog = catalog_frame(spark, *[(p, p, "Cat", "Brand", 10.0, None, [], p != "P_OFF") for p in ("P_QUERY", "P_IN", "P_OUT", "P_OFF")])
    # another tenant has a branch of the same code, and other stock there
    stock = spark.createDataFrame(
        [("org", "B1", "P_IN", 10, True), ("org", "B1", "P_OUT", 0, False), ("org", "B1", "P_QUERY", 5, True),
         ("other", "B1", "P_IN", 3, True), ("other", "B1", "P_OUT", 8, True), ("other", "B2", "P_IN", 1, True)],
        "organization_id string, branch_id string, product_id string, stock_quantity int, is_available boolean")
    customers = spark.createDataFrame([("CUST-1", [], [])], "customer_id string, preferred_categories array<string>, affinity_brands array<string>")
    return hybrid.build_index(frame, customers, catalog, min_support=0.1, min_confidence=0.1), catalog, stock


REQUEST = "request_id string, context string, customer_id string, product_id string, branch_id string, organization_id string"


def ask(spark, shop, *rows):
    index, catalog, stock = shop
    frame = spark.createDataFrame(list(rows), REQUEST)
    return hybrid.request_status(frame, index), hybrid.recommend_batch(frame, index, catalog, stock)


def test_stock_policy_reason_and_tenant(spark, shop):
    _, got = ask(
        spark, shop,
        ("here", "PRODUCT", None, "P_QUERY", "B1", "org"),
        ("foreign", "PRODUCT", None, "P_QUERY", "B1", "other"),
        ("anywhere", "PRODUCT", None, "P_QUERY", None, "org"),
    )
    found = defaultdict(list)
    for r in got.orderBy("request_id", "rank").collect():
        found[r.request_id].append(r)
    assert [r.product_id for r in found["here"]] == ["P_IN"] and "foreign" not in found
    best = found["here"][0]
    assert best.reason_code == "FREQUENTLY_BOUGHT_TOGETHER" and best.stock_quantity == 10
    assert best.signal_breakdown["association"] == 1.0 and 0.01 <= best.score <= 1.0
    assert {r.product_id for r in found["anywhere"]} == {"P_IN", "P_OUT"} and found["anywhere"][0].stock_quantity == 999


def test_sufficiency(spark, shop):
    status, got = ask(
        spark, shop,
        ("known", "CUSTOMER", "CUST-1", None, None, "org"), ("unknown", "CUSTOMER", "CUST-9", None, None, "org"),
        ("branch", "BRANCH", None, None, "B9", "org"), ("trend", "TRENDING", None, None, "B9", "org"),
        ("cold", "COLD_START", None, None, None, "org"), ("popular", "POPULAR", None, None, None, "org"),
    )
    marks = {r.request_id: r.status for r in status.collect()}
    assert {k for k, v in marks.items() if v != "ok"} == {"unknown", "branch", "trend"}
    lists = defaultdict(list)
    for r in got.orderBy("request_id", "rank").collect():
        lists[r.request_id].append((r.product_id, r.score))
    assert lists["cold"] == lists["popular"] and lists["cold"]


def test_status_after_candidates(spark, shop):
    index, _, _ = shop
    asked = [("known", "CUSTOMER", "CUST-1", None, None, "org"), ("unknown", "CUSTOMER", "CUST-9", None, None, "org"),
             ("about", "PRODUCT", None, "P_QUERY", "B1", "org"), ("nothing", "PRODUCT", None, "P_NONE", "B1", "org"),
             ("no_cart", "CART_READY", None, None, "B1", "org"), ("cold", "COLD_START", None, None, None, "org"),
             ("branch", "BRANCH", None, None, "B1", "org"), ("no_branch", "BRANCH", None, None, None, "org")]
    frame = spark.createDataFrame(asked, REQUEST)
    got = {r.request_id: r for r in hybrid.answer_status(frame, index).collect()}
    assert len(got) == len(asked)
    assert {k: r.status for k, r in got.items() if r.status != "ok"} == {
        "unknown": hybrid.INSUFFICIENT, "no_branch": hybrid.INSUFFICIENT, "nothing": "empty", "no_cart": "empty"}
    assert all((r.n_candidates > 0) == (r.status == "ok") for r in got.values())
    with pytest.raises(ValueError, match="2 requests"):
        hybrid.answer_status(frame, index, strict=True)
    assert hybrid.answer_status(frame.where("request_id in ('cold', 'nothing')"), index, strict=True).count() == 2


def test_serve_enriches_and_ignores_unknown_branches(spark, shop):
    index, catalog, stock = shop
    frame = spark.createDataFrame([("r", "PRODUCT", None, "P_QUERY", "NOWHERE", "org")], REQUEST)
    row = hybrid.serve(frame, index, catalog, stock).orderBy("rank").first()
    assert row.stock_quantity == 999 and row.category == "Cat" and row.price == 10.0


def test_tenants_with_equal_codes_stay_apart(spark, shop):
    index, catalog, stock = shop
    both = catalog.union(catalog.withColumns({"organization_id": F.lit("other"), "name": F.lit("theirs")}).select(*catalog.columns))
    frame = spark.createDataFrame(
        [("r", "PRODUCT", None, "P_QUERY", "B1", "org"), ("s", "PRODUCT", None, "P_QUERY", "B2", "org")], REQUEST)
    rows = hybrid.serve(frame, index, both, stock).orderBy("request_id", "rank").collect()
    # one row a product; the branch that only the other tenant has counts as none
    assert [(r.request_id, r.product_id, r.name, r.stock_quantity) for r in rows if r.request_id == "r"] == [("r", "P_IN", "P_IN", 10)]
    assert {(r.product_id, r.name, r.stock_quantity) for r in rows if r.request_id == "s"} == {
        ("P_IN", "P_IN", 999), ("P_OUT", "P_OUT", 999)}
    near = spark.createDataFrame([("P_OUT", "P_IN", 0.5)], "product_id string, candidate_id string, score double")
    found = hybrid.substitutes(near, both, stock.where("not (organization_id = 'org' and product_id = 'P_IN')"))
    assert found.isEmpty()  # the only stock of the substitute is the other tenant's
    assert [tuple(r)[:4] for r in hybrid.substitutes(near, both, stock).collect()] == [("org", "B1", "P_OUT", "P_IN")]


def test_index_survives_saving(spark, shop, tmp_path):
    index, catalog, stock = shop
    hybrid.save(index, str(tmp_path))
    frame = spark.createDataFrame([("r", "PRODUCT", None, "P_QUERY", "B1", "org")], REQUEST)
    again = hybrid.load(spark, str(tmp_path))
    assert hybrid.recommend_batch(frame, again, catalog, stock).count() == hybrid.recommend_batch(frame, index, catalog, stock).count() == 1


def test_ranking_metrics_literal(spark):
    catalog = catalog_frame(spark, *[(p, p, "c", "b", 1.0, None, None, True) for p in ("P1", "P2", "P3")])
    frame = spark.createDataFrame([("t", "S", "C", "P1"), ("t", "S", "C", "P2"), ("u", "S", "C", "P1")], "transaction_id string, store_id string, customer_id string, product_id string")
    requests, truth = evaluation.evaluation_requests(frame)
    assert [(r.product_id,) for r in requests.collect()] == [("P1",)]
    rec = requests.select("request_id").join(spark.createDataFrame([("P2", 1), ("P3", 2)], "product_id string, rank int"))
    row = evaluation.ranking_metrics(rec, truth, catalog).first()
    assert (row.hit_rate_at_5, row.precision_at_5, row.recall_at_5, row.ndcg_at_5) == (1.0, 0.2, 1.0, 1.0)
    assert row.catalog_coverage == pytest.approx(2 / 3) and row.diversity_score == 0.5


def test_substitute_far_down_the_list(spark):
    """The nearest 14 products are out of stock; one branch has only a distant product, one has nothing alike."""
    rows = [(f"L{i:02d}", f"Laptop model{i}", "Computers", "Acme", 1500.0, None, None, True) for i in range(15)]
    rows += [("M", "Mouse laptop", "Parts", "Other", 9.0, None, None, True), ("X", "Sugar", "Food", "Sweet", 40.0, None, None, True),
             ("OFF", "Laptop model0", "Computers", "Acme", 1500.0, None, None, False)]
    stock = [("org", "B1", r[0], 0, True) for r in rows[:15]] + [("org", "B1", "M", 3, True), ("org", "B1", "OFF", 3, True), ("org", "B2", "L00", 0, True), ("org", "B2", "X", 5, True)]
    inventory = spark.createDataFrame(stock, "organization_id string, branch_id string, product_id string, stock_quantity int, is_available boolean")
    got = {(r.branch_id, r.product_id): r.substitute_id for r in hybrid.nearest_substitutes(catalog_frame(spark, *rows), inventory, 2, 3).collect()}
    assert got == {("B1", f"L{i:02d}"): "M" for i in range(15)}


def test_rules_of_a_large_itemset(spark):
    """Forty items: a level is cut where the confidence fails, so no subsets are enumerated."""
    big = [f"i{j:02d}" for j in range(40)]
    sets = [(big, 10), *[([x for x in big if x != y], 10 if y == "i07" else 100) for y in big], *[([x], 100) for x in big]]
    table = spark.createDataFrame([(i, n, len(i), n / 200) for i, n in sets], "items array<string>, n long, size int, support double")
    got = [(r.antecedent, r.consequent, r.confidence) for r in rules.association_rules(table, 0.5, 1.0).collect() if len(r.antecedent) == 39]
    assert got == [([x for x in big if x != "i07"], ["i07"], 1.0)]


def test_first_unsold_opens_few_blocks(spark, monkeypatch):
    """Only the blocks with the first unsold products are opened; the lists stay those of brute force."""
    monkeypatch.setattr(popularity, "BLOCK", 4)
    opened, write = [], popularity.cut_lineage

    def watched(df, name="table"):
        table = write(df, name)
        if name == "opened-blocks":
            opened.append(table.count())
        return table

    monkeypatch.setattr(popularity, "cut_lineage", watched)
    # "wide" sold the 30 best products of 40, "narrow" one of them, "all" every one
    best = [f"p{i:02d}" for i in range(40)]
    units = [("wide", p, 100.0 - i) for i, p in enumerate(best[:30])] + [("narrow", "p05", 1.0)]
    units += [("all", p, 500.0 - 10 * i) for i, p in enumerate(best)]
    frame = spark.createDataFrame(units, "store_id string, product_id string, n double")
    got = defaultdict(list)
    for r in popularity.branch_popularity_top(frame, 35, 2.0).orderBy("store_id", "rank").collect():
        got[r.store_id].append(r.product_id)
    total, everywhere = sum(n for *_, n in units), Counter()
    for _, p, n in units:
        everywhere[p] += n
    for store in ("wide", "narrow", "all"):
        mine = {p: n for s, p, n in units if s == store}
        raw = {p: (mine.get(p, 0.0) + 2.0 * everywhere[p] / total) / (sum(mine.values()) + 2.0) for p in best}
        assert got[store] == sorted(best, key=lambda p: (-raw[p], p))[:35]
    popularity.branch_popularity_top(frame, 2, 2.0).count()
    # two unsold products lie in one block of "wide" (after 7 sold-out ones) and in one of "narrow"
    assert opened[1] == 2


def test_the_catalogue_is_not_sent_to_every_task(spark):
    """A catalogue looks small by its files and is large in memory: personal scores merge it."""
    frame = lambda kind, row: spark.createDataFrame([row], kind)
    scores = personal.neighbour_scores(
        frame("customer_id string, product_id string, quantity int", ("c", "a", 2)),
        frame("product_id string, neighbour_id string, score double", ("a", "b", 0.5)),
        frame("product_id string, category_level_1 string, brand string", ("b", "x", "y")),
    )
    assert [tuple(r) for r in scores.collect()] == [("c", "b", 1.0)]
    semi = [x for x in scores._jdf.queryExecution().sparkPlan().toString().splitlines() if "LeftSemi" in x]
    assert semi and all("SortMergeJoin" in x for x in semi)


def test_items_take_their_profiles_lists_without_a_sort(spark):
    """Repeated items, and items of several profiles, as a sort of all pairs has them; items of one profile are not sorted."""
    members = spark.createDataFrame(
        [("a", "1"), ("a", "2"), ("a", "2"), ("a", "3"), ("b", "4"), ("b", "1"), ("c", None), (None, "5")], "profile_id string, item_id string")
    best = spark.createDataFrame(
        [("a", "a", 2.0), ("a", "b", 1.0), ("b", "b", 3.0), ("b", "a", 1.0), ("c", "c", 1.0)], "query_id string, profile_id string, score double")
    got = overlap.expand_profiles(best, members, 3)
    rows = sorted(tuple(r) for r in got.select("product_id", "rank", "candidate_id", "score").collect())
    assert rows == [
        ("1", 1, "4", 3.0), ("1", 2, "2", 2.0), ("1", 3, "2", 2.0),
        ("2", 1, "1", 2.0), ("2", 2, "1", 2.0), ("2", 3, "3", 2.0),
        ("3", 1, "1", 2.0), ("3", 2, "2", 2.0), ("3", 3, "2", 2.0),
        ("4", 1, "1", 3.0), ("4", 2, "1", 1.0), ("4", 3, "2", 1.0)]
    assert "posexplode" in got._jdf.queryExecution().optimizedPlan().toString()


def test_tiles_travel_packed_and_blocks_are_passed_over(spark, monkeypatch):
    """Lists over many tiles, with ties and a null id; no row is made per profile and tile, and blocks out of reach are not multiplied."""
    rng = random.Random(5)
    vectors = [(f"p{i:03d}" if i else None, sorted({f"a{i // 40}", f"b{i // 8}", rng.choice("xyz")})) for i in range(400)]
    frame = spark.createDataFrame([(p, t, [float(1 + 4 * (x[0] == "a") + 2 * (x[0] == "b")) for x in t]) for p, t in vectors],
                                  "profile_id string, tokens array<string>, weights array<double>")
    asks = frame.where("profile_id is not null")
    best = overlap.top_profiles(asks, frame, 6, keep_zero=True, tile=32)
    assert "explode" not in best._jdf.queryExecution().optimizedPlan().toString()
    got = defaultdict(list)
    for r in best.orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.profile_id, r.score))
    weigh = {"a": 5.0, "b": 3.0}
    for q, own in vectors[1:]:
        scores = sorted((-sum(weigh.get(t[0], 1.0) ** 2 for t in set(own) & set(other)), p is not None, p or "") for p, other in vectors)
        assert got[q] == [(p if known else None, -s) for s, known, p in scores[:6]], q
    rows = frame.toPandas()
    offers = overlap._Tile.of(rows)
    search = overlap._Search(overlap._Tile.of(rows[200:210]), 6, True)
    monkeypatch.setattr(overlap, "BLOCK", 8)
    search.guess(offers, np.arange(200, 210))
    rounds, real = [], np.round
    monkeypatch.setattr(overlap.np, "round", lambda *a: rounds.append(1) or real(*a))
    search.meet(offers)
    assert 0 < len(rounds) < 15  # of 50 blocks


def test_steps_leave_only_their_result(spark, tmp_path):
    """Tables written on the way go with the step, at any depth; older ones and the result stay."""
    older = cut_lineage(spark.range(3), "older")
    seen = []

    def inner():
        seen.append(cut_lineage(older.withColumnRenamed("id", "a"), "on-the-way"))
        return seen[-1].distinct()

    def outer():
        seen.append(settled(inner, "inner"))
        return seen[-1].unionByName(older.withColumnRenamed("id", "a"))

    result = settled(outer, "outer")
    assert sorted(r.a for r in result.collect()) == [0, 0, 1, 1, 2, 2] and older.count() == 3
    assert [os.path.exists(t._written_path) for t in [*seen, older, result]] == [False, False, True, True]


def test_an_index_keeps_only_its_own_tables(spark, monkeypatch):
    made = []
    real = session.cut_lineage
    for module in (session, hybrid, baskets, neighbours, personal, popularity, rules, overlap, content):
        if hasattr(module, "cut_lineage"):
            monkeypatch.setattr(module, "cut_lineage", lambda df, name="table": made.append(real(df, name)) or made[-1])
    lines = [(f"t{t}", "s1", f"c{t % 5}", D, f"p{(t * k) % 9}", 1) for t in range(12) for k in (1, 2, 3)]
    sold = spark.createDataFrame(lines, "transaction_id string, store_id string, customer_id string, transaction_date date, product_id string, quantity int")
    goods = catalog_frame(spark, *[(f"p{i}", f"n{i}", "cat", f"b{i % 2}", 1.0, None, [f"t{i % 3}"], True) for i in range(9)])
    likes = spark.createDataFrame([(f"c{i}", ["cat"], ["b0"]) for i in range(5)], "customer_id string, preferred_categories array<string>, affinity_brands array<string>")
    index = hybrid.build_index(sold, likes, goods, 0.1, 0.1, 0.0)
    kept = {t._written_path for t in vars(index).values() if t is not None}
    assert {t._written_path for t in made if os.path.exists(t._written_path)} == kept and len(made) > 2 * len(kept)


def test_long_preference_lists_travel_in_blocks(spark):
    """Lists beyond one block of places, with products that the customer owns in the first one."""
    n = 3 * personal.HEAD
    goods = spark.createDataFrame([(f"p{i:04d}", "cat", "b", True) for i in range(n)], "product_id string, category_level_1 string, brand string, is_active boolean")
    own = [f"p{i:04d}" for i in range(0, personal.HEAD, 2)]
    sold = spark.createDataFrame([("c", p, 1) for p in own], "customer_id string, product_id string, quantity int")
    likes = spark.createDataFrame([("c", ["cat"], ["b"])], "customer_id string, preferred_categories array<string>, affinity_brands array<string>")
    none = spark.createDataFrame([], "product_id string, neighbour_id string, score double")
    top = personal.personal_top(sold, likes, goods, none, 70)
    got = [r.product_id for r in top.orderBy("rank").collect()]
    assert got == [p for p in (f"p{i:04d}" for i in range(n)) if p not in own][:70]
