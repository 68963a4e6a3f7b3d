"""Queries for recommendations and allocation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlift.catalog.bindings import CTES, accounts, products, sales_lines, sql, table
from ledgerlift.catalog.queries_features import eligible_history, prepared_history, scored_customers, training_sales
from ledgerlift.catalog.registry import query
from ledgerlift.functions import buckets as bk
from ledgerlift.functions import text as tx
from ledgerlift.operators.ranking import top_n
from ledgerlift.plans import allocate as al
from ledgerlift.plans import features as ft
from ledgerlift.plans import recommend as rc

_TERMS = "|".join(rc.EXCLUDED_PRODUCT_TERMS)

CTES["pmaster"] = (("prod",), f"""
SELECT product_id, sku AS product_code, product_name, coalesce(product_group_l3_name, product_group_l2_name) AS product_group,
 regexp_matches(lower(product_name || ' ' || coalesce(product_group_l3_name, product_group_l2_name, '')), '({_TERMS}|small bolt)') AS excluded_from_recommendations FROM prod""")
CTES["psales"] = (("lines", "acc", "pmaster"), """
SELECT business_id, product_code, product_group, sum(total_value) AS sales_eur FROM lines JOIN acc USING (account_id) JOIN pmaster USING (product_id)
WHERE business_id IS NOT NULL GROUP BY ALL""")


def product_master(spark, sf):
    group = F.coalesce("product_group_l3_name", "product_group_l2_name")
    text = F.lower(F.concat_ws(" ", "product_name", group))
    return products(spark, sf).select(
        "product_id", F.col("sku").alias("product_code"), "product_name", group.alias("product_group"),
        tx.has_any(text, [*rc.EXCLUDED_PRODUCT_TERMS, "small bolt"]).alias("excluded_from_recommendations"),
    )


def product_sales(spark, sf):
    """Business by product; lines are added up per account and product before any join."""
    lines = sales_lines(spark, sf).groupBy("account_id", "product_id").agg(F.sum("total_value").alias("s"))
    a = accounts(spark, sf).filter(F.col("business_id").isNotNull()).select("account_id", "business_id")
    p = product_master(spark, sf).select("product_id", "product_code", "product_group")
    return lines.join(a, "account_id").join(p, "product_id").groupBy("business_id", "product_code", "product_group").agg(F.sum("s").alias("sales_eur"))


_GROUPED = "SELECT business_id, product_group, sum(sales_eur) AS v FROM psales WHERE product_group IS NOT NULL GROUP BY ALL"


@query("rec_05_white_space", sql("psales custs", """
SELECT business_id, product_group, round(gap, 9) AS white_space_gap, round(pot, 4) AS recommended_group_potential_eur, round(own, 4) AS customer_sales_eur, rn AS recommendation_rank FROM (
SELECT *, row_number() OVER (PARTITION BY business_id ORDER BY pot DESC, total DESC, product_group) AS rn FROM (
SELECT c.business_id, g.product_group, g.total, coalesce(o.v, 0) AS own, greatest(round(coalesce(s.share, g.share) - coalesce(o.share, 0), 12), 0) AS gap,
 c.model_estimated_potential_eur * greatest(round(coalesce(s.share, g.share) - coalesce(o.share, 0), 12), 0) AS pot
FROM custs c CROSS JOIN (SELECT product_group, sum(v) AS total, sum(v) / (SELECT sum(v) FROM gs) AS share FROM gs GROUP BY 1) g
LEFT JOIN (SELECT business_id, product_group, v, v / sum(v) OVER (PARTITION BY business_id) AS share FROM gs) o ON o.business_id = c.business_id AND o.product_group = g.product_group
LEFT JOIN (SELECT company_segment, product_group, sum(v) / sum(sum(v)) OVER (PARTITION BY company_segment) AS share FROM gs JOIN custs USING (business_id) GROUP BY 1, 2) s
 ON s.company_segment = c.company_segment AND s.product_group = g.product_group) WHERE gap > 0) WHERE rn <= 5""", {"gs": _GROUPED}))
def _(spark, sf):
    return rc.white_space(scored_customers(spark, sf), product_sales(spark, sf)).select(
        "business_id", "product_group", F.round("white_space_gap", 9).alias("white_space_gap"), F.round("recommended_group_potential_eur", 4).alias("recommended_group_potential_eur"),
        F.round("customer_sales_eur", 4).alias("customer_sales_eur"), F.col("recommendation_rank").cast("bigint").alias("recommendation_rank"),
    )


CTES["training"] = (("hist",), """
SELECT *, total_value AS sales_eur, conf AS product_group_match_confidence, total_value * conf AS weighted_sales_eur, upper(group_code) AS product_group_name FROM
(SELECT * EXCLUDE (product_group), group_code AS product_group, CASE line_no WHEN 1 THEN 1.0::DOUBLE WHEN 2 THEN 0.95 WHEN 3 THEN 0.85 WHEN 4 THEN 0.8 WHEN 5 THEN 0.75 WHEN 6 THEN 0.7 ELSE 0.0 END AS conf
 FROM hist WHERE status = 'Invoiced' AND business_id IS NOT NULL AND group_code IS NOT NULL AND group_code NOT IN ('SMALL bolt', 'LARGE gear') AND lower(trim(customer_status)) IN ('active', 'active+'))""")
CTES["gprofile"] = (("training",), """
SELECT product_group, max(product_group_name) AS product_group_name, count(*) AS training_rows, count(DISTINCT business_id) AS customer_count, sum(sales_eur) AS sales_eur,
 sum(weighted_sales_eur) AS weighted_sales_eur, avg(product_group_match_confidence) AS avg_match_confidence, sum(weighted_sales_eur) / sum(sum(weighted_sales_eur)) OVER () AS global_group_share
FROM training GROUP BY product_group""")
_PROFILE = """
SELECT 'company_segment' AS lvl, company_segment AS a, NULL AS b, product_group, 0.48 * sum(w) / sum(sum(w)) OVER (PARTITION BY company_segment) AS s FROM tw GROUP BY company_segment, product_group
UNION ALL SELECT 'industry', industry, NULL, product_group, 0.28 * sum(w) / sum(sum(w)) OVER (PARTITION BY industry) FROM tw GROUP BY industry, product_group
UNION ALL SELECT 'revenue_headcount', revenue_class, headcount_class, product_group, 0.16 * sum(w) / sum(sum(w)) OVER (PARTITION BY revenue_class, headcount_class) FROM tw GROUP BY revenue_class, headcount_class, product_group
UNION ALL SELECT 'global', NULL, NULL, product_group, 0.08 * sum(w) / sum(sum(w)) OVER () FROM tw GROUP BY product_group"""
_SUBMODEL = {
    "tw": "SELECT t.product_group, t.weighted_sales_eur AS w, c.company_segment, c.industry, c.revenue_class, c.headcount_class FROM training t LEFT JOIN custs c USING (business_id)",
    "pr": _PROFILE,
    "cand": """SELECT c.business_id, p.product_group, sum(s) AS score, array_to_string(list_sort(list(DISTINCT lvl)), ', ') AS evidence_levels FROM custs c JOIN pr p ON
 (lvl = 'company_segment' AND p.a IS NOT DISTINCT FROM c.company_segment) OR (lvl = 'industry' AND p.a IS NOT DISTINCT FROM c.industry)
 OR (lvl = 'revenue_headcount' AND p.a IS NOT DISTINCT FROM c.revenue_class AND p.b IS NOT DISTINCT FROM c.headcount_class) OR lvl = 'global' GROUP BY 1, 2""",
    "best": """SELECT * FROM (SELECT c.*, g.sales_eur, g.customer_count, g.avg_match_confidence, row_number() OVER (PARTITION BY business_id ORDER BY round(score, 12) DESC, g.sales_eur DESC, g.customer_count DESC, product_group) AS rn
 FROM cand c JOIN gprofile g USING (product_group) WHERE score > 0) WHERE rn <= 5""",
}


@query("rec_06_profile_submodel", sql("training custs gprofile", """
SELECT b.business_id, product_group, rn AS recommendation_rank, round(score, 9) AS recommendation_score, round(score / sum(score) OVER (PARTITION BY b.business_id), 9) AS top_allocation_share,
 round(least(greatest(avg_match_confidence * least(1, ln(1 + customer_count) / ln(51)), 0), 1), 9) AS confidence, evidence_levels FROM best b""", _SUBMODEL))
def _(spark, sf):
    train = training_sales(spark, sf).withColumns({"product_group": F.col("group_code"), "product_group_name": F.upper("group_code")})
    out = rc.profile_recommendations(scored_customers(spark, sf), train)
    return out.select(
        "business_id", "product_group", F.col("recommendation_rank").cast("bigint").alias("recommendation_rank"), F.round("recommendation_score", 9).alias("recommendation_score"),
        F.round("top_allocation_share", 9).alias("top_allocation_share"), F.round("confidence", 9).alias("confidence"), "evidence_levels",
    )


@query("jn_07_null_matching_join", sql("training custs", """
SELECT c.business_id, p.product_group, round(s, 9) AS weighted_profile_share FROM custs c JOIN pr p ON lvl = 'industry' AND p.a IS NOT DISTINCT FROM c.industry""",
{"tw": _SUBMODEL["tw"], "pr": _PROFILE}))
def _(spark, sf):
    from ledgerlift.operators.ranking import join_on

    train = training_sales(spark, sf).withColumn("product_group", F.col("group_code"))
    customers = scored_customers(spark, sf)
    profile = rc.segment_profiles(train, customers)["industry"].select("industry", "product_group", "weighted_profile_share")
    return join_on(customers.select("business_id", "industry"), profile, ["industry"], "inner").select(
        "business_id", "product_group", F.round("weighted_profile_share", 9).alias("weighted_profile_share")
    )


_PRODREC = {
    "gs": _GROUPED,
    "gt": "SELECT product_group, sum(v) AS total, sum(v) / (SELECT sum(v) FROM gs) AS peer FROM gs GROUP BY 1",
    "st": """SELECT m.*, coalesce(s.v, 0) AS sold, coalesce(s.n, 0) AS buyers, coalesce(gt.peer, 0) AS peer,
 CASE WHEN gt.total > 0 THEN coalesce(s.v, 0) / gt.total ELSE 1.0 / count(*) OVER (PARTITION BY m.product_group) END AS share FROM pmaster m
 LEFT JOIN (SELECT product_code, sum(sales_eur) AS v, count(DISTINCT business_id) AS n FROM psales GROUP BY 1) s USING (product_code) LEFT JOIN gt USING (product_group)""",
    "pool": "SELECT * FROM st WHERE NOT excluded_from_recommendations AND (product_code LIKE 'IF%' OR product_code LIKE 'DIF%')",
    "own": "SELECT business_id, product_group, sum(sales_eur) / (SELECT sum(x.sales_eur) FROM psales x WHERE x.business_id = p.business_id) AS share FROM psales p WHERE product_group IS NOT NULL GROUP BY 1, 2",
    "cand": """SELECT c.business_id, c.expected_potential_eur AS e, 'current' AS kind, s.product_code, s.product_group, s.share, s.peer, s.buyers FROM custs c JOIN (SELECT DISTINCT business_id, product_code FROM psales) b USING (business_id)
 JOIN st s USING (product_code) WHERE NOT excluded_from_recommendations
 UNION ALL SELECT c.business_id, c.expected_potential_eur, 'new', s.product_code, s.product_group, s.share, s.peer, s.buyers FROM custs c CROSS JOIN pool s
 WHERE NOT EXISTS (SELECT 1 FROM psales p WHERE p.business_id = c.business_id AND p.product_code = s.product_code)""",
    "scored": """SELECT *, round(e * u, 6) AS pot, round(u, 12) AS o FROM (SELECT *, CASE WHEN gap * share * chance <= 0 THEN share * chance * 0.01 ELSE gap * share * chance END AS u FROM (SELECT c.*, greatest(c.peer - coalesce(o.share, 0), 0) AS gap,
 least(CASE kind WHEN 'current' THEN 0.85::DOUBLE ELSE 0.2::DOUBLE END + 0.1::DOUBLE * least(buyers, 10) / 10.0::DOUBLE, 0.95) AS chance FROM cand c LEFT JOIN own o ON o.business_id = c.business_id AND o.product_group = c.product_group))""",
    "ranked": """SELECT *, row_number() OVER (PARTITION BY business_id, kind, product_code LIKE 'DIF%' ORDER BY o DESC, product_code) AS r FROM scored""",
    "picked": """SELECT * FROM ranked WHERE kind = 'current' UNION ALL SELECT * FROM ranked q WHERE kind = 'new' AND ((product_code LIKE 'DIF%' AND r = 1)
 OR (product_code NOT LIKE 'DIF%' AND r <= 5 - (SELECT count(*) FROM ranked d WHERE d.business_id = q.business_id AND d.kind = 'new' AND d.product_code LIKE 'DIF%' AND d.r = 1)))""",
}


@query("rec_07_product_recommendations", sql("pmaster psales custs", """
SELECT business_id, kind AS recommendation_type, product_code, rn AS recommendation_rank, pot AS potential_eur, round(chance, 6) AS purchase_probability FROM (
SELECT *, row_number() OVER (PARTITION BY business_id, kind ORDER BY o DESC, product_code) AS rn FROM picked) WHERE rn <= 5""", _PRODREC))
def _(spark, sf):
    out = rc.product_recommendations(scored_customers(spark, sf), product_master(spark, sf), product_sales(spark, sf))
    return out.select(
        "business_id", "recommendation_type", "product_code", F.col("recommendation_rank").cast("bigint").alias("recommendation_rank"),
        F.round("potential_eur", 6).alias("potential_eur"), F.round("purchase_probability", 6).alias("purchase_probability"),
    )


_NEXT = {
    "own": "SELECT business_id, product_group, sum(sales_eur) AS v FROM psales WHERE product_group IS NOT NULL AND sales_eur > 0 GROUP BY ALL",
    "peers": "SELECT company_segment, count(DISTINCT business_id) AS n FROM custs GROUP BY 1",
    "seg": "SELECT company_segment, product_group, count(*) AS buyers, sum(v) AS v FROM own JOIN custs USING (business_id) GROUP BY 1, 2",
    "full_seg": "SELECT * FROM seg UNION ALL SELECT p.company_segment, o.product_group, count(*), sum(v) FROM peers p, own o WHERE p.company_segment NOT IN (SELECT company_segment FROM seg) GROUP BY 1, 2",
    "rated": """SELECT f.*, buyers / n::DOUBLE AS adoption, v / sum(v) OVER (PARTITION BY company_segment) AS sales_share FROM full_seg f JOIN peers USING (company_segment)""",
    "cand": """SELECT c.business_id, r.*, 0.7 * adoption + 0.3 * sales_share AS sc, row_number() OVER (PARTITION BY c.business_id ORDER BY round(0.7::DOUBLE * adoption + 0.3::DOUBLE * sales_share, 12) DESC, adoption DESC, sales_share DESC, product_group) AS rn
 FROM custs c JOIN rated r USING (company_segment) WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.business_id = c.business_id AND o.product_group = r.product_group)""",
    "ex": """SELECT product_group, arg_min(product_name, rn) AS example_product FROM (SELECT p.product_group, m.product_name, row_number() OVER (PARTITION BY p.product_group ORDER BY round(sum(sales_eur), 4) DESC, p.product_code) AS rn
 FROM psales p JOIN pmaster m USING (product_code) WHERE sales_eur > 0 AND (p.product_code LIKE 'IF%' OR p.product_code LIKE 'DIF%') GROUP BY p.product_group, p.product_code, m.product_name) GROUP BY 1""",
}


@query("rec_08_next_groups", sql("pmaster psales custs", """
SELECT business_id, product_group, rn AS recommendation_rank, round(sc, 9) AS group_score, coalesce(example_product, '') AS example_product FROM cand LEFT JOIN ex USING (product_group) WHERE rn <= 2""", _NEXT))
def _(spark, sf):
    out = rc.next_groups(scored_customers(spark, sf), product_master(spark, sf), product_sales(spark, sf))
    return out.select(
        "business_id", "product_group", F.col("recommendation_rank").cast("bigint").alias("recommendation_rank"), F.round("group_score", 9).alias("group_score"), "example_product"
    )


@query("rec_10_top_groups", sql("psales", """
SELECT business_id, product_group, rn AS group_rank FROM (SELECT business_id, product_group, row_number() OVER (PARTITION BY business_id ORDER BY round(sum(sales_eur), 4) DESC, product_group) AS rn
FROM psales WHERE product_group IS NOT NULL GROUP BY 1, 2) WHERE rn <= 3"""))
def _(spark, sf):
    return top_groups(spark, sf).select("business_id", "product_group", F.col("group_rank").cast("bigint").alias("group_rank"))


def top_groups(spark, sf):
    grouped = product_sales(spark, sf).filter(F.col("product_group").isNotNull()).groupBy("business_id", "product_group").agg(F.round(F.sum("sales_eur"), 4).alias("v"))
    return top_n(grouped, ["business_id"], [("v", "desc"), ("product_group", "asc")], 3, "group_rank")


CTES["weights"] = (("shist",), """
SELECT business_id, product_service, sum(greatest(coalesce(net_sales, 1) * least(greatest(product_group_match_confidence, 0.1), 1), 1)) AS weight FROM shist
WHERE lower(trim(customer_status)) IN ('active', 'active+') AND business_id IS NOT NULL GROUP BY ALL""")


@query("rec_02_customer_products", sql("weights", "SELECT business_id, product_service, round(weight, 6) AS weight FROM weights"))
def _(spark, sf):
    return rc.customer_products(eligible_history(spark, sf)).select("business_id", "product_service", F.round("weight", 6).alias("weight"))


_RULES = """
WITH p AS (SELECT DISTINCT l_orderkey AS b, l_partkey AS i FROM lineitem), c AS (SELECT i, count(*) AS n FROM p GROUP BY 1), t AS (SELECT count(DISTINCT b) AS n FROM p),
s AS (SELECT x.i AS a, y.i AS c, count(*) AS support_count FROM p x JOIN p y ON x.b = y.b AND x.i <> y.i GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT s.a AS antecedent, s.c AS consequent, support_count, round(support_count / ca.n::DOUBLE, 9) AS confidence, round(support_count / ca.n::DOUBLE / (cc.n / t.n::DOUBLE), 6) AS lift
FROM s JOIN c ca ON ca.i = s.a JOIN c cc ON cc.i = s.c, t WHERE support_count / ca.n::DOUBLE >= 0.05 AND support_count / ca.n::DOUBLE / (cc.n / t.n::DOUBLE) >= 1"""


@query("rec_03_association_rules", _RULES)
def _(spark, sf):
    rules = rc.association_rules(table(spark, sf, "lineitem"), "l_orderkey", "l_partkey")
    return rules.select("antecedent", "consequent", "support_count", F.round("confidence", 9).alias("confidence"), F.round("lift", 6).alias("lift"))


_KNN = """
WITH u AS (SELECT vec_id, label, list_transform(embedding, lambda x : x::DOUBLE) AS e FROM embeddings)
SELECT * FROM (SELECT q.vec_id::VARCHAR AS business_id, r.vec_id::VARCHAR AS neighbour_id, round(list_cosine_similarity(q.e, r.e), 6) AS similarity,
 row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.e, r.e), 12) DESC, r.vec_id::VARCHAR) AS neighbour_rank
 FROM u q JOIN u r ON q.label % 2 = 1 AND r.label % 2 = 0) WHERE neighbour_rank <= 10"""


def embedding_neighbours(spark, sf):
    e = table(spark, sf, "embeddings").withColumns({"business_id": F.col("vec_id").cast("string"), "neighbour_id": F.col("vec_id").cast("string")})
    return rc.nearest_neighbours(
        e.filter("label % 2 = 1"), e.filter("label % 2 = 0"), query_id="business_id", reference_id="neighbour_id", vector="embedding", k=10
    )


@query("jn_18_nearest_neighbours", _KNN)
def _(spark, sf):
    return embedding_neighbours(spark, sf).select(
        "business_id", "neighbour_id", F.round("similarity", 6).alias("similarity"), F.col("neighbour_rank").cast("bigint").alias("neighbour_rank")
    )


_NB = {
    "nb": f"SELECT business_id, neighbour_id, round(similarity, 6) AS similarity FROM ({_KNN.strip()})",
    "annual_v": "SELECT c_custkey::VARCHAR AS neighbour_id, greatest(c_acctbal, 0) * 10 AS annual_sales_eur FROM customer",
}


def _annual_by_vector(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("business_id"), (F.greatest("c_acctbal", F.lit(0.0)) * 10).alias("annual_sales_eur"))


@query("rec_01_neighbour_potential", sql("", """
SELECT business_id, round(w / s, 2) AS annual_potential_estimate_eur, CASE WHEN w / s < 4000 THEN 'Partner' WHEN w / s >= 100000 THEN 'A' WHEN w / s >= 50000 THEN 'B' WHEN w / s >= 10000 THEN 'C' ELSE 'Below C' END AS potential_segment
FROM (SELECT business_id, sum(greatest(similarity, 0) * coalesce(annual_sales_eur, 0)) AS w, sum(greatest(similarity, 0)) AS s FROM nb LEFT JOIN annual_v USING (neighbour_id) GROUP BY 1)""", _NB))
def _(spark, sf):
    nb = embedding_neighbours(spark, sf).withColumn("similarity", F.round("similarity", 6))
    return rc.neighbour_potential(nb, _annual_by_vector(spark, sf))


_BASKET = {
    **_NB,
    "w": "SELECT o_custkey::VARCHAR AS neighbour_id, o_orderpriority || ' ' || (o_custkey % 3) AS product_service, sum(o_totalprice) AS weight FROM orders GROUP BY 1, 2, o_custkey",
    "ns": "SELECT business_id, product_service, sum(greatest(similarity, 0) * weight) AS score FROM nb JOIN w USING (neighbour_id) GROUP BY 1, 2",
    "n1": "SELECT business_id, product_service, score / max(score) OVER (PARTITION BY business_id) AS n FROM ns",
    "pr": "SELECT DISTINCT o_custkey::VARCHAR AS b, o_orderpriority || ' ' || (o_custkey % 3) AS i FROM orders",
    "ct": "SELECT i, count(*) AS n FROM pr GROUP BY 1",
    "ru": """SELECT x.i AS a, y.i AS c, count(*)::DOUBLE / any_value(ca.n) AS confidence, count(*)::DOUBLE / any_value(ca.n) / (any_value(cc.n) / (SELECT count(DISTINCT b) FROM pr)::DOUBLE) AS lift FROM pr x JOIN pr y ON x.b = y.b AND x.i <> y.i
 JOIN ct ca ON ca.i = x.i JOIN ct cc ON cc.i = y.i GROUP BY 1, 2 HAVING count(*) >= 2""",
    "b0": "SELECT business_id, c AS product_service, sum(n * confidence * lift) AS score FROM n1 JOIN ru ON ru.a = n1.product_service WHERE confidence >= 0.05 AND lift >= 1 GROUP BY 1, 2",
    "b1": "SELECT business_id, product_service, score / max(score) OVER (PARTITION BY business_id) AS b FROM b0",
}


@query("rec_04_rule_boost", sql("", """
SELECT * FROM (SELECT business_id, product_service, round(s, 6) AS combined_score, row_number() OVER (PARTITION BY business_id ORDER BY round(s, 9) DESC, product_service) AS recommendation_rank FROM
 (SELECT business_id, product_service, 0.7 * coalesce(n, 0) + 0.3 * coalesce(b, 0) AS s FROM n1 FULL JOIN b1 USING (business_id, product_service))) WHERE recommendation_rank <= 5""", _BASKET))
def _(spark, sf):
    o = table(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("business_id"), F.concat_ws(" ", "o_orderpriority", (F.col("o_custkey") % 3).cast("string")).alias("product_service"), "o_totalprice"
    )
    weights = o.groupBy("business_id", "product_service").agg(F.sum("o_totalprice").alias("weight"))
    nb = embedding_neighbours(spark, sf).withColumn("similarity", F.round("similarity", 6))
    rules = rc.association_rules(o, "business_id", "product_service")
    out = rc.rule_boost(rc.neighbour_product_scores(nb, weights), rules)
    return out.select("business_id", "product_service", F.round("combined_score", 6).alias("combined_score"), F.col("recommendation_rank").cast("bigint").alias("recommendation_rank"))


_REF = {
    **_NB,
    "fa": "SELECT c_custkey::VARCHAR AS neighbour_id, greatest(c_acctbal, 0) AS sales_eur, c_nationkey AS group_count FROM customer",
    "sc": """SELECT nb.*, 0.60::DOUBLE * similarity + 0.25::DOUBLE * sales_eur / (SELECT greatest(max(sales_eur), 1) FROM fa) + 0.15::DOUBLE * group_count / (SELECT greatest(max(group_count), 1) FROM fa) AS reference_score FROM nb JOIN fa USING (neighbour_id)""",
}


@query("rec_09_reference_companies", sql("", """
SELECT business_id, neighbour_id, round(reference_score, 6) AS reference_score, rn AS reference_rank FROM (SELECT *, row_number() OVER (PARTITION BY business_id ORDER BY round(reference_score, 9) DESC, neighbour_id) AS rn FROM sc) WHERE rn <= 3""", _REF))
def _(spark, sf):
    nb = embedding_neighbours(spark, sf).withColumn("similarity", F.round("similarity", 6))
    c = table(spark, sf, "customer")
    facts = c.select(F.col("c_custkey").cast("string").alias("business_id"), F.greatest("c_acctbal", F.lit(0.0)).alias("sales_eur"), F.col("c_nationkey").alias("group_count"))
    groups = c.select(F.col("c_custkey").cast("string").alias("business_id"), F.col("c_mktsegment").alias("product_group"))
    best, _ = rc.reference_companies(nb, facts, groups)
    return best.select("business_id", "neighbour_id", F.round("reference_score", 6).alias("reference_score"), F.col("reference_rank").cast("bigint").alias("reference_rank"))


@query("rec_09_reference_groups", sql("", """
SELECT * FROM (SELECT business_id, c_mktsegment AS product_group, round(sum(similarity), 6) AS group_score, row_number() OVER (PARTITION BY business_id ORDER BY round(sum(similarity), 9) DESC, c_mktsegment) AS group_rank
FROM nb JOIN customer ON c_custkey::VARCHAR = neighbour_id GROUP BY 1, 2) WHERE group_rank <= 5""", _NB))
def _(spark, sf):
    nb = embedding_neighbours(spark, sf).withColumn("similarity", F.round("similarity", 6))
    c = table(spark, sf, "customer")
    facts = c.select(F.col("c_custkey").cast("string").alias("business_id"), F.greatest("c_acctbal", F.lit(0.0)).alias("sales_eur"), F.col("c_nationkey").alias("group_count"))
    groups = c.select(F.col("c_custkey").cast("string").alias("business_id"), F.col("c_mktsegment").alias("product_group"))
    _, suggested = rc.reference_companies(nb, facts, groups)
    return suggested.select("business_id", "product_group", F.round("group_score", 6).alias("group_score"), F.col("group_rank").cast("bigint").alias("group_rank"))


# --------------------------------------------------------------------------- allocation

_SEGSALES = {
    "ss": "SELECT coalesce(c.company_segment, 'unknown') AS segment, p.product_code AS product_id, greatest(p.sales_eur, 0) AS sales FROM psales p LEFT JOIN custs c USING (business_id)",
    "base": "SELECT segment, product_id, sum(sales) AS sales FROM ss GROUP BY 1, 2",
    "w": "SELECT segment, product_id, sales / sum(sales) OVER (PARTITION BY segment) AS w FROM base",
}


@query("alc_04_segment_product_sales", sql("psales custs", "SELECT segment, product_id, round(sum(sales), 4) AS sales FROM ss GROUP BY 1, 2", {"ss": _SEGSALES["ss"]}))
def _(spark, sf):
    out = segment_sales(spark, sf)
    return out.groupBy("segment", "product_id").agg(F.round(F.sum("sales"), 4).alias("sales"))


def segment_sales(spark, sf):
    sold = product_sales(spark, sf).select("business_id", F.col("product_code").alias("product_code"), "sales_eur")
    return al.product_sales_by_segment(sold, scored_customers(spark, sf).select("business_id", "company_segment"))


@query("alc_01_product_weights", sql("psales custs", "SELECT segment, product_id, round(w, 12) AS weight FROM w", _SEGSALES))
def _(spark, sf):
    weights, _ = al.product_weights(segment_sales(spark, sf))
    return weights.select("segment", "product_id", F.round("weight", 12).alias("weight"))


# brute force of the cap: for every number of capped products k, the smallest k that works
_CAP = {
    "s": """SELECT c_mktsegment || ' ' || (c_nationkey % 3) AS segment, o_orderpriority AS product_id, sum(o_totalprice * CASE left(o_orderpriority, 1) WHEN '1' THEN 4 WHEN '2' THEN 2 ELSE 1 END) AS sales
 FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2""",
    "w": "SELECT segment, product_id, sales / sum(sales) OVER (PARTITION BY segment) AS w, row_number() OVER (PARTITION BY segment ORDER BY sales DESC, product_id) AS rn, count(*) OVER (PARTITION BY segment) AS n FROM s",
    "t": "SELECT *, coalesce(sum(w) OVER (PARTITION BY segment ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM w",
    "k": "SELECT segment, min(rn) - 1 AS k FROM t WHERE w * (1 - (rn - 1) * 0.25) / (1 - before) <= 0.25 + 1e-12 GROUP BY 1",
    "c": "SELECT t.*, coalesce(k.k, t.n) AS k, sum(CASE WHEN rn > coalesce(k.k, t.n) THEN w END) OVER (PARTITION BY t.segment) AS rest FROM t LEFT JOIN k USING (segment)",
}


@query("alc_02_capped_weights", sql("", "SELECT segment, product_id, round(CASE WHEN rn <= k THEN 0.25 ELSE w * (1 - k * 0.25) / rest END, 9) AS weight FROM c", _CAP))
def _(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    sold = o.join(c, o.o_custkey == c.c_custkey).select(
        F.concat_ws(" ", "c_mktsegment", (F.col("c_nationkey") % 3).cast("string")).alias("segment"), F.col("o_orderpriority").alias("product_id"),
        (F.col("o_totalprice") * F.when(F.col("o_orderpriority").startswith("1"), 4).when(F.col("o_orderpriority").startswith("2"), 2).otherwise(1)).alias("sales"),
    )
    weights, _ = al.product_weights(sold, max_weight=0.25)
    return weights.select("segment", "product_id", F.round("weight", 9).alias("weight"))


_ALLOC = {
    "s": "SELECT c_mktsegment || ' ' || c_nationkey AS segment, o_orderpriority AS product_id, sum(o_totalprice) AS sales FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2",
    "w": "SELECT segment, product_id, sales / sum(sales) OVER (PARTITION BY segment) AS w FROM s",
    "g": "SELECT product_id, sum(sales) / (SELECT sum(sales) FROM s) AS w FROM s GROUP BY 1",
    "a": "SELECT c_custkey::VARCHAR AS business_id, greatest(c_acctbal, 0) AS pot, CASE WHEN c_custkey % 10 = 0 THEN 'elsewhere' ELSE c_mktsegment || ' ' || c_nationkey END AS segment FROM customer",
    "x": "SELECT business_id, pot, product_id, w FROM a JOIN w USING (segment) UNION ALL SELECT business_id, pot, product_id, w FROM a CROSS JOIN g WHERE segment NOT IN (SELECT segment FROM w)",
}


def _allocation(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    segment = F.concat_ws(" ", "c_mktsegment", F.col("c_nationkey").cast("string"))
    sold = o.join(c, o.o_custkey == c.c_custkey).select(segment.alias("segment"), F.col("o_orderpriority").alias("product_id"), F.col("o_totalprice").alias("sales"))
    buyers = c.select(
        F.col("c_custkey").cast("string").alias("business_id"), F.greatest("c_acctbal", F.lit(0.0)).alias("account_potential"),
        F.when(F.col("c_custkey") % 10 == 0, "elsewhere").otherwise(segment).alias("segment"),
    )
    return al.allocate(buyers, sold)


@query("alc_03_allocation", sql("", """
SELECT business_id, product_id, round(pot * w, 4) AS product_potential, row_number() OVER (PARTITION BY business_id ORDER BY round(pot * w, 9) DESC, product_id) AS product_rank FROM x""", _ALLOC))
def _(spark, sf):
    return _allocation(spark, sf).select(
        "business_id", "product_id", F.round("product_potential", 4).alias("product_potential"), F.col("product_rank").cast("bigint").alias("product_rank")
    )


@query("jn_12_segment_or_global_join", sql("", "SELECT business_id, count(*) AS products, round(sum(pot * w), 2) AS allocated FROM x GROUP BY 1", _ALLOC))
def _(spark, sf):
    return _allocation(spark, sf).groupBy("business_id").agg(F.count("*").alias("products"), F.round(F.sum("product_potential"), 2).alias("allocated"))


@query("ar_02_wide_slots", sql("psales", """
SELECT business_id, max(product_group) FILTER (rn = 1) AS group_1, max(product_group) FILTER (rn = 2) AS group_2, max(product_group) FILTER (rn = 3) AS group_3 FROM
(SELECT business_id, product_group, row_number() OVER (PARTITION BY business_id ORDER BY round(sum(sales_eur), 4) DESC, product_group) AS rn FROM psales WHERE product_group IS NOT NULL GROUP BY 1, 2) GROUP BY 1"""))
def _(spark, sf):
    ranked = top_groups(spark, sf)
    slots = [F.max(F.when(F.col("group_rank") == i, F.col("product_group"))).alias(f"group_{i}") for i in (1, 2, 3)]
    return ranked.groupBy("business_id").agg(*slots)


@query("ar_03_weighted_merge", sql("", "SELECT business_id, product_service, round(score, 2) AS score FROM ns", _BASKET))
def _(spark, sf):
    o = table(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("business_id"), F.concat_ws(" ", "o_orderpriority", (F.col("o_custkey") % 3).cast("string")).alias("product_service"), "o_totalprice"
    )
    weights = o.groupBy("business_id", "product_service").agg(F.sum("o_totalprice").alias("weight"))
    nb = embedding_neighbours(spark, sf).withColumn("similarity", F.round("similarity", 6))
    return rc.neighbour_product_scores(nb, weights).select("business_id", "product_service", F.round("score", 2).alias("score"))
