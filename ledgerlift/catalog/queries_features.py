"""Queries for sales preparation, snapshots and purchase history."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlift.catalog.bindings import CTES, accounts, companies, products, sales_lines, sql, table
from ledgerlift.catalog.queries_scalar import SEGMENT_SQL
from ledgerlift.catalog.registry import query
from ledgerlift.functions import buckets as bk
from ledgerlift.plans import features as ft

Y3 = 2000

# lines with business id, product group and the columns the history pipeline reads
CTES["hist"] = (("lines", "acc", "prod"), """
SELECT l.*, a.business_id, a.customer_status, coalesce(p.product_group_l3_name, p.product_group_l2_name) AS product_group, p.sku, p.inventory_category,
 p.product_group_l2_name AS group_code, p.product_name, l.total_value AS net_sales, l.order_id * 10 + l.line_no AS line_id
FROM lines l LEFT JOIN acc a USING (account_id) LEFT JOIN prod p USING (product_id)""")


def history_lines(spark, sf, more=()):
    """Order lines with their business id and product group; ``more``: columns made of the product, once for each."""
    p = products(spark, sf).select(
        "product_id", F.coalesce("product_group_l3_name", "product_group_l2_name").alias("product_group"), "sku", "inventory_category",
        F.col("product_group_l2_name").alias("group_code"), "product_name", *more,
    )
    a = accounts(spark, sf).select("account_id", "business_id", "customer_status")
    lines = sales_lines(spark, sf).withColumns({"net_sales": F.col("total_value"), "line_id": F.col("order_id") * 10 + F.col("line_no")})
    return lines.join(a, "account_id", "left").join(p, "product_id", "left")


def company_features(spark, sf):
    return ft.company_features(companies(spark, sf), ["revenue_k_eur", "headcount", "growth_pct"], ["industry", "municipality", "region"])


@query("ft_01_company_features", sql("comp", "SELECT DISTINCT business_id, revenue_k_eur, headcount, growth_pct, industry, municipality, region FROM comp WHERE business_id IS NOT NULL"))
def _(spark, sf):
    return company_features(spark, sf)


_EXCL = "group_code IS NULL OR group_code NOT IN ('SMALL bolt', 'LARGE gear')"
EXCLUDED = ("SMALL bolt", "LARGE gear")


@query("flt_01_status_filter", sql("lines", "SELECT order_id, line_no, status FROM lines WHERE lower(trim(status)) IN ('invoiced', 'processed')"))
def _(spark, sf):
    return ft.invoiced_only(sales_lines(spark, sf), ("Invoiced", "processed")).select("order_id", "line_no", "status")


@query("flt_02_completed_by_feed", sql("lines", """
SELECT order_id, line_no FROM lines WHERE total_value > 0 AND ((account_id % 2 = 0 AND status = 'Invoiced') OR (account_id % 2 = 1 AND trim(status) = 'processed'))"""))
def _(spark, sf):
    fed = sales_lines(spark, sf).withColumn("source_file", F.when(F.col("account_id") % 2 == 0, "Orders_a.csv").otherwise("shop_b.csv"))
    return ft.completed_sales(fed, {"orders": ft.INVOICE_STATUSES, "shop": ft.OTHER_FEED_STATUSES}).select("order_id", "line_no")


@query("flt_03_excluded_groups", sql("hist", f"SELECT order_id, line_no, group_code FROM hist WHERE {_EXCL}"))
def _(spark, sf):
    return ft.without_groups(history_lines(spark, sf), "group_code", EXCLUDED).select("order_id", "line_no", "group_code")


CTES["shist"] = (("hist",), f"""
SELECT *, 'productcode:' || sku AS product_service, CASE line_no WHEN 1 THEN 1.0::DOUBLE WHEN 2 THEN 0.8 WHEN 3 THEN 0.85 WHEN 4 THEN 0.8 WHEN 5 THEN 0.75 WHEN 6 THEN 0.7 ELSE 0.0 END
 AS product_group_match_confidence FROM hist WHERE status = 'Invoiced' AND ({_EXCL})""")


def prepared_history(spark, sf):
    lines = history_lines(spark, sf)
    ready = ft.without_groups(ft.invoiced_only(lines), "group_code", EXCLUDED)
    keyed = ft.product_fallback_key(ready, "sku", "product_name", "reference", "inventory_category")
    return keyed.withColumn("product_group_match_confidence", bk.match_confidence(F.col("product_group_match_method")))


@query("ft_04_sales_history", sql("shist", "SELECT line_id, business_id, product_service, product_group_match_confidence FROM shist"))
def _(spark, sf):
    return prepared_history(spark, sf).select("line_id", "business_id", "product_service", "product_group_match_confidence")


@query("col_11_product_fallback_key", sql("hist", """
SELECT line_id, CASE WHEN product_id % 3 = 0 THEN 'productcode:' || sku WHEN product_id % 3 = 1 THEN 'name_category:' || product_name || '|category:' || inventory_category
 ELSE 'reference_category:' || reference || '|category:' || inventory_category END AS product_service,
 CASE product_id % 3 WHEN 0 THEN 'productcode' WHEN 1 THEN 'name_category' ELSE 'reference_category' END AS product_fallback_source FROM hist"""))
def _(spark, sf):
    key = F.col("product_id") % 3
    lines = history_lines(spark, sf).withColumns({"sku": F.when(key == 0, F.col("sku")).otherwise(" "), "product_name": F.when(key == 1, F.col("product_name"))})
    return ft.product_fallback_key(lines, "sku", "product_name", "reference", "inventory_category").select("line_id", "product_service", "product_fallback_source")


@query("ft_05_account_status", sql("hist acc", """
SELECT h.line_id, trim(s.customer_status) AS customer_status, CASE WHEN x.business_id IS NOT NULL THEN 'Active+' ELSE trim(s.customer_status) END AS fixed_status FROM hist h
LEFT JOIN (SELECT business_id, arg_min(struct_pack(v := customer_status), account_id).v AS customer_status FROM acc WHERE business_id IS NOT NULL GROUP BY 1) s USING (business_id)
LEFT JOIN (SELECT DISTINCT business_id FROM acc WHERE country < 5) x USING (business_id)"""))
def _(spark, sf):
    a = accounts(spark, sf)
    lines = history_lines(spark, sf).select("line_id", "business_id")
    joined = ft.with_account_status(lines, a)
    fixed = ft.with_fixed_status(joined.withColumn("own", F.col("customer_status")), a.filter("country < 5"), "Active+")
    return fixed.select("line_id", F.col("own").alias("customer_status"), F.col("customer_status").alias("fixed_status"))


CTES["annual"] = (("shist",), """
SELECT business_id, coalesce(sum(net_sales), 0) AS annual_sales_eur FROM shist WHERE lower(trim(customer_status)) IN ('active', 'active+') AND business_id IS NOT NULL
 AND sold_on > (SELECT max(sold_on) FROM shist WHERE lower(trim(customer_status)) IN ('active', 'active+')) - 365 GROUP BY 1""")


def eligible_history(spark, sf):
    return prepared_history(spark, sf).filter(F.lower(F.trim("customer_status")).isin("active", "active+"))


@query("tg_03_annual_sales", sql("annual", "SELECT business_id, round(annual_sales_eur, 4) AS annual_sales_eur FROM annual"))
def _(spark, sf):
    return ft.annual_sales(eligible_history(spark, sf)).select("business_id", F.round("annual_sales_eur", 4).alias("annual_sales_eur"))


@query("flt_04_eligible_training_sales", sql("shist annual", """
SELECT line_id, business_id, round(net_sales, 4) AS net_sales FROM shist WHERE lower(trim(customer_status)) IN ('active', 'active+')
 AND business_id IN (SELECT business_id FROM annual WHERE annual_sales_eur >= 100000)"""))
def _(spark, sf):
    return ft.eligible_training_sales(prepared_history(spark, sf), minimum=100000.0, check=False).select(
        "line_id", "business_id", F.round("net_sales", 4).alias("net_sales")
    )


@query("flt_05_lookback_window", sql("lines", "SELECT order_id, line_no FROM lines WHERE sold_on > DATE '2000-06-30' - 365 AND sold_on <= DATE '2000-06-30'"))
def _(spark, sf):
    from ledgerlift.functions.dates import in_lookback

    return sales_lines(spark, sf).filter(in_lookback(F.col("sold_on"), F.lit("2000-06-30").cast("date"), 365)).select("order_id", "line_no")


@query("flt_09_reference_date", sql("lines", "SELECT max(sold_on) AS reference_date FROM lines"))
def _(spark, sf):
    return sales_lines(spark, sf).agg(F.max("sold_on").alias("reference_date"))


_PANEL = """
WITH s AS (SELECT o_custkey AS id, o_orderdate::DATE AS d FROM orders), r AS (SELECT min(d) + 365 AS a, max(d) AS b FROM s),
pts AS (SELECT last_day(m)::DATE AS p FROM r, unnest(generate_series(date_trunc('month', a), date_trunc('month', b), INTERVAL 1 MONTH)) t(m) WHERE last_day(m) BETWEEN a AND b),
cut AS (SELECT p AS first_test FROM pts ORDER BY p DESC LIMIT 1 OFFSET (SELECT greatest(1, floor(count(*) * 0.2))::INTEGER - 1 FROM pts))
SELECT c_custkey::VARCHAR AS business_id, p AS snapshot_date, month(p)::INTEGER AS snapshot_month, quarter(p)::INTEGER AS snapshot_quarter,
 CASE WHEN EXISTS (SELECT 1 FROM s WHERE id = c_custkey AND d > p - 365 AND d <= p) THEN 1 ELSE 0 END AS label,
 CASE WHEN p >= first_test THEN 'test' ELSE 'train' END AS part FROM customer, pts, cut"""


@query("ft_06_snapshot_panel", _PANEL)
def _(spark, sf):
    ids = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("business_id"))
    sales = table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("business_id"), F.col("o_orderdate").cast("date").alias("sold_on"))
    return ft.training_panel(ids, sales)


@query("ft_07_time_split", f"SELECT part, count(DISTINCT snapshot_date) AS dates, count(*) AS panel_rows, sum(label)::BIGINT AS positives FROM ({_PANEL}) GROUP BY part")
def _(spark, sf):
    ids = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("business_id"))
    sales = table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("business_id"), F.col("o_orderdate").cast("date").alias("sold_on"))
    return ft.training_panel(ids, sales).groupBy("part").agg(
        F.count_distinct("snapshot_date").alias("dates"), F.count("*").alias("panel_rows"), F.sum("label").alias("positives")
    )


@query("jn_09_range_join", """
WITH pts AS (SELECT last_day(m)::DATE AS p FROM unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-03-01', INTERVAL 1 MONTH)) t(m))
SELECT DISTINCT user_id, p AS point FROM events, pts WHERE ts::DATE > p - 20 AND ts::DATE <= p""")
def _(spark, sf):
    from ledgerlift.operators.lookup import interval_members

    e = table(spark, sf, "events")
    months = F.sequence(F.trunc(F.min("ts"), "month"), F.expr("add_months(trunc(max(ts), 'month'), 2)"), F.expr("interval 1 month"))
    points = e.agg(months.alias("m")).select(F.explode("m").alias("d")).select(F.last_day("d").alias("point"))
    return interval_members(e, "user_id", "ts", points, "point", 20)


_S = ",\n ".join(
    [f"coalesce(sum(total_value) FILTER (year(sold_on) = {y}), 0) AS {n}" for y, n in ((1998, "sales_y1_eur"), (1999, "sales_y2_eur"), (2000, "actual_sales_y3_eur"), (2001, "sales_y4_ytd_eur"))]
    + [f"coalesce(sum(total_value) FILTER (year(sold_on) = 1999 AND quarter(sold_on) = {q}), 0) AS sales_y2_q{q}_eur" for q in (1, 2, 3, 4)]
)
CTES["facts"] = (("hist",), f"""
SELECT business_id, {_S}, max(date_trunc('month', sold_on)::DATE) FILTER (year(sold_on) IN (1998, 1999)) AS last_purchase,
 count(DISTINCT date_trunc('month', sold_on)) FILTER (year(sold_on) IN (1998, 1999)) AS m12, count(DISTINCT date_trunc('month', sold_on)) FILTER (year(sold_on) = 1999) AS m2,
 count(DISTINCT line_id) FILTER (year(sold_on) = 1999) AS rows2, count(DISTINCT product_group) FILTER (year(sold_on) = 1999) AS groups2 FROM hist WHERE business_id IS NOT NULL GROUP BY 1""")
_Z = ", ".join(f"coalesce({c}, 0) AS {c}" for c in ("sales_y1_eur", "sales_y2_eur", "actual_sales_y3_eur", "sales_y4_ytd_eur", "sales_y2_q1_eur", "sales_y2_q2_eur", "sales_y2_q3_eur", "sales_y2_q4_eur"))
CTES["history"] = (("facts", "acc"), f"""
SELECT *, CASE WHEN active_months_y2 > 0 THEN sales_y2_eur / active_months_y2 ELSE 0 END AS avg_monthly_sales_y2_eur,
 coalesce(sales_y2_eur / nullif(sales_y1_eur, 0), CASE WHEN sales_y2_eur > 0 THEN 2 ELSE 0 END) AS sales_momentum,
 coalesce((sales_y2_q3_eur + sales_y2_q4_eur) / nullif(sales_y2_q1_eur + sales_y2_q2_eur, 0), CASE WHEN sales_y2_q3_eur + sales_y2_q4_eur > 0 THEN 2 ELSE 0 END) AS h2_vs_h1,
 CASE WHEN actual_sales_y3_eur > sales_y2_eur * 1.10 AND actual_sales_y3_eur - sales_y2_eur > 1000 THEN 1 ELSE 0 END AS grew_y3,
 CASE WHEN actual_sales_y3_eur > 0 THEN 1 ELSE 0 END AS bought_y3 FROM
(SELECT business_id, customer_name, {_Z}, coalesce(m12, 0)::DOUBLE AS active_months_y1_y2, coalesce(m2, 0)::DOUBLE AS active_months_y2, coalesce(rows2, 0)::DOUBLE AS order_rows_y2,
 coalesce(groups2, 0)::DOUBLE AS product_group_count_y2, greatest(coalesce(date_diff('day', last_purchase, DATE '2000-01-01'), 9999), 0)::INTEGER AS days_since_last_purchase
FROM (SELECT business_id, arg_min(account_name, account_id) AS customer_name FROM acc WHERE business_id IS NOT NULL GROUP BY 1) LEFT JOIN facts USING (business_id))""")


def history_frame(spark, sf):
    return ft.history_features(accounts(spark, sf), history_lines(spark, sf), y3=Y3)


_R4 = ("sales_y1_eur", "sales_y2_eur", "actual_sales_y3_eur", "sales_y4_ytd_eur", "sales_y2_q1_eur", "sales_y2_q2_eur", "sales_y2_q3_eur", "sales_y2_q4_eur")
_PLAIN = ("active_months_y1_y2", "active_months_y2", "order_rows_y2", "product_group_count_y2", "days_since_last_purchase", "grew_y3", "bought_y3")
_R6 = ("sales_momentum", "h2_vs_h1")


@query("ft_08_history_features", sql("history", f"""
SELECT business_id, customer_name, {', '.join(f'round({c}, 4) AS {c}' for c in _R4)}, {', '.join(_PLAIN)}, {', '.join(f'round({c}, 6) AS {c}' for c in _R6)} FROM history"""))
def _(spark, sf):
    return history_frame(spark, sf).select(
        "business_id", "customer_name", *[F.round(c, 4).alias(c) for c in _R4], *_PLAIN, *[F.round(c, 6).alias(c) for c in _R6]
    )


CTES["ann"] = (("lines",), """
SELECT ytd, 12.0::DOUBLE / ytd AS simple_factor, full_y / same AS factor FROM (SELECT *, (SELECT sum(total_value) FROM lines WHERE year(sold_on) = 2000) AS full_y,
 (SELECT sum(total_value) FROM lines WHERE year(sold_on) = 2000 AND month(sold_on) <= ytd) AS same FROM (SELECT count(DISTINCT month(sold_on)) AS ytd FROM lines WHERE year(sold_on) = 2001))""")
CTES["forward"] = (("history", "ann"), """
SELECT *, coalesce(recent_two_year_avg_eur / nullif(older_two_year_avg_eur, 0), CASE WHEN recent_two_year_avg_eur > 0 THEN 1.25 ELSE 1 END) AS recent_vs_older_ratio,
 coalesce(sales_y4_annualized_eur / nullif(actual_sales_y3_eur, 0), CASE WHEN sales_y4_annualized_eur > 0 THEN 1.1 ELSE 1 END) AS ytd_vs_y3_ratio FROM
(SELECT *, 0.10 * sales_y1_eur + 0.20 * sales_y2_eur + 0.35 * actual_sales_y3_eur + 0.35 * sales_y4_annualized_eur AS recent_weighted_sales_base_eur,
 (actual_sales_y3_eur + sales_y4_annualized_eur) / 2 AS recent_two_year_avg_eur, (sales_y1_eur + sales_y2_eur) / 2 AS older_two_year_avg_eur
 FROM (SELECT *, sales_y4_ytd_eur * factor AS sales_y4_annualized_eur FROM history, ann))""")


@query("ft_09_forward_features", sql("forward", """
SELECT business_id, ytd::INTEGER AS ytd_months, round(factor, 8) AS annualization_factor, round(sales_y4_annualized_eur, 2) AS sales_y4_annualized_eur,
 round(recent_weighted_sales_base_eur, 2) AS recent_weighted_sales_base_eur, round(recent_vs_older_ratio, 6) AS recent_vs_older_ratio, round(ytd_vs_y3_ratio, 6) AS ytd_vs_y3_ratio FROM forward"""))
def _(spark, sf):
    return ft.forward_features(history_frame(spark, sf), sales_lines(spark, sf), y3=Y3).select(
        "business_id", "ytd_months", F.round("annualization_factor", 8).alias("annualization_factor"), F.round("sales_y4_annualized_eur", 2).alias("sales_y4_annualized_eur"),
        F.round("recent_weighted_sales_base_eur", 2).alias("recent_weighted_sales_base_eur"), F.round("recent_vs_older_ratio", 6).alias("recent_vs_older_ratio"),
        F.round("ytd_vs_y3_ratio", 6).alias("ytd_vs_y3_ratio"),
    )


CTES["custs"] = (("comp",), f"""
SELECT *, coalesce(revenue_k_eur * 5, 0) AS model_estimated_potential_eur, coalesce(revenue_k_eur * 5, 0) * 0.4 AS expected_potential_eur,
 coalesce(revenue_k_eur * 5, 0) * 0.8 AS conditional_potential_eur, coalesce(headcount / 1500.0, 0.3) AS probability_of_growth, coalesce(headcount / 1500.0, 0.3) AS score,
 CASE WHEN revenue_k_eur >= 90000 THEN 'A' WHEN revenue_k_eur >= 60000 THEN 'B' WHEN revenue_k_eur >= 30000 THEN 'C' WHEN revenue_k_eur IS NOT NULL THEN 'D' END AS priority
FROM ({SEGMENT_SQL} comp))""")


def scored_customers(spark, sf):
    """Companies with segments and simple model figures, for the steps after scoring."""
    revenue = F.col("revenue_k_eur")
    potential = F.coalesce(revenue * 5, F.lit(0.0))
    chance = F.coalesce(F.col("headcount") / 1500.0, F.lit(0.3))
    return bk.add_segment_features(companies(spark, sf)).withColumns({
        "model_estimated_potential_eur": potential, "expected_potential_eur": potential * 0.4, "conditional_potential_eur": potential * 0.8,
        "probability_of_growth": chance, "score": chance, "company": F.col("company_name"),
        "priority": F.when(revenue >= 90000, "A").when(revenue >= 60000, "B").when(revenue >= 30000, "C").when(revenue.isNotNull(), "D"),
        "estimated_potential_eur": potential, "rank": F.crc32(F.col("business_id")), "segment_lift": F.lit(1.0),
    })


@query("ft_10_current_model_signals", sql("history custs", """
SELECT h.business_id, coalesce(c.expected_potential_eur, 0) AS current_model_expected_eur, coalesce(c.conditional_potential_eur, 0) AS current_model_conditional_eur,
 coalesce(c.probability_of_growth, 0) AS current_probability_of_growth, c.priority FROM history h LEFT JOIN custs c USING (business_id)"""))
def _(spark, sf):
    return ft.with_current_model(history_frame(spark, sf), scored_customers(spark, sf)).select(
        "business_id", "current_model_expected_eur", "current_model_conditional_eur", "current_probability_of_growth", "priority"
    )


@query("ft_11_sanitize_features", sql("comp", """
SELECT business_id, coalesce(CASE WHEN headcount > 0 THEN revenue_k_eur / headcount END, 0) AS per_head, coalesce(growth_pct, 0) AS growth_pct, industry FROM comp"""))
def _(spark, sf):
    raw = companies(spark, sf).withColumn(
        "per_head", F.when(F.col("headcount") > 0, F.col("revenue_k_eur") / F.col("headcount")).when(F.col("headcount") == 0, float("inf")).otherwise(float("nan"))
    )
    return ft.sanitize(raw, ["per_head", "growth_pct"], ["industry"], fill=0.0).select("business_id", "per_head", "growth_pct", "industry")


@query("ft_12_profile_enrichment", sql("acc custs", """
SELECT DISTINCT a.business_id, coalesce(industry, 'unknown') AS industry, coalesce(company_segment, 'unknown') AS company_segment, coalesce(revenue_class, 'unknown') AS revenue_class,
 round(revenue_per_employee, 4) AS revenue_per_employee FROM acc a LEFT JOIN custs USING (business_id) WHERE a.business_id IS NOT NULL"""))
def _(spark, sf):
    ids = accounts(spark, sf).filter(F.col("business_id").isNotNull()).select("business_id").distinct()
    return ft.profile_enrichment(ids, bk.add_segment_features(companies(spark, sf))).select(
        "business_id", "industry", "company_segment", "revenue_class", F.round("revenue_per_employee", 4).alias("revenue_per_employee")
    )


@query("ft_13_scoring_snapshot", sql("comp", "SELECT business_id, DATE '2001-07-31' AS snapshot_date, 7 AS snapshot_month, 3 AS snapshot_quarter FROM comp"))
def _(spark, sf):
    return ft.scoring_snapshot(companies(spark, sf), "2001-07-31").select("business_id", "snapshot_date", "snapshot_month", "snapshot_quarter")


@query("tg_07_training_sales", sql("hist", f"""
SELECT line_id, business_id, round(total_value * CASE line_no WHEN 1 THEN 1.0::DOUBLE WHEN 2 THEN 0.95 WHEN 3 THEN 0.85 WHEN 4 THEN 0.8 WHEN 5 THEN 0.75 WHEN 6 THEN 0.7 ELSE 0.0 END, 6) AS weighted_sales_eur
FROM hist WHERE status = 'Invoiced' AND business_id IS NOT NULL AND group_code IS NOT NULL AND group_code NOT IN ('SMALL bolt', 'LARGE gear') AND lower(trim(customer_status)) IN ('active', 'active+')"""))
def _(spark, sf):
    return training_sales(spark, sf).select("line_id", "business_id", F.round("weighted_sales_eur", 6).alias("weighted_sales_eur"))


def training_sales(spark, sf):
    """Confidence-weighted invoiced lines of eligible customers with a group."""
    from ledgerlift.functions.numbers import clip
    from ledgerlift.plans.targets import status_in

    lines = ft.without_groups(ft.invoiced_only(history_lines(spark, sf)), "group_code", EXCLUDED)
    lines = lines.filter(F.col("business_id").isNotNull() & F.col("group_code").isNotNull() & status_in(F.col("customer_status"), ("active", "active+")))
    confidence = bk.match_confidence(F.col("product_group_match_method"), rule_order="first")
    return lines.withColumns({"sales_eur": F.col("total_value"), "product_group_match_confidence": confidence}).withColumn(
        "weighted_sales_eur", F.col("sales_eur") * clip(F.col("product_group_match_confidence"), 0, 1)
    )
