"""Queries for joins, aggregations, ranking, sorting, set and array operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlift.catalog.bindings import CTES, accounts, companies, crm_potentials, products, sales_lines, sql, table
from ledgerlift.catalog.queries_features import history_lines, scored_customers
from ledgerlift.catalog.queries_recommend import product_sales
from ledgerlift.catalog.queries_scalar import name_for_matching_sql
from ledgerlift.catalog.registry import query
from ledgerlift.functions import buckets as bk
from ledgerlift.functions import text as tx
from ledgerlift.operators import aggregates as ag
from ledgerlift.operators import lookup as lk
from ledgerlift.operators import ranking as rk
from ledgerlift.plans import crm as cr

# --------------------------------------------------------------------------- joins


@query("jn_01_left_join", sql("lines acc", """
SELECT a.category, a.customer_status, count(*) AS line_count, round(sum(total_value), 4) AS total_value FROM lines LEFT JOIN acc a USING (account_id) GROUP BY ALL"""))
def _(spark, sf):
    per_account = sales_lines(spark, sf).groupBy("account_id").agg(F.count("*").alias("n"), F.sum("total_value").alias("v"))
    joined = per_account.join(accounts(spark, sf), "account_id", "left")
    return joined.groupBy("category", "customer_status").agg(F.sum("n").alias("line_count"), F.round(F.sum("v"), 4).alias("total_value"))


@query("jn_02_many_to_one", sql("lines acc", "SELECT order_id, line_no, business_id FROM lines LEFT JOIN acc USING (account_id)"))
def _(spark, sf):
    keys = accounts(spark, sf).select("account_id", "business_id")
    return lk.many_to_one(sales_lines(spark, sf), keys, ["account_id"], "accounts").select("order_id", "line_no", "business_id")


@query("jn_03_inner_join", """
SELECT p_brand, count(*) AS line_count, sum(l_quantity) AS quantity FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size > 25 GROUP BY 1""")
def _(spark, sf):
    sums = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))
    p = table(spark, sf, "part").filter("p_size > 25")
    return sums.join(p, sums.l_partkey == p.p_partkey).groupBy("p_brand").agg(F.sum("n").alias("line_count"), F.sum("q").alias("quantity"))


@query("jn_04_full_outer", """
SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'left_only' WHEN a.k IS NULL THEN 'right_only' ELSE 'both' END AS side, a.orders_before, b.orders_after FROM
(SELECT o_custkey AS k, count(*) AS orders_before FROM orders WHERE o_orderdate < '1995-06-01' GROUP BY 1) a FULL JOIN (SELECT o_custkey AS k, count(*) AS orders_after FROM orders WHERE o_orderdate >= '2001-02-01' GROUP BY 1) b USING (k)""")
def _(spark, sf):
    o = table(spark, sf, "orders").withColumnRenamed("o_custkey", "k")
    before = o.filter("o_orderdate < '1995-06-01'").groupBy("k").agg(F.count("*").alias("orders_before"))
    after = o.filter("o_orderdate >= '2001-02-01'").groupBy("k").agg(F.count("*").alias("orders_after"))
    return lk.full_compare(before, after, ["k"])


@query("jn_05_semi_anti", """
SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS has_invoiced,
 c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate >= '2001-07-01') AS inactive FROM customer""")
def _(spark, sf):
    o = table(spark, sf, "orders")
    out = lk.flag_member(table(spark, sf, "customer"), "c_custkey", o.filter("o_orderstatus = 'F'"), "o_custkey", "has_invoiced")
    out = lk.flag_member(out, "c_custkey", o.filter("o_orderdate >= '2001-07-01'"), "o_custkey", "recent")
    return out.select("c_custkey", "has_invoiced", (~F.col("recent")).alias("inactive"))


@query("jn_06_customer_by_group", sql("custs psales", """
SELECT c.business_id, g.product_group, coalesce(o.v, 0) AS v FROM (SELECT business_id FROM custs) c CROSS JOIN
 (SELECT DISTINCT product_group FROM psales WHERE product_group IS NOT NULL) g
LEFT JOIN (SELECT business_id, product_group, round(sum(sales_eur), 4) AS v FROM psales GROUP BY ALL) o ON o.business_id = c.business_id AND o.product_group = g.product_group"""))
def _(spark, sf):
    from ledgerlift.plans.backtest import customer_group_grid

    sold = product_sales(spark, sf)
    own = sold.groupBy("business_id", "product_group").agg(F.round(F.sum("sales_eur"), 4).alias("v"))
    grid = customer_group_grid(scored_customers(spark, sf).select("business_id"), sold.filter(F.col("product_group").isNotNull()), "product_group", "sales_eur")
    return grid.join(own, ["business_id", "product_group"], "left").select("business_id", "product_group", F.coalesce("v", F.lit(0.0)).alias("v"))


@query("jn_08_multi_key_join", sql("custs psales", """
SELECT c.company_segment, p.product_group, count(*) AS pairs, round(sum(s.sales_eur), 4) AS sales_eur FROM psales s JOIN custs c USING (business_id)
JOIN (SELECT company_segment, product_group FROM psales JOIN custs USING (business_id) GROUP BY 1, 2 HAVING count(*) > 10) p ON p.company_segment = c.company_segment AND p.product_group = s.product_group GROUP BY 1, 2"""))
def _(spark, sf):
    joined = product_sales(spark, sf).join(scored_customers(spark, sf).select("business_id", "company_segment"), "business_id")
    common = joined.groupBy("company_segment", "product_group").agg(F.count("*").alias("n")).filter("n > 10").drop("n")
    return joined.join(common, ["company_segment", "product_group"]).groupBy("company_segment", "product_group").agg(
        F.count("*").alias("pairs"), F.round(F.sum("sales_eur"), 4).alias("sales_eur")
    )


_NAMES = {
    "an": f"SELECT DISTINCT {name_for_matching_sql('account_name')} AS nk, business_id FROM acc WHERE business_id IS NOT NULL",
    "byname": f"SELECT nk, arg_min(business_id, account_id) AS business_id FROM (SELECT *, {name_for_matching_sql('account_name')} AS nk FROM acc WHERE business_id IS NOT NULL) GROUP BY 1",
    "s0": f"""SELECT crm_row_id, {name_for_matching_sql('name')} AS nk, coalesce(c.business_id, a.business_id) AS bid, CASE WHEN c.business_id IS NOT NULL THEN 'business_id' WHEN a.business_id IS NOT NULL THEN 'account_id' END AS m
 FROM crm c LEFT JOIN acc a ON a.account_id = c.account_id""",
    "s1": "SELECT s0.crm_row_id, s0.nk, coalesce(bid, b.business_id) AS bid, coalesce(m, CASE WHEN b.business_id IS NOT NULL THEN 'name' END) AS m FROM s0 LEFT JOIN byname b ON b.nk = s0.nk",
    "hits": """SELECT crm_row_id, min(business_id) AS bid FROM s1 JOIN an ON (contains(s1.nk, an.nk) OR contains(an.nk, s1.nk)) AND length(an.nk) >= 4 WHERE s1.bid IS NULL AND length(s1.nk) >= 4
 GROUP BY 1 HAVING count(DISTINCT business_id) = 1""",
}


@query("jn_10_cascading_match", sql("crm acc", """
SELECT s1.crm_row_id, coalesce(s1.bid, h.bid) AS business_id, coalesce(m, CASE WHEN h.bid IS NOT NULL THEN 'contained_name' END) AS match_method FROM s1 LEFT JOIN hits h USING (crm_row_id)""", _NAMES))
def _(spark, sf):
    return cr.match_customers(crm_potentials(spark, sf), accounts(spark, sf)).select("crm_row_id", "business_id", "match_method")


@query("jn_11_unique_lookup", sql("prod", """
SELECT k, min(product_group_l1_name) AS product_group_l1_name FROM (SELECT split_part(product_name, ' ', 1) || ' ' || size AS k, product_group_l1_name FROM prod)
WHERE product_group_l1_name IS NOT NULL GROUP BY 1 HAVING count(DISTINCT product_group_l1_name) = 1"""))
def _(spark, sf):
    p = products(spark, sf).withColumn("k", F.concat_ws(" ", F.substring_index("product_name", " ", 1), F.col("size").cast("string")))
    return lk.unique_lookup(p.filter(F.col("product_group_l1_name").isNotNull()), ["k"], ["product_group_l1_name"])


@query("jn_13_index_join", """
SELECT DISTINCT s_suppkey, p_partkey FROM supplier, part WHERE p_partkey = s_suppkey * 3 OR (p_partkey = s_suppkey + 17) OR (p_partkey % 100 = s_suppkey AND p_size = s_nationkey)""")
def _(spark, sf):
    s, p = table(spark, sf, "supplier"), table(spark, sf, "part")
    key = F.col("s_suppkey")
    left = F.array((key * 3).cast("string"), (key + 17).cast("string"), F.concat_ws("/", key.cast("string"), F.col("s_nationkey").cast("string")))
    right = F.array(F.col("p_partkey").cast("string"), F.concat_ws("/", (F.col("p_partkey") % 100).cast("string"), F.col("p_size").cast("string")))
    return lk.index_join(s, "s_suppkey", left, p, "p_partkey", right)


_TOK = r"[A-Z0-9][A-Z0-9._/-]{4,}"


@query("jn_14_token_in_text", f"""
WITH w AS (SELECT DISTINCT doc_id, regexp_replace(t, '^[._/-]+|[._/-]+$', '', 'g') AS k FROM (SELECT doc_id, unnest(regexp_extract_all(upper(replace(text, 'ß', 'ss')), '{_TOK}')) AS t FROM documents)),
r AS (SELECT DISTINCT item_id, regexp_replace(t, '^[._/-]+|[._/-]+$', '', 'g') AS k FROM (SELECT item_id, unnest(regexp_extract_all(upper(replace(text, 'ß', 'ss')), '{_TOK}')) AS t FROM benchmark) WHERE length(t) >= 5),
few AS (SELECT k FROM w GROUP BY 1 HAVING count(*) <= 5)
SELECT DISTINCT item_id, doc_id FROM r JOIN few USING (k) JOIN w USING (k)""")
def _(spark, sf):
    b, d = table(spark, sf, "benchmark"), table(spark, sf, "documents")
    keys = F.regexp_extract_all(F.upper("text"), F.lit(f"({_TOK})"), F.lit(1))
    return lk.token_in_text_join(b, "item_id", keys, d, "doc_id", F.col("text"))


@query("jn_15_unique_contains", """
WITH t AS (SELECT p_partkey, lower(p_name) || ' ' || lower(p_brand) AS txt FROM part), n AS (SELECT DISTINCT lower(p_name) || ' brand#' || p_size AS nm FROM part WHERE p_size <= 25)
SELECT p_partkey, min(nm) AS name_found FROM t JOIN n ON contains(txt, nm) GROUP BY 1 HAVING count(DISTINCT nm) = 1""")
def _(spark, sf):
    p = table(spark, sf, "part")
    texts = p.select("p_partkey", F.concat_ws(" ", F.lower("p_name"), F.lower("p_brand")).alias("txt"))
    names = p.filter("p_size <= 25").select(F.concat(F.lower("p_name"), F.lit(" brand#"), F.col("p_size").cast("string")).alias("nm")).distinct()
    hits = lk.contained_names(texts, "p_partkey", "txt", names, "nm")
    return hits.groupBy("p_partkey").agg(F.min("nm").alias("name_found"), F.max("nm").alias("_hi")).filter("name_found = _hi").drop("_hi")


@query("jn_16_fuzzy_join")
def _(spark, sf):
    titles = F.lower(F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1))
    pages = table(spark, sf, "pages").select("page_id", titles.alias("t"))
    master = pages.filter("page_id % 2 = 0").select(F.col("t").alias("master_name")).distinct()
    asked = pages.select(F.regexp_replace(F.col("t"), "^(.{5}).", "$1x").alias("asked_name")).distinct()
    return lk.fuzzy_best(asked, "asked_name", master, "master_name").withColumn("similarity", F.round("similarity", 6))


@query("jn_17_before_after", """
SELECT p_partkey, p_size AS before_size, CASE WHEN p_size % 5 = 0 THEN p_size * 2 ELSE p_size END AS after_size FROM part WHERE p_size % 5 = 0""")
def _(spark, sf):
    from ledgerlift.plans.compare import changed_rows

    before = table(spark, sf, "part").select("p_partkey", "p_size")
    after = before.withColumn("p_size", F.when(F.col("p_size") % 5 == 0, F.col("p_size") * 2).otherwise(F.col("p_size")))
    return changed_rows(before, after, ["p_partkey"], ["p_size"]).select("p_partkey", F.col("before_p_size").alias("before_size"), F.col("after_p_size").alias("after_size"))


@query("jn_19_product_key_lookup", sql("prod", """
SELECT key, arg_min(src, i * 100000000 + product_id) AS key_source, arg_min(struct_pack(g := product_group_l3_name), i * 100000000 + product_id).g AS product_group_l3_name FROM (
SELECT lower(trim(sku)) AS key, 'sku' AS src, 0 AS i, product_id, product_group_l3_name FROM prod UNION ALL SELECT lower(trim(code)), 'code', 1, product_id, product_group_l3_name FROM prod
UNION ALL SELECT product_id::VARCHAR, 'product_id', 2, product_id, product_group_l3_name FROM prod UNION ALL SELECT lower(trim(product_name)), 'product_name', 3, product_id, product_group_l3_name FROM prod
UNION ALL SELECT lower(trim(title_fi)), 'title_fi', 4, product_id, product_group_l3_name FROM prod) WHERE key IS NOT NULL GROUP BY 1"""))
def _(spark, sf):
    return lk.first_of_columns(products(spark, sf), ["sku", "code", "product_id", "product_name", "title_fi"], ["product_group_l3_name"], "product_id")


# --------------------------------------------------------------------------- aggregations


@query("ag_01_basic", "SELECT o_custkey, sum(o_totalprice) AS total, count(*) AS n, round(avg(o_totalprice), 7) AS mean, max(o_totalprice) AS top, arg_min(o_orderpriority, o_orderkey) AS first_priority FROM orders GROUP BY 1".replace("sum(o_totalprice) AS total", "round(sum(o_totalprice), 2) AS total"))
def _(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.round(F.sum("o_totalprice"), 2).alias("total"), F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 7).alias("mean"),
        F.max("o_totalprice").alias("top"), F.min_by("o_orderpriority", "o_orderkey").alias("first_priority"),
    )


@query("ag_02_sum_of_nothing", "SELECT c_custkey, round(coalesce(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 0), 2) AS invoiced FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def _(spark, sf):
    sums = table(spark, sf, "orders").groupBy("o_custkey").agg(F.sum(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))).alias("v"))
    c = table(spark, sf, "customer")
    return c.join(sums, c.c_custkey == sums.o_custkey, "left").select("c_custkey", F.round(F.coalesce("v", F.lit(0.0)), 2).alias("invoiced"))


@query("ag_03_count_distinct", sql("hist", "SELECT business_id, count(DISTINCT product_id) AS products, count(DISTINCT order_id) AS orders, count(DISTINCT product_group) AS groups FROM hist WHERE business_id IS NOT NULL GROUP BY 1"))
def _(spark, sf):
    return history_lines(spark, sf).filter(F.col("business_id").isNotNull()).groupBy("business_id").agg(
        F.count_distinct("product_id").alias("products"), F.count_distinct("order_id").alias("orders"), F.count_distinct("product_group").alias("groups")
    )


@query("ag_04_conditional_counts", "SELECT l_partkey, count_if(l_discount > 0.05)::BIGINT AS discounted, bool_or(l_returnflag = 'R') AS any_returned, round(coalesce(sum(l_extendedprice) FILTER (l_linestatus = 'F'), 0), 2) AS closed_value FROM lineitem GROUP BY 1")
def _(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_partkey").agg(
        ag.count_where(F.col("l_discount") > 0.05).alias("discounted"), F.bool_or(F.col("l_returnflag") == "R").alias("any_returned"),
        F.round(ag.sum_where(F.col("l_extendedprice"), F.col("l_linestatus") == "F"), 2).alias("closed_value"),
    )


@query("ag_05_folded_strings", """
WITH f AS (SELECT o_custkey, year(o_orderdate) AS y, array_to_string(list_sort(list(DISTINCT o_orderpriority)), ', ') AS p FROM orders GROUP BY 1, 2)
SELECT o_custkey, array_to_string(list_sort(list(DISTINCT trim(x))), ', ') AS priorities FROM (SELECT o_custkey, unnest(string_split(p, ',')) AS x FROM f) GROUP BY 1""")
def _(spark, sf):
    o = table(spark, sf, "orders").withColumn("y", F.year("o_orderdate"))
    return ag.merge_folded(ag.fold_distinct(o, ["o_custkey", "y"], "o_orderpriority", "p"), ["o_custkey"], "p", "priorities")


@query("ag_06_sample_values", """
SELECT p_brand, array_to_string(list(p_name ORDER BY r), ' | ') AS examples FROM (SELECT p_brand, p_name, row_number() OVER (PARTITION BY p_brand ORDER BY min(p_partkey)) AS r FROM part GROUP BY 1, 2) WHERE r <= 8 GROUP BY 1""")
def _(spark, sf):
    return ag.sample_values(table(spark, sf, "part"), ["p_brand"], "p_name", "p_partkey", "examples", 8)


@query("ag_07_quantiles", """
SELECT o_orderstatus, q AS quantile, round(quantile_cont(o_totalprice, q), 4) AS value FROM orders, (SELECT unnest([0.1, 0.25, 0.5, 0.75, 0.9])::DOUBLE AS q) GROUP BY 1, 2""".replace("quantile_cont(o_totalprice, q)", "CASE q WHEN 0.1 THEN quantile_cont(o_totalprice, 0.1) WHEN 0.25 THEN quantile_cont(o_totalprice, 0.25) WHEN 0.5 THEN quantile_cont(o_totalprice, 0.5) WHEN 0.75 THEN quantile_cont(o_totalprice, 0.75) ELSE quantile_cont(o_totalprice, 0.9) END"))
def _(spark, sf):
    return rk.exact_quantiles(table(spark, sf, "orders"), ["o_orderstatus"], "o_totalprice", [0.1, 0.25, 0.5, 0.75, 0.9]).withColumn("value", F.round("value", 4))


@query("ag_08_share_of_total", """
SELECT o_custkey, o_orderstatus, round(sum(o_totalprice) / sum(sum(o_totalprice)) OVER (PARTITION BY o_custkey), 9) AS share, round(sum(o_totalprice) / sum(sum(o_totalprice)) OVER (), 12) AS overall_share FROM orders GROUP BY 1, 2""")
def _(spark, sf):
    sums = table(spark, sf, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.sum("o_totalprice").alias("v"))
    out = ag.share_of_total(ag.share_of_total(sums, ["o_custkey"], "v", "share"), [], "v", "overall_share")
    return out.select("o_custkey", "o_orderstatus", F.round("share", 9).alias("share"), F.round("overall_share", 12).alias("overall_share"))


@query("ag_09_pivot_years", "SELECT o_custkey, " + ", ".join(f"round(coalesce(sum(o_totalprice) FILTER (year(o_orderdate) = {y}), 0), 2) AS y{y}" for y in range(1995, 2003)) + " FROM orders GROUP BY 1")
def _(spark, sf):
    o = table(spark, sf, "orders").withColumn("y", F.year("o_orderdate"))
    out = ag.pivot_sum(o, ["o_custkey"], "y", "o_totalprice", {y: f"y{y}" for y in range(1995, 2003)})
    return out.select("o_custkey", *[F.round(f"y{y}", 2).alias(f"y{y}") for y in range(1995, 2003)])


@query("ag_10_argmax_row", "SELECT p_type, arg_max(p_name, p_retailprice * 1000 - p_partkey / 1000000.0) AS p_name, max(p_retailprice) AS p_retailprice FROM part GROUP BY 1")
def _(spark, sf):
    return ag.argmax_row(table(spark, sf, "part"), ["p_type"], "p_retailprice", ["p_partkey"]).select("p_type", "p_name", "p_retailprice")


@query("ag_11_most_frequent", """
SELECT o_custkey, o_orderpriority, value_count FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY value_count DESC, seen, o_orderpriority) AS r FROM
 (SELECT o_custkey, o_orderpriority, count(*) AS value_count, min(o_orderkey) AS seen FROM orders GROUP BY 1, 2)) WHERE r = 1""")
def _(spark, sf):
    return ag.most_frequent(table(spark, sf, "orders"), ["o_custkey"], ["o_orderpriority"], "o_orderkey")


STOP = ("the", "and", "que", "les", "der", "die")


@query("ag_12_top_words", f"""
SELECT word, count(*) AS word_count FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-zåäö0-9]{{3,}}')) AS word FROM documents) WHERE word NOT IN {STOP} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 40""")
def _(spark, sf):
    return ag.top_words(table(spark, sf, "documents"), F.col("text"), 40, STOP)


@query("ag_13_level_summary", """
SELECT p_type AS l1, p_brand AS l2, p_size AS l3, (3 - grouping(p_type) - grouping(p_brand) - grouping(p_size))::INTEGER AS level, count(*) AS product_count, round(sum(p_retailprice), 2) AS price_sum
FROM part GROUP BY GROUPING SETS ((p_type), (p_type, p_brand), (p_type, p_brand, p_size))""")
def _(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_type").alias("l1"), F.col("p_brand").alias("l2"), F.col("p_size").alias("l3"), "p_retailprice")
    return ag.level_summary(p, ["l1", "l2", "l3"], {"product_count": F.count("*"), "price_sum": F.round(F.sum("p_retailprice"), 2)})


@query("ag_14_metric_row", """
SELECT metric, value FROM (SELECT count(*)::DOUBLE AS lines, round(sum(l_quantity), 2) AS quantity, count_if(l_returnflag = 'R')::DOUBLE AS returned, count(DISTINCT l_partkey)::DOUBLE AS parts FROM lineitem)
UNPIVOT (value FOR metric IN (lines, quantity, returned, parts))""")
def _(spark, sf):
    return ag.metrics_long(table(spark, sf, "lineitem"), {
        "lines": F.count("*"), "quantity": F.round(F.sum("l_quantity"), 2), "returned": F.count_if(F.col("l_returnflag") == "R"), "parts": F.count_distinct("l_partkey"),
    })


@query("ag_15_line_collapse", """
SELECT l_orderkey, l_partkey, l_returnflag, l_linestatus, l_shipdate::DATE AS shipped, count(*) AS row_count, sum(l_quantity) AS amount, round(sum(l_quantity * l_extendedprice), 2) AS sales FROM lineitem GROUP BY 1, 2, 3, 4, 5""")
def _(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey", "l_partkey", "l_returnflag", "l_linestatus", F.col("l_shipdate").cast("date").alias("shipped")).agg(
        F.count("*").alias("row_count"), F.sum("l_quantity").alias("amount"), F.round(F.sum(F.col("l_quantity") * F.col("l_extendedprice")), 2).alias("sales")
    )


@query("ag_16_account_months", sql("months", "SELECT account_id, strftime(created_at, '%Y-%m') AS created_year_month, round(total_value, 6) AS total_value FROM months"))
def _(spark, sf):
    from ledgerlift.catalog.bindings import sales_months

    return sales_months(spark, sf).select("account_id", F.date_format("created_at", "yyyy-MM").alias("created_year_month"), F.round("total_value", 6).alias("total_value"))


@query("ag_17_two_stage", sql("custs psales", "SELECT company_segment, count(*) AS buyers, round(avg(v), 2) AS mean_sales FROM (SELECT company_segment, business_id, sum(sales_eur) AS v FROM psales JOIN custs USING (business_id) GROUP BY 1, 2) GROUP BY 1"))
def _(spark, sf):
    per_customer = product_sales(spark, sf).groupBy("business_id").agg(F.sum("sales_eur").alias("v"))
    return per_customer.join(scored_customers(spark, sf).select("business_id", "company_segment"), "business_id").groupBy("company_segment").agg(
        F.count("*").alias("buyers"), F.round(F.avg("v"), 2).alias("mean_sales")
    )


_R = "Muut / tarkistettavat"


def _consolidate_sql(minimum: int, rounds: int = 5) -> str:
    steps = ["t0 AS (SELECT p_partkey, p_type AS l1, p_brand AS l2, p_name AS l3, 'start' AS src FROM part)"]
    for i in range(rounds):
        steps.append(f"""t{i + 1} AS (SELECT p_partkey, CASE WHEN n < {minimum} AND NOT k THEN '{_R}' ELSE l1 END AS l1, CASE WHEN n < {minimum} THEN CASE WHEN k THEN 'Muut ' || lower(l1) ELSE '{_R}' END ELSE l2 END AS l2,
 CASE WHEN n < {minimum} THEN CASE WHEN k THEN 'Muut ' || lower(l1) ELSE '{_R}' END ELSE l3 END AS l3, src || CASE WHEN n < {minimum} AND (l1, l2, l3) IS DISTINCT FROM (CASE WHEN k THEN l1 ELSE '{_R}' END, CASE WHEN k THEN 'Muut ' || lower(l1) ELSE '{_R}' END,
 CASE WHEN k THEN 'Muut ' || lower(l1) ELSE '{_R}' END) THEN '|min_leaf' ELSE '' END AS src
 FROM (SELECT *, count(*) OVER (PARTITION BY l1, l2, l3) AS n, count(*) OVER (PARTITION BY l1) >= {minimum} AND l1 <> '{_R}' AS k FROM t{i}))""")
    return "WITH " + ",\n".join(steps) + f"""
SELECT p_partkey, CASE WHEN n < {minimum} THEN '{_R}' ELSE l1 END AS l1, CASE WHEN n < {minimum} THEN '{_R}' ELSE l2 END AS l2, CASE WHEN n < {minimum} THEN '{_R}' ELSE l3 END AS l3,
 src || CASE WHEN n < {minimum} THEN '|review_bucket' ELSE '' END AS src FROM (SELECT *, count(*) OVER (PARTITION BY l1, l2, l3) AS n FROM t{rounds})"""


@query("ag_18_min_leaf_consolidation", _consolidate_sql(3))
def _(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.col("p_type").alias("l1"), F.col("p_brand").alias("l2"), F.col("p_name").alias("l3"), F.lit("start").alias("src"))
    return ag.consolidate_small(p, ["l1", "l2", "l3"], 3, "src")


# --------------------------------------------------------------------------- ranking


@query("wn_02_rank_nulls_last", sql("comp", "SELECT business_id, row_number() OVER (ORDER BY revenue_k_eur DESC NULLS LAST, business_id) AS revenue_rank FROM comp"))
def _(spark, sf):
    return rk.global_row_number(companies(spark, sf).select("business_id", "revenue_k_eur"), [("revenue_k_eur", "desc"), ("business_id", "asc")], "revenue_rank").drop("revenue_k_eur")


@query("wn_03_rank_in_group", "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS price_rank FROM lineitem")
def _(spark, sf):
    li = table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey")
    ranked = rk.grouped_row_number(li, ["l_suppkey"], [("l_extendedprice", "desc"), ("l_orderkey", "asc"), ("l_linenumber", "asc"), ("l_partkey", "asc")], "price_rank")
    return ranked.select("l_orderkey", "l_linenumber", "price_rank")


@query("wn_04_top_n_per_group", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return rk.top_n(o, ["o_custkey"], [("o_totalprice", "desc"), ("o_orderkey", "asc")], 3).drop("rank")


@query("wn_05_group_totals", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey), 2) AS customer_total, count(*) OVER (PARTITION BY o_custkey) AS customer_orders FROM orders")
def _(spark, sf):
    out = rk.group_totals(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), ["o_custkey"], {"t": F.sum("o_totalprice"), "customer_orders": F.count("*")})
    return out.select("o_orderkey", F.round("t", 2).alias("customer_total"), "customer_orders")


@query("wn_06_keep_first", "SELECT o_custkey, o_orderkey, o_orderdate::DATE AS ordered FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r = 1")
def _(spark, sf):
    return rk.first_per_key(table(spark, sf, "orders"), ["o_custkey"], [("o_orderdate", "asc"), ("o_orderkey", "asc")]).select(
        "o_custkey", "o_orderkey", F.col("o_orderdate").cast("date").alias("ordered")
    )


@query("wn_08_best_vs_second", """
SELECT o_custkey, round(a - coalesce(b, 0), 2) AS margin FROM (SELECT o_custkey, max(o_totalprice) FILTER (r = 1) AS a, max(o_totalprice) FILTER (r = 2) AS b FROM
 (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 2 GROUP BY 1)""")
def _(spark, sf):
    two = rk.top_n(table(spark, sf, "orders"), ["o_custkey"], [("o_totalprice", "desc"), ("o_orderkey", "asc")], 2, "r")
    best, second = (F.max(F.when(F.col("r") == i, F.col("o_totalprice"))) for i in (1, 2))
    return two.groupBy("o_custkey").agg(F.round(best - F.coalesce(second, F.lit(0.0)), 2).alias("margin"))


@query("so_01_stable_sort", sql("comp", "SELECT row_number() OVER (ORDER BY industry NULLS LAST, headcount DESC NULLS LAST, business_id) AS place, business_id, industry, headcount FROM comp"))
def _(spark, sf):
    c = companies(spark, sf).select("business_id", "industry", "headcount")
    return rk.global_row_number(c, [("industry", "asc"), ("headcount", "desc"), ("business_id", "asc")], "place")


@query("so_02_head_after_sort", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def _(spark, sf):
    return rk.head(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), [("o_totalprice", "desc"), ("o_orderkey", "asc")], 100)


@query("so_03_smallest_ranks", sql("comp", "SELECT business_id, revenue_rank FROM (SELECT business_id, row_number() OVER (ORDER BY revenue_k_eur DESC NULLS LAST, business_id) AS revenue_rank FROM comp) WHERE revenue_rank <= 25"))
def _(spark, sf):
    top = rk.head(companies(spark, sf).select("business_id", "revenue_k_eur"), [("revenue_k_eur", "desc"), ("business_id", "asc")], 25)
    return rk.global_row_number(top, [("revenue_k_eur", "desc"), ("business_id", "asc")], "revenue_rank").select("business_id", "revenue_rank")


@query("so_04_ordered_selection", sql("psales", """
SELECT t.place, t.business_id, g.product_group, g.r AS group_place FROM (SELECT business_id, row_number() OVER (ORDER BY round(sum(sales_eur), 4) DESC, business_id) AS place FROM psales GROUP BY 1) t
JOIN (SELECT business_id, product_group, row_number() OVER (PARTITION BY business_id ORDER BY round(sum(sales_eur), 4) DESC, product_group) AS r FROM psales WHERE product_group IS NOT NULL GROUP BY 1, 2) g USING (business_id)
WHERE place <= 100 AND g.r <= 3"""))
def _(spark, sf):
    sold = product_sales(spark, sf)
    best = rk.head(sold.groupBy("business_id").agg(F.round(F.sum("sales_eur"), 4).alias("v")), [("v", "desc"), ("business_id", "asc")], 100)
    places = rk.global_row_number(best, [("v", "desc"), ("business_id", "asc")], "place").select("business_id", "place")
    groups = sold.join(places.select("business_id"), "business_id", "left_semi").filter(F.col("product_group").isNotNull())
    groups = groups.groupBy("business_id", "product_group").agg(F.round(F.sum("sales_eur"), 4).alias("v"))
    top = rk.top_n(groups, ["business_id"], [("v", "desc"), ("product_group", "asc")], 3, "group_place")
    return places.join(top, "business_id").select("place", "business_id", "product_group", F.col("group_place").cast("bigint").alias("group_place"))


@query("so_05_quota_top", """
WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice, o_orderstatus = 'F' AS s, row_number() OVER (PARTITION BY o_custkey, o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders),
k AS (SELECT *, count_if(s AND n = 1) OVER (PARTITION BY o_custkey) AS t FROM r)
SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM k WHERE (s AND n = 1) OR (NOT s AND n <= 5 - t)""")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus")
    out = rk.quota_top(o, ["o_custkey"], [("o_totalprice", "desc"), ("o_orderkey", "asc")], limit=5, special=F.col("o_orderstatus") == "F")
    return out.select("o_custkey", "o_orderkey", F.col("rank").cast("bigint").alias("rank"))


# --------------------------------------------------------------------------- sets


@query("st_01_union_differing", """
SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, NULL::INTEGER AS nation FROM customer UNION ALL SELECT s_suppkey, s_name, NULL, s_nationkey FROM supplier""")
def _(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    return c.unionByName(s, allowMissingColumns=True)


@query("st_02_distinct_by_subset", "SELECT p_brand, p_type, min(p_partkey) AS p_partkey FROM part GROUP BY 1, 2")
def _(spark, sf):
    return rk.first_per_key(table(spark, sf, "part"), ["p_brand", "p_type"], [("p_partkey", "asc")]).select("p_brand", "p_type", "p_partkey")


@query("st_03_top_overlap", """
WITH a AS (SELECT o_custkey AS id FROM orders WHERE year(o_orderdate) = 1999 GROUP BY 1 ORDER BY round(sum(o_totalprice), 2) DESC, 1 LIMIT 100), b AS (SELECT o_custkey AS id FROM orders WHERE year(o_orderdate) = 2000 GROUP BY 1 ORDER BY round(sum(o_totalprice), 2) DESC, 1 LIMIT 100)
SELECT 100::BIGINT AS top_n, (SELECT count(*) FROM a WHERE id IN (SELECT id FROM b)) AS overlap, (SELECT count(*) FROM a WHERE id NOT IN (SELECT id FROM b)) AS dropped, (SELECT count(*) FROM b WHERE id NOT IN (SELECT id FROM a)) AS entered""")
def _(spark, sf):
    from ledgerlift.plans.compare import top_overlap

    sums = table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("y"), F.col("o_custkey").alias("id")).agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    return top_overlap(sums.filter("y = 1999"), sums.filter("y = 2000"), "id", [("v", "desc"), ("id", "asc")], [100])


@query("st_04_union_of_ids", sql("acc", "SELECT business_id FROM acc WHERE business_id IS NOT NULL UNION SELECT parent_business_id FROM acc WHERE parent_business_id IS NOT NULL"))
def _(spark, sf):
    a = accounts(spark, sf)
    ids = a.select("business_id").union(a.select("parent_business_id"))
    return ids.filter(F.col("business_id").isNotNull()).distinct()


@query("st_05_append_missing", sql("crm custs", """
SELECT business_id, 'crm' AS origin FROM crm WHERE business_id IS NOT NULL UNION ALL SELECT business_id, 'missing_in_crm' FROM custs WHERE business_id NOT IN (SELECT business_id FROM crm WHERE business_id IS NOT NULL)"""))
def _(spark, sf):
    crm = crm_potentials(spark, sf).filter(F.col("business_id").isNotNull()).select("business_id", F.lit("crm").alias("origin"))
    known = scored_customers(spark, sf).select("business_id")
    return crm.unionByName(known.join(crm, "business_id", "left_anti").withColumn("origin", F.lit("missing_in_crm")))


# --------------------------------------------------------------------------- arrays and JSON


@query("ar_01_split_and_count", "SELECT marker, count(*) AS n FROM (SELECT unnest(string_split(p_type || '|' || p_name, '|')) AS marker FROM part) GROUP BY 1")
def _(spark, sf):
    marks = F.split(F.concat_ws("|", "p_type", "p_name"), r"\|")
    return table(spark, sf, "part").select(F.explode(marks).alias("marker")).groupBy("marker").agg(F.count("*").alias("n"))


@query("ar_04_json_lists", """
SELECT o_custkey, '[' || string_agg('{"order":' || o_orderkey || ',"priority":"' || o_orderpriority || '"}', ',' ORDER BY r) || ']' AS recommended FROM
(SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3 GROUP BY 1""")
def _(spark, sf):
    top = rk.top_n(table(spark, sf, "orders"), ["o_custkey"], [("o_totalprice", "desc"), ("o_orderkey", "asc")], 3, "r")
    items = F.array_sort(F.collect_list(F.struct("r", F.struct(F.col("o_orderkey").alias("order"), F.col("o_orderpriority").alias("priority")).alias("x"))))
    return top.groupBy("o_custkey").agg(F.to_json(F.transform(items, lambda i: i["x"])).alias("recommended"))


@query("ar_05_label_list", """
SELECT o_custkey, string_agg(o_orderpriority || ' ' || o_orderkey, ', ' ORDER BY r) AS labels FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 5 GROUP BY 1""")
def _(spark, sf):
    top = rk.top_n(table(spark, sf, "orders"), ["o_custkey"], [("o_totalprice", "desc"), ("o_orderkey", "asc")], 5, "r")
    items = F.array_sort(F.collect_list(F.struct("r", F.concat_ws(" ", "o_orderpriority", F.col("o_orderkey").cast("string")).alias("t"))))
    return top.groupBy("o_custkey").agg(F.array_join(F.transform(items, lambda i: i["t"]), ", ").alias("labels"))


@query("ar_06_default_rows", sql("custs", """
SELECT business_id, CASE WHEN headcount > 500 THEN coalesce(revenue_k_eur, 0) ELSE 0 END AS annual_potential_estimate_eur, CASE WHEN headcount > 500 THEN 'A' ELSE 'Partner' END AS potential_segment,
 '[]' AS recommended_products, '' AS recommended_product_labels FROM custs"""))
def _(spark, sf):
    from ledgerlift.plans.recommend import empty_recommendations

    c = scored_customers(spark, sf)
    some = c.filter("headcount > 500").select(
        "business_id", F.col("revenue_k_eur").alias("annual_potential_estimate_eur"), F.lit("A").alias("potential_segment"),
        F.lit(None).cast("string").alias("recommended_products"), F.lit(None).cast("string").alias("recommended_product_labels"),
    )
    return empty_recommendations(c, some)
