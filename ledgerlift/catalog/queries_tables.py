"""Queries for sources, sinks, column handling, quality checks and run comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlift.catalog.bindings import accounts, companies, products, sales_lines, sales_months, sql, table
from ledgerlift.catalog.queries_features import history_lines, prepared_history, scored_customers
from ledgerlift.catalog.queries_recommend import product_sales
from ledgerlift.catalog.queries_scalar import fold_sql
from ledgerlift.catalog.registry import query
from ledgerlift.plans import compare as cm
from ledgerlift.plans import crm as cr
from ledgerlift.plans import enrich as en
from ledgerlift.plans import quality as qa
from ledgerlift.plans import taxonomy as tax
from ledgerlift.session import stage_path
from ledgerlift.sources import columns as co
from ledgerlift.sources import readers as rd
from ledgerlift.sources import sinks as sk

# --------------------------------------------------------------------------- sources: written from the test tables, read back


@query("src_01_csv_scan", "SELECT c_custkey::VARCHAR AS c_custkey, c_name, c_mktsegment FROM customer")
def _(spark, sf):
    path = stage_path(spark, "csv")
    table(spark, sf, "customer").select(F.col("c_custkey").alias("﻿c_custkey"), "c_name", "c_mktsegment").write.option("header", True).csv(path)
    return rd.read_csv(spark, path)


@query("src_02_csv_sniffed", "SELECT p_partkey::VARCHAR AS p_partkey, p_name, p_brand FROM part")
def _(spark, sf):
    path = stage_path(spark, "csv")
    table(spark, sf, "part").select("p_partkey", "p_name", "p_brand").write.option("header", True).option("sep", ";").csv(path)
    return rd.read_csv_sniffed(spark, path)


@query("src_03_parquet_scan", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= '2001-01-01'")
def _(spark, sf):
    return rd.read_source(spark, {"type": "parquet", "path": f"{sf}/orders.parquet"}).filter("o_orderdate >= '2001-01-01'").select("o_orderkey", "o_totalprice")


@query("src_04_json_scan", "SELECT event_id, event_type, value FROM events")
def _(spark, sf):
    path = stage_path(spark, "json")
    table(spark, sf, "events").select("event_id", "event_type", "value").write.json(path)
    return rd.read_json(spark, path, schema="event_id long, event_type string, value double")


@query("src_05_gzip_records", "SELECT s_suppkey, s_name, s_nationkey::BIGINT AS s_nationkey FROM supplier")
def _(spark, sf):
    path = stage_path(spark, "gzip")
    table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey").withColumn("g", F.col("s_nationkey")).groupBy("g").agg(
        F.collect_list(F.struct("s_suppkey", "s_name", "s_nationkey")).alias("items")
    ).select("items").write.option("compression", "gzip").json(path)
    return rd.read_records(spark, path, lines=True).select("s_suppkey", "s_name", "s_nationkey")


@query("src_06_account_documents", "SELECT o_custkey AS account_id, o_orderkey AS id, o_totalprice AS price FROM orders")
def _(spark, sf):
    path = stage_path(spark, "documents")
    items = F.collect_list(F.struct(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price")))
    table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("account_id")).agg(items.alias("data")).write.json(path)
    return rd.read_account_documents(spark, path, lines=True).select("account_id", "id", "price")


@query("src_07_account_columns", """
SELECT c_custkey, string_agg(o_orderpriority || ':' || o_orderstatus || ':' || (o_orderkey % 100) || ':' || o_orderkey || ':', '; ' ORDER BY o_orderkey) AS potentials FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def _(spark, sf):
    o = table(spark, sf, "orders")
    item = F.struct(
        "o_orderkey", F.col("o_orderpriority").alias("type"), F.col("o_orderstatus").alias("state"), (F.col("o_orderkey") % 100).alias("probability"),
        F.col("o_orderkey").alias("value"), F.lit(None).cast("string").alias("comment"),
    )
    docs = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.array_sort(F.collect_list(item)).alias("potentials"), F.collect_set(F.struct(F.col("o_orderpriority").alias("name"), F.lit(None).cast("string").alias("email"))).alias("salespersons")
    )
    return rd.fold_account_columns(docs).select("c_custkey", "potentials")


@query("src_08_flatten_products", "SELECT p_partkey AS record_id, p_name AS code, 2 AS options_count, 'T ' || p_name || chr(10) || 'U ' || p_type AS title_fi, 'D ' || p_brand AS description_en FROM part")
def _(spark, sf):
    text = lambda lang, code, value: F.struct(F.lit(lang).alias("lang"), F.lit(code).alias("code"), value.alias("content"))
    docs = table(spark, sf, "part").select(
        "p_partkey", F.struct(F.col("p_name").alias("code"), F.col("p_size").alias("status")).alias("info"), F.array(F.lit(1), F.lit(2)).alias("options"),
        F.array(text("FI", "title", F.concat(F.lit("T "), "p_name")), text("fi", "Title", F.concat(F.lit("U "), "p_type")), text("en", "description", F.concat(F.lit("D "), "p_brand"))).alias("texts"),
    )
    return rd.flatten_products(docs, record_id=F.col("p_partkey"), text_columns=["title_fi", "description_en"]).drop("status")


@query("src_09_table_or_query", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1")
def _(spark, sf):
    table(spark, sf, "customer").createOrReplaceTempView("ledgerlift_customer")
    return rd.read_source(spark, {"type": "query", "sql": "SELECT c_mktsegment, count(*) AS n FROM ledgerlift_customer GROUP BY c_mktsegment"})


@query("src_10_counted_scan", "SELECT l_shipdate::DATE AS l_shipdate, count(*) AS row_count FROM lineitem GROUP BY 1")
def _(spark, sf):
    return rd.count_values(table(spark, sf, "lineitem").select(F.col("l_shipdate").cast("date").alias("l_shipdate")), "l_shipdate")


@query("src_11_supplier_lists", """
SELECT 'a' AS source_file, p_name AS product_name, p_size::DOUBLE AS gross_weight_kg, NULL::DOUBLE AS width_cm FROM part WHERE p_partkey % 3 = 0 AND p_size % 4 <> 0
UNION ALL SELECT 'b', s_name, NULL, s_nationkey::DOUBLE FROM supplier""")
def _(spark, sf):
    p = table(spark, sf, "part").filter("p_partkey % 3 = 0")
    a = p.select(F.lit("a").alias("source_file"), F.array("p_name").alias("match_keys"), F.col("p_name").alias("product_name"), F.when(F.col("p_size") % 4 != 0, F.col("p_size").cast("double")).alias("gross_weight_kg"))
    b = table(spark, sf, "supplier").select(F.lit("b").alias("source_file"), F.array(F.lit(""), F.col("s_name")).alias("match_keys"), F.col("s_name").alias("product_name"), F.col("s_nationkey").cast("double").alias("width_cm"))
    return rd.supplier_records([a, b]).select("source_file", "product_name", "gross_weight_kg", "width_cm")


@query("src_12_optional_source", "SELECT c_custkey, NULL::VARCHAR AS note FROM customer")
def _(spark, sf):
    notes = rd.read_source(spark, None)
    c = table(spark, sf, "customer").select("c_custkey")
    return c.join(notes, "c_custkey", "left") if notes is not None else c.withColumn("note", F.lit(None).cast("string"))


@query("src_13_first_row_header", "SELECT n_name, n_regionkey::VARCHAR AS n_regionkey FROM nation")
def _(spark, sf):
    n = table(spark, sf, "nation")
    first = n.agg(F.lit(-1).alias("i"), F.lit("n_name").alias("_c0"), F.lit("n_regionkey").alias("_c1"), F.count("*")).select("i", "_c0", "_c1")
    sheet = n.select(F.col("n_nationkey").alias("i"), F.col("n_name").alias("_c0"), F.col("n_regionkey").cast("string").alias("_c1")).unionByName(first)
    return rd.promote_first_row(sheet, "i").drop("i")


# --------------------------------------------------------------------------- sinks: written, then read back


@query("snk_01_csv_write", "SELECT n_nationkey, n_name FROM nation")
def _(spark, sf):
    path = stage_path(spark, "out")
    sk.write_csv(table(spark, sf, "nation").select("n_nationkey", "n_name"), path)
    return rd.read_csv(spark, path, schema="n_nationkey int, n_name string")


@query("snk_02_table_write", "SELECT c_mktsegment, 2 * count(*) AS n FROM customer GROUP BY 1")
def _(spark, sf):
    path = stage_path(spark, "table")
    name = "ledgerlift_" + path.rsplit("-", 1)[1]
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    sk.write_table(c, name, path=path)
    sk.write_table(c, name, "append", path=path)
    return spark.table(name).groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query("snk_03_export_modes", "SELECT r_regionkey, r_name FROM region")
def _(spark, sf):
    path = stage_path(spark, "out")
    sk.export(table(spark, sf, "region").select("r_regionkey", "r_name"), "csv", path=path)
    return rd.read_csv(spark, path, schema="r_regionkey int, r_name string")


@query("snk_04_complex_to_json", "SELECT vec_id, '[' || array_to_string(list_transform([label, vec_id], lambda x : x::VARCHAR), ',') || ']' AS pair FROM embeddings")
def _(spark, sf):
    return sk.complex_to_json(table(spark, sf, "embeddings").select("vec_id", F.array(F.col("label").cast("bigint"), "vec_id").alias("pair")))


@query("snk_05_metrics_document", "SELECT metric, value FROM (SELECT count(*)::DOUBLE AS lines, sum(l_quantity) AS quantity FROM lineitem) UNPIVOT (value FOR metric IN (lines, quantity))")
def _(spark, sf):
    from ledgerlift.operators.aggregates import metrics_long

    path = stage_path(spark, "metrics")
    sk.write_metrics(metrics_long(table(spark, sf, "lineitem"), {"lines": F.count("*"), "quantity": F.sum("l_quantity")}), path)
    return spark.read.schema("metric string, value double").json(path)


@query("snk_06_output_bundle", "SELECT 'customers' AS table_name, count(*) AS n FROM customer UNION ALL SELECT 'suppliers', count(*) FROM supplier")
def _(spark, sf):
    folder = stage_path(spark, "bundle")
    sk.write_bundle({"customers": table(spark, sf, "customer"), "suppliers": table(spark, sf, "supplier")}, folder, "run-1")
    counts = [spark.read.parquet(f"{folder}/{t}").filter("run_id = 'run-1'").agg(F.lit(t).alias("table_name"), F.count("*").alias("n")) for t in ("customers", "suppliers")]
    return counts[0].unionByName(counts[1])


@query("snk_07_run_keyed_results", "SELECT run_id, count(*) AS n FROM (SELECT unnest(['a', 'b']) AS run_id), customer WHERE run_id = 'a' OR c_custkey % 2 = 0 GROUP BY 1")
def _(spark, sf):
    folder = stage_path(spark, "runs")
    c = table(spark, sf, "customer")
    for run, rows in (("a", c.limit(0)), ("b", c.filter("c_custkey % 2 = 0")), ("a", c)):
        sk.write_bundle({"scores": rows}, folder, run)
    return spark.read.parquet(f"{folder}/scores").groupBy(F.col("run_id").cast("string").alias("run_id")).agg(F.count("*").alias("n"))


# --------------------------------------------------------------------------- columns


@query("col_01_resolve_columns", "SELECT c_custkey AS account_id, c_name AS account_name, NULL::VARCHAR AS country FROM customer")
def _(spark, sf):
    raw = table(spark, sf, "customer").select(F.col("c_custkey").alias("Account ID"), F.col("c_name").alias("Käyntiosoite / Nimi"))
    return co.rename_resolved(raw, {"account_id": ["account_id"], "account_name": ["kayntiosoite nimi"], "country": ["maa"]})


@query("col_02_required_columns", "SELECT c_custkey FROM customer")
def _(spark, sf):
    return co.require(table(spark, sf, "customer"), ["c_custkey", "c_name"], "customer").select("c_custkey")


@query("col_03_normal_accounts", "SELECT c_custkey AS account_id, c_name AS account_name, c_mktsegment AS customer_status FROM customer")
def _(spark, sf):
    raw = table(spark, sf, "customer").select(F.col("c_custkey").alias("ID"), F.col("c_name").alias("Company Name"), F.col("c_mktsegment").alias("category"))
    return co.normal_accounts(raw).select("account_id", "account_name", "customer_status")


@query("col_04_value_column", "SELECT o_orderkey, o_totalprice AS net_sales, 'total' AS sales_value_source_column FROM orders")
def _(spark, sf):
    raw = table(spark, sf, "orders").select("o_orderkey", F.replace(F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit("."), F.lit(",")).alias("total"))
    return co.choose_value(raw, ["net_sales", "total", "price"]).select("o_orderkey", "net_sales", "sales_value_source_column")


_LOWEST = """SELECT product_id, CASE WHEN product_group_l3_name IS NOT NULL THEN 'L3' WHEN product_group_l2_name IS NOT NULL THEN 'L2' END AS lowest_product_group_level,
 coalesce(product_group_l3_name, product_group_l2_name) AS lowest_product_group_name FROM prod"""


@query("col_05_group_level_columns", sql("prod", _LOWEST))
def _(spark, sf):
    return co.lowest_group(products(spark, sf).withColumnsRenamed({f"product_group_l{i}_name": f"Tuoteryhmä L{i} nimi" for i in (1, 2, 3)})).select(
        "product_id", "lowest_product_group_level", "lowest_product_group_name"
    )


@query("col_06_lowest_group", sql("prod", _LOWEST.replace("'L3'", "'L3'")))
def _(spark, sf):
    return co.lowest_group(products(spark, sf)).select("product_id", "lowest_product_group_level", "lowest_product_group_name")


@query("col_07_coalesce_chain", sql("prod", "SELECT product_id, coalesce(product_group_l3_name, title_fi, product_group_l1_name, brand_name) AS first_known FROM prod"))
def _(spark, sf):
    return products(spark, sf).select("product_id", co.first_of("product_group_l3_name", "title_fi", "product_group_l1_name", "brand_name").alias("first_known"))


@query("col_08_set_if_missing", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_retailprice ELSE p_size::DOUBLE END AS weight FROM part")
def _(spark, sf):
    current = F.when(F.col("p_size") % 2 == 0, F.when(F.col("p_size") % 4 == 0, 0.0)).otherwise(F.col("p_size").cast("double"))
    return table(spark, sf, "part").select("p_partkey", en.set_if_missing(current, F.col("p_retailprice")).alias("weight"))


@query("col_09_overwrite_nonzero", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_retailprice ELSE p_size::DOUBLE END AS weight FROM part")
def _(spark, sf):
    new = F.when(F.col("p_size") % 3 == 0, F.col("p_retailprice")).when(F.col("p_size") % 3 == 1, 0.0)
    return table(spark, sf, "part").select("p_partkey", en.overwrite_if_nonzero(F.col("p_size").cast("double"), new).alias("weight"))


@query("col_10_prefix_flag", sql("prod", "SELECT product_id, CASE WHEN sku LIKE 'DIF%' THEN 1 ELSE 0 END AS is_dif FROM prod"))
def _(spark, sf):
    return products(spark, sf).select("product_id", co.prefix_flag(F.col("sku"), "DIF").alias("is_dif"))


@query("col_12_first_filled", sql("prod", "SELECT product_id, coalesce(CASE WHEN product_id % 2 = 0 THEN sku END, product_name) AS product_key FROM prod"))
def _(spark, sf):
    p = products(spark, sf).withColumn("sku", F.when(F.col("product_id") % 2 == 0, F.col("sku")).otherwise(" "))
    return p.select("product_id", co.first_filled(p, ["sku", "nothing", "product_name"]).alias("product_key"))


@query("col_13_drop_listed", "SELECT c_custkey, c_name FROM customer")
def _(spark, sf):
    return co.drop_listed(table(spark, sf, "customer"), ["c_acctbal", "c_mktsegment", "c_nationkey", "not_there"])


# --------------------------------------------------------------------------- quality

_EX = "group_code IN ('SMALL bolt', 'LARGE gear')"
EXCLUDED = ("SMALL bolt", "LARGE gear")


@query("qa_01_sales_quality", sql("hist", f"""
SELECT metric, value FROM (SELECT count(*)::DOUBLE AS source_sales_rows, round(sum(total_value), 2) AS source_sales_eur, count_if(status = 'Invoiced')::DOUBLE AS invoiced_sales_rows, count_if(group_code IS NULL)::DOUBLE AS missing_product_group_rows,
 count_if(status = 'Invoiced' AND {_EX})::DOUBLE AS excluded_product_group_rows, count_if(status = 'Invoiced' AND (group_code IS NULL OR NOT {_EX}))::DOUBLE AS model_sales_rows_after_filters,
 round(100 * sum(total_value) FILTER (status = 'Invoiced' AND (group_code IS NULL OR NOT {_EX})) / sum(total_value), 2) AS model_sales_coverage_pct FROM hist)
UNPIVOT (value FOR metric IN (source_sales_rows, source_sales_eur, invoiced_sales_rows, missing_product_group_rows, excluded_product_group_rows, model_sales_rows_after_filters, model_sales_coverage_pct))"""))
def _(spark, sf):
    out = qa.sales_quality(history_lines(spark, sf), statuses=["Invoiced"], group="group_code", excluded=EXCLUDED)
    wanted = ["source_sales_rows", "source_sales_eur", "invoiced_sales_rows", "missing_product_group_rows", "excluded_product_group_rows", "model_sales_rows_after_filters", "model_sales_coverage_pct"]
    return out.filter(F.col("metric").isin(*wanted))


@query("qa_01_confidence_by_method", sql("shist", "SELECT product_group_match_method, count(*) AS lines, round(avg(product_group_match_confidence), 4) AS avg_confidence FROM shist GROUP BY 1"))
def _(spark, sf):
    return qa.confidence_by_method(prepared_history(spark, sf))


@query("qa_02_input_validation", sql("lines acc comp", """
SELECT metric, value FROM (SELECT (SELECT count(*) FROM lines)::DOUBLE AS sales_rows, (SELECT count_if(status = 'Invoiced') FROM lines)::DOUBLE AS invoiced_rows, (SELECT min(date_diff('day', DATE '1970-01-01', sold_on)) FROM lines)::DOUBLE AS first_day,
 (SELECT count(*) FROM lines WHERE account_id IN (SELECT account_id FROM acc))::DOUBLE AS sales_rows_in_register, (SELECT count(*) FROM acc)::DOUBLE AS account_rows, (SELECT count_if(business_id IS NULL) FROM acc)::DOUBLE AS accounts_without_business_id,
 (SELECT count(*) FROM acc WHERE business_id IN (SELECT business_id FROM comp))::DOUBLE AS accounts_in_company_register, 0::DOUBLE AS duplicate_account_id)
UNPIVOT (value FOR metric IN (sales_rows, invoiced_rows, first_day, sales_rows_in_register, account_rows, accounts_without_business_id, accounts_in_company_register, duplicate_account_id))"""))
def _(spark, sf):
    out = qa.input_validation(sales_lines(spark, sf), accounts(spark, sf), companies(spark, sf))
    return out.filter(F.col("metric").isin("sales_rows", "invoiced_rows", "first_day", "sales_rows_in_register", "account_rows", "accounts_without_business_id", "accounts_in_company_register", "duplicate_account_id"))


def _validation(spark, sf):
    c = scored_customers(spark, sf)
    crm = c.withColumn("crm_potential_eur", F.when(F.col("headcount") > 100, F.col("headcount") * 150.0).otherwise(0.0))
    return cr.model_vs_crm(crm)


_VAL = {
    "v": """SELECT *, model_estimated_potential_eur - crm AS d, CASE WHEN abs(model_estimated_potential_eur - crm) <= greatest(abs(crm) * 0.1, 1000) THEN 'exact_or_close' WHEN model_estimated_potential_eur > crm THEN 'model_higher' ELSE 'crm_higher' END AS st
 FROM (SELECT *, CASE WHEN headcount > 100 THEN headcount * 150.0::DOUBLE ELSE 0 END AS crm FROM custs)""",
}


def _recommendations(spark, sf):
    sold = product_sales(spark, sf).filter(F.col("product_group").isNotNull()).groupBy("business_id", "product_group").agg(F.round(F.sum("sales_eur"), 4).alias("customer_sales_eur"))
    return sold.withColumns({"recommended_group_potential_eur": F.col("customer_sales_eur"), "white_space_gap": F.lit(0.1)})


@query("qa_03_technical_checks", sql("custs psales", """
SELECT c AS "check", value, status FROM (VALUES ('customer_potential_rows', (SELECT count(*) FROM custs)::DOUBLE, 'info'), ('matched_model_rows', (SELECT count(model_estimated_potential_eur) FROM custs)::DOUBLE, 'info'), ('unmatched_model_rows', 0, 'pass'),
 ('missing_business_id_rows', 0, 'pass'), ('one_row_per_non_empty_business_id', 0, 'pass'), ('recommendation_rows', (SELECT count(*) FROM (SELECT DISTINCT business_id, product_group FROM psales WHERE product_group IS NOT NULL))::DOUBLE, 'info'),
 ('validation_rows', (SELECT count(*) FROM custs)::DOUBLE, 'info')) t(c, value, status)"""))
def _(spark, sf):
    return qa.technical_checks(scored_customers(spark, sf), _recommendations(spark, sf), _validation(spark, sf))


@query("qa_04_status_summary", sql("custs", 'SELECT st AS validation_match_status, count(*) AS "rows", round(count(*) / (SELECT count(*) FROM v)::DOUBLE, 9) AS share_of_rows FROM v GROUP BY 1', _VAL))
def _(spark, sf):
    return qa.status_summary(_validation(spark, sf)).withColumn("share_of_rows", F.round("share_of_rows", 9))


@query("qa_04_segment_summary", sql("custs", 'SELECT company_segment, count(*) AS "rows", round(avg(score), 9) AS avg_score, round(median(model_estimated_potential_eur), 4) AS median_potential_eur, round(sum(model_estimated_potential_eur), 2) AS total_potential_eur FROM custs GROUP BY 1'))
def _(spark, sf):
    out = qa.group_summary(scored_customers(spark, sf), "company_segment", "model_estimated_potential_eur", "score")
    return out.select(
        "company_segment", "rows", F.round("avg_score", 9).alias("avg_score"), F.round("median_potential_eur", 4).alias("median_potential_eur"), F.round("total_potential_eur", 2).alias("total_potential_eur")
    )


@query("qa_05_distribution", sql("custs", """
SELECT 'potential' AS metric, count(*) AS count, min(x) AS min, round(quantile_cont(x, 0.1), 4) AS p10, round(quantile_cont(x, 0.25), 4) AS p25, round(median(x), 4) AS median, round(quantile_cont(x, 0.75), 4) AS p75, round(quantile_cont(x, 0.9), 4) AS p90, max(x) AS max,
 round(avg(x), 4) AS mean, round(sum(x), 2) AS sum FROM (SELECT model_estimated_potential_eur AS x FROM custs)"""))
def _(spark, sf):
    d = qa.distribution(scored_customers(spark, sf), "model_estimated_potential_eur", "potential")
    return d.withColumns({**{c: F.round(c, 4) for c in ("p10", "p25", "median", "p75", "p90", "mean")}, "sum": F.round("sum", 2)})


@query("qa_06_review_queues", sql("custs psales", """
WITH r AS (SELECT business_id, product_group, round(sum(sales_eur), 4) AS x FROM psales WHERE product_group IS NOT NULL GROUP BY 1, 2),
q AS (SELECT 'top_crm_model_diff' AS queue, business_id, '' AS g, abs(d) AS value, abs(d) AS o FROM v UNION ALL SELECT 'top_model_higher', business_id, '', d, d FROM v WHERE st = 'model_higher' UNION ALL SELECT 'top_crm_higher', business_id, '', d, -d FROM v WHERE st = 'crm_higher'
 UNION ALL SELECT 'zero_crm_high_model', business_id, '', model_estimated_potential_eur, model_estimated_potential_eur FROM v WHERE crm = 0 AND model_estimated_potential_eur > 0
 UNION ALL SELECT 'a_priority_customers', business_id, '', model_estimated_potential_eur, model_estimated_potential_eur FROM custs WHERE priority = 'A'
 UNION ALL SELECT 'large_low_priority', business_id, '', model_estimated_potential_eur, model_estimated_potential_eur FROM custs WHERE priority IN ('C', 'D') AND model_estimated_potential_eur > (SELECT quantile_cont(model_estimated_potential_eur, 0.9) FROM custs)
 UNION ALL SELECT 'product_group_white_space', business_id, product_group, x, x FROM r UNION ALL SELECT 'product_group_sanity', business_id, product_group, x, x FROM r WHERE x > 0)
SELECT queue, business_id, value FROM (SELECT *, row_number() OVER (PARTITION BY queue ORDER BY o DESC, business_id, g) AS n FROM q) WHERE n <= 100""", _VAL))
def _(spark, sf):
    return qa.review_queues(scored_customers(spark, sf), _validation(spark, sf), _recommendations(spark, sf))


@query("qa_07_prior_comparison", sql("custs", """
SELECT s AS source, count(*) AS potential_count, round(median(p), 4) AS potential_median_eur, round(sum(p), 2) AS potential_total_eur FROM (SELECT 'now' AS s, model_estimated_potential_eur AS p FROM custs UNION ALL SELECT 'before', expected_potential_eur FROM custs WHERE headcount IS NOT NULL) GROUP BY 1"""))
def _(spark, sf):
    c = scored_customers(spark, sf)
    before = c.filter(F.col("headcount").isNotNull()).withColumn("model_estimated_potential_eur", F.col("expected_potential_eur"))
    out = qa.prior_comparison({"now": c, "before": before}, "score", "model_estimated_potential_eur")
    return out.select("source", "potential_count", F.round("potential_median_eur", 4).alias("potential_median_eur"), F.round("potential_total_eur", 2).alias("potential_total_eur"))


@query("qa_08_run_log", sql("custs", "SELECT 'output_rows' AS metric, count(*)::VARCHAR AS value FROM custs UNION ALL SELECT 'matched_rows', count(*)::VARCHAR FROM custs UNION ALL SELECT 'missing_business_id_rows', '0' UNION ALL SELECT 'recent_year_weight', '0.6'"))
def _(spark, sf):
    return qa.run_log(scored_customers(spark, sf), {"recent_year_weight": 0.6})


@query("qa_08_quality_rows", sql("crm", "SELECT crm_row_id, business_id, 'missing_business_id' || CASE WHEN crm_row_id % 2 = 0 THEN '; not_matched_to_model' ELSE '' END AS reason FROM crm WHERE business_id IS NULL UNION ALL SELECT crm_row_id, business_id, 'not_matched_to_model' FROM crm WHERE business_id IS NOT NULL AND crm_row_id % 2 = 0"))
def _(spark, sf):
    from ledgerlift.catalog.bindings import crm_potentials

    rows = crm_potentials(spark, sf).withColumn("model_estimated_potential_eur", F.when(F.col("crm_row_id") % 2 == 1, F.col("sales")))
    return qa.quality_rows(rows, "crm_row_id")


@query("qa_09_product_quality", """
SELECT metric, value FROM (SELECT count(*)::DOUBLE AS total_products, count_if(p_size % 2 = 0)::DOUBLE AS products_with_weight, count_if(p_size % 3 = 0)::DOUBLE AS products_with_dimensions, count_if(p_size % 5 <> 0)::DOUBLE AS products_with_full_category_hierarchy FROM part)
UNPIVOT (value FOR metric IN (total_products, products_with_weight, products_with_dimensions, products_with_full_category_hierarchy))""")
def _(spark, sf):
    s = F.col("p_size")
    p = table(spark, sf, "part").select(
        F.when(s % 2 == 0, 1.0).alias("weight_value"), F.when(s % 3 == 0, 1.0).alias("width_value"), F.lit(None).cast("double").alias("length_value"), F.lit(None).cast("double").alias("depth_value"),
        F.col("p_brand").alias("warehouse_category"), F.col("p_type").alias("category_level_2"), F.when(s % 5 != 0, F.col("p_name")).otherwise(" ").alias("category_level_3"),
    )
    return qa.product_quality(p).filter(F.col("metric").isin("total_products", "products_with_weight", "products_with_dimensions", "products_with_full_category_hierarchy"))


@query("qa_10_tree_statistics", """
WITH l AS (SELECT p_type, p_brand, count(*) AS n FROM part GROUP BY 1, 2)
SELECT metric, value FROM (SELECT (SELECT count(*) FROM part)::DOUBLE AS products, (SELECT count(*) FROM part)::DOUBLE AS grouped_products, (SELECT count_if(p_type = 'PROMO') FROM part)::DOUBLE AS other_products, count(*)::DOUBLE AS leaf_groups, max(n)::DOUBLE AS largest_leaf,
 min(n)::DOUBLE AS smallest_leaf, count_if(n < 5)::DOUBLE AS leaves_under_5 FROM l) UNPIVOT (value FOR metric IN (products, grouped_products, other_products, leaf_groups, largest_leaf, smallest_leaf, leaves_under_5))""")
def _(spark, sf):
    return qa.tree_statistics(table(spark, sf, "part"), ["p_type", "p_brand"], F.col("p_type") == "PROMO")


@query("qa_11_review_group_words", """
SELECT word, count(*) AS word_count FROM (SELECT unnest(regexp_extract_all(lower(p_name), '[a-zåäö0-9]{3,}')) AS word FROM part WHERE p_type = 'PROMO') WHERE word NOT IN ('old') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def _(spark, sf):
    from ledgerlift.operators.aggregates import top_words

    return top_words(table(spark, sf, "part").filter("p_type = 'PROMO'"), F.col("p_name"), 10, ["old"])


@query("qa_12_missing_by_name", sql("hist", """SELECT lower(product_name) AS name_key, count(*) AS "rows", round(sum(total_value), 4) AS sales_eur FROM hist WHERE group_code IS NULL GROUP BY 1"""))
def _(spark, sf):
    return qa.missing_by_name(history_lines(spark, sf), "product_name", "total_value", "group_code").withColumn("sales_eur", F.round("sales_eur", 4))


_CODED = "CASE WHEN line_id % 4 <> 0 THEN sku WHEN line_id % 8 = 0 THEN '' END"


@query("qa_12_missing_summary", sql("hist", f"""
WITH t AS (SELECT *, {_CODED} AS code, 'm' || (line_id % 3) AS method FROM hist), n AS (SELECT product_name, count(*) AS n FROM t WHERE coalesce(trim(code), '') = '' GROUP BY 1)
SELECT 'total_rows' AS metric, count(*)::DOUBLE AS value FROM t UNION ALL SELECT 'rows_with_group', count_if(coalesce(trim(group_code), '') <> '')::DOUBLE FROM t UNION ALL SELECT 'rows_missing_group', count_if(coalesce(trim(group_code), '') = '')::DOUBLE FROM t
UNION ALL SELECT 'missing_code_rows', count_if(coalesce(code, '') = '')::DOUBLE FROM t UNION ALL SELECT 'missing_code_sales_eur', round(sum(total_value) FILTER (coalesce(code, '') = ''), 2) FROM t
UNION ALL SELECT 'unique_missing_code_names', count(*)::DOUBLE FROM n UNION ALL SELECT 'repeated_missing_code_names', count_if(n > 1)::DOUBLE FROM n UNION ALL SELECT 'rows_in_repeated_missing_code_names', coalesce(sum(n) FILTER (n > 1), 0)::DOUBLE FROM n
UNION ALL SELECT 'method:' || method, count(*)::DOUBLE FROM t GROUP BY 1"""))
def _(spark, sf):
    return qa.missing_summary(_coded_history(spark, sf), name="product_name", value="total_value", code="code", group="group_code", method="method")


def _coded_history(spark, sf):
    k = F.col("line_id")
    code = F.when(k % 4 != 0, F.col("sku")).when(k % 8 == 0, "")
    return history_lines(spark, sf).withColumns({"code": code, "method": F.concat(F.lit("m"), (k % 3).cast("string"))})


@query("qa_12_missing_worklist", sql("hist", f"""
SELECT line_id, account_id || '|' || order_id || '|' || line_id AS update_key, NULL::VARCHAR AS new_code, NULL::VARCHAR AS note FROM hist WHERE coalesce({_CODED}, '') = ''"""))
def _(spark, sf):
    out = qa.missing_worklist(_coded_history(spark, sf), code="code", key=["account_id", "order_id", "line_id"], fill=["new_code", "note"])
    return out.select("line_id", "update_key", "new_code", "note")


@query("qa_11_review_groups", f"""
WITH t AS (SELECT p_type AS l1, p_brand AS l2, 'size ' || (p_size % 3) AS l3, CASE WHEN p_partkey % 3 = 0 THEN 'a|b' WHEN p_partkey % 3 = 1 THEN 'b' END AS marks, CASE WHEN p_size > 10 THEN 'S' || (p_size % 5) END AS supplier, p_brand AS brand, p_name,
  CASE p_partkey % 5 WHEN 0 THEN 'iso esite' WHEN 1 THEN 'suklaa ja lahjakortti' WHEN 2 THEN 'fanilippu' ELSE '' END AS extra FROM part WHERE p_type = 'PROMO'),
s AS (SELECT *, {fold_sql("p_name || ' ' || extra")} AS x FROM t)
SELECT 'group' AS "table", l1 || ' > ' || l2 || ' > ' || l3 AS key, count(*) AS product_count FROM t GROUP BY ALL UNION ALL SELECT 'supplier', coalesce(supplier, ''), count(*) FROM t GROUP BY ALL UNION ALL SELECT 'brand', brand, count(*) FROM t GROUP BY ALL
UNION ALL SELECT 'source', m, count(*) FROM (SELECT unnest(string_split(coalesce(marks, ''), '|')) AS m FROM t) GROUP BY ALL
UNION ALL SELECT 'suggestion', CASE WHEN contains(x, 'esite') THEN 'medium | ' || {{esite}} WHEN contains(x, 'fanilippu') THEN 'high | ' || {{flag}} WHEN contains(x, 'lahjakortti') THEN 'high | ' || {{card}} ELSE 'manual |  | no rule' END, count(*) FROM s GROUP BY ALL
UNION ALL (SELECT 'word', w, count(*) FROM (SELECT unnest(regexp_extract_all(lower(p_name || ' ' || extra), '[a-zåäö0-9]{{{{3,}}}}')) AS w FROM t) WHERE w NOT IN ('old') GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 10)""".format(
    **{n: "'" + " > ".join(p for p in r.path if p) + f" | {r.name}'" for n, r in ((n, next(r for r in tax.word_rules("review_suggestions", with_confidence=True) if w in r.words)) for n, w in (("esite", "esite"), ("flag", "fanilippu"), ("card", "lahjakortti")))}))
def _(spark, sf):
    k = F.col("p_partkey")
    rows = table(spark, sf, "part").filter("p_type = 'PROMO'").withColumns({
        "l3": F.concat(F.lit("size "), (F.col("p_size") % 3).cast("string")), "marks": F.when(k % 3 == 0, "a|b").when(k % 3 == 1, "b"),
        "supplier": F.when(F.col("p_size") > 10, F.concat(F.lit("S"), (F.col("p_size") % 5).cast("string"))), "extra": F.when(k % 5 == 0, "iso esite").when(k % 5 == 1, "suklaa ja lahjakortti").when(k % 5 == 2, "fanilippu").otherwise(""),
    })
    return qa.review_analysis(
        rows, tax.word_rules("review_suggestions", with_confidence=True), levels=["p_type", "p_brand", "l3"], source="marks", supplier="supplier", brand="p_brand", texts=["p_name", "extra"], stop_words=["old"], words=10,
    )


@query("qa_13_status_impact", sql("hist", f"""
WITH u AS (SELECT * FROM hist WHERE group_code IS NULL OR NOT {_EX})
SELECT metric, value FROM (SELECT count_if(status = 'Invoiced')::DOUBLE AS current_rows, round(coalesce(sum(total_value) FILTER (status = 'Invoiced'), 0), 2) AS current_eur, (count(DISTINCT account_id) FILTER (status = 'Invoiced'))::DOUBLE AS current_accounts,
 count_if(trim(status) = 'processed')::DOUBLE AS increment_rows, round(coalesce(sum(total_value) FILTER (trim(status) = 'processed'), 0), 2) AS increment_eur, (count(DISTINCT account_id) FILTER (trim(status) = 'processed'))::DOUBLE AS increment_accounts,
 count_if(trim(status) IN ('Invoiced', 'processed'))::DOUBLE AS combined_rows, round(coalesce(sum(total_value) FILTER (trim(status) IN ('Invoiced', 'processed')), 0), 2) AS combined_eur,
 (count(DISTINCT account_id) FILTER (trim(status) IN ('Invoiced', 'processed')))::DOUBLE AS combined_accounts FROM u)
 UNPIVOT (value FOR metric IN (current_rows, current_eur, current_accounts, increment_rows, increment_eur, increment_accounts, combined_rows, combined_eur, combined_accounts))"""))
def _(spark, sf):
    return qa.status_impact(history_lines(spark, sf), "Invoiced", "processed", "group_code", EXCLUDED)


@query("qa_13_status_by_year", sql("lines", """SELECT year(sold_on)::INTEGER AS year, trim(status) AS status, count(*) AS "rows", round(sum(total_value), 2) AS sales_eur, count(DISTINCT account_id) AS accounts FROM lines WHERE trim(status) IN ('Invoiced', 'processed') GROUP BY 1, 2"""))
def _(spark, sf):
    return qa.status_by_year(sales_lines(spark, sf), ["Invoiced", "processed"])


@query("qa_14_account_join_audit", sql("months acc", """
SELECT metric, value FROM (SELECT count(*)::DOUBLE AS accounts, count_if(hit)::DOUBLE AS accounts_found, round(100.0 * count_if(hit) / count(*), 2)::DOUBLE AS accounts_found_pct, round(100 * sum(v) FILTER (hit) / sum(v), 2) AS eur_found_pct FROM
 (SELECT account_id, sum(total_value) AS v, account_id IN (SELECT account_id FROM acc WHERE business_id IS NOT NULL) AS hit FROM months GROUP BY 1)) UNPIVOT (value FOR metric IN (accounts, accounts_found, accounts_found_pct, eur_found_pct))"""))
def _(spark, sf):
    return qa.account_join_audit(sales_months(spark, sf), accounts(spark, sf).filter(F.col("business_id").isNotNull()))


# --------------------------------------------------------------------------- comparison


@query("cm_01_metric_deltas", """
SELECT metric, a AS previous, b AS current, b - a AS delta FROM (SELECT 'orders' AS metric, (SELECT count(*) FROM orders WHERE year(o_orderdate) = 1999)::DOUBLE AS a, (SELECT count(*) FROM orders WHERE year(o_orderdate) = 2000)::DOUBLE AS b
 UNION ALL SELECT 'customers', (SELECT count(DISTINCT o_custkey) FROM orders WHERE year(o_orderdate) = 1999), (SELECT count(DISTINCT o_custkey) FROM orders WHERE year(o_orderdate) = 2000))""")
def _(spark, sf):
    o = table(spark, sf, "orders")
    metrics = {"orders": F.count("*"), "customers": F.count_distinct("o_custkey")}
    return cm.metric_deltas(o.filter("year(o_orderdate) = 1999"), o.filter("year(o_orderdate) = 2000"), metrics)


@query("cm_01_largest_movers", """
WITH a AS (SELECT o_custkey AS id, round(sum(o_totalprice), 2) AS v, row_number() OVER (ORDER BY round(sum(o_totalprice), 2) DESC, o_custkey) AS r FROM orders WHERE year(o_orderdate) = 1999 GROUP BY 1),
b AS (SELECT o_custkey AS id, round(sum(o_totalprice), 2) AS v, row_number() OVER (ORDER BY round(sum(o_totalprice), 2) DESC, o_custkey) AS r FROM orders WHERE year(o_orderdate) = 2000 GROUP BY 1)
SELECT id, CASE WHEN b.v IS NULL THEN 'left_only' WHEN a.v IS NULL THEN 'right_only' ELSE 'both' END AS side, round(coalesce(b.v, 0) - coalesce(a.v, 0), 2) AS value_delta, a.r - b.r AS rank_delta FROM a FULL JOIN b USING (id)
ORDER BY abs(coalesce(b.v, 0) - coalesce(a.v, 0)) DESC, id LIMIT 50""")
def _(spark, sf):
    from ledgerlift.operators.ranking import global_row_number

    sums = table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("y"), F.col("o_custkey").alias("id")).agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    runs = [global_row_number(sums.filter(F.col("y") == y).drop("y"), [("v", "desc"), ("id", "asc")], "r") for y in (1999, 2000)]
    return cm.largest_movers(cm.movers(runs[0], runs[1], "id", "v", "r"), "id").select("id", "side", F.round("value_delta", 2).alias("value_delta"), "rank_delta")


@query("cm_02_model_input", sql("hist", f"""
SELECT account_id, strftime(sold_on, '%Y-%m') AS created_year_month, round(sum(total_value), 6) AS total_value FROM hist WHERE trim(status) IN ('Invoiced', 'processed') AND (group_code IS NULL OR NOT {_EX}) GROUP BY 1, 2"""))
def _(spark, sf):
    months, _ = cm.model_input(history_lines(spark, sf), ["Invoiced", "processed"], "group_code", EXCLUDED)
    return months.withColumn("total_value", F.round("total_value", 6))


@query("cm_02_model_input_audit", sql("hist", f"""
SELECT metric, value FROM (SELECT count(*)::DOUBLE AS source_rows, count_if(status = 'Invoiced')::DOUBLE AS rows_in_status_scope, count_if(status = 'Invoiced' AND {_EX})::DOUBLE AS excluded_group_rows, count_if(status = 'Invoiced' AND (group_code IS NULL OR NOT {_EX}))::DOUBLE AS model_rows FROM hist)
UNPIVOT (value FOR metric IN (source_rows, rows_in_status_scope, excluded_group_rows, model_rows))"""))
def _(spark, sf):
    _, audit = cm.model_input(history_lines(spark, sf), ["Invoiced"], "group_code", EXCLUDED)
    return audit.filter(F.col("metric").isin("source_rows", "rows_in_status_scope", "excluded_group_rows", "model_rows"))


@query("cm_03_group_changes", "SELECT p_type AS old_path, 'X ' || p_type AS new_path, count(*) AS changed_rows FROM part WHERE p_size % 2 = 0 GROUP BY 1, 2")
def _(spark, sf):
    before = table(spark, sf, "part").select("p_partkey", F.col("p_type").alias("path"), "p_size")
    after = before.withColumn("path", F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("X "), "path")).otherwise(F.col("path")))
    return cm.change_counts(before, after, "p_partkey", "path")
