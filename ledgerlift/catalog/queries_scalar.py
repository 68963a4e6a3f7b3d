"""Queries for the scalar functions: identifiers, text, numbers, dates, bins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlift.catalog.bindings import accounts, bid_sql, companies, crm_potentials, products, sales_lines, sql, table
from ledgerlift.catalog.registry import query
from ledgerlift.functions import buckets as bk
from ledgerlift.functions import dates as dt
from ledgerlift.functions import numbers as nm
from ledgerlift.functions import text as tx

W = "a-z0-9åäö"


@query("str_01_business_id", sql("acc", "SELECT account_id, business_id_raw, business_id FROM acc"))
def _(spark, sf):
    return accounts(spark, sf).select("account_id", "business_id_raw", tx.business_id(F.col("business_id_raw")).alias("business_id"))


@query("str_02_business_id_keep", f"""
SELECT s_suppkey, coalesce({bid_sql("v")}, regexp_replace(trim(v), '^(?i)FI', ''), '') AS id_text FROM
 (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN s_name WHEN s_suppkey % 3 = 1 THEN 'fi' || (s_suppkey + 2000000) END AS v FROM supplier)""")
def _(spark, sf):
    key = F.col("s_suppkey")
    raw = F.when(key % 3 == 0, F.substring("s_name", 1, 9)).when(key % 3 == 1, F.concat(F.lit("fi"), (key + 2000000).cast("string")))
    raw = F.when(key % 3 == 0, F.col("s_name")).otherwise(raw)
    return table(spark, sf, "supplier").select("s_suppkey", tx.business_id(raw, on_fail="keep").alias("id_text"))


@query("str_03_business_id_any_prefix", """
WITH d AS (SELECT account_id, regexp_replace(regexp_replace(trim(v), '(?i)FI', '', 'g'), '[^0-9]', '', 'g') AS x FROM
 (SELECT c_custkey AS account_id, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'FI' || (c_custkey + 1000000) || 'fi' END AS v FROM customer))
SELECT account_id, CASE WHEN length(x) = 7 THEN '0' || left(x, 6) || '-' || right(x, 1)
  WHEN length(x) >= 8 THEN left(x, length(x) - 1) || '-' || right(x, 1) ELSE '' END AS business_id FROM d""")
def _(spark, sf):
    raw = F.when(F.col("c_custkey") % 4 != 0, F.concat(F.lit("FI"), (F.col("c_custkey") + 1000000).cast("string"), F.lit("fi")))
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("account_id"), tx.business_id(raw, on_fail="blank", country_prefix="all").alias("business_id")
    )


@query("str_04_name_plain", f"SELECT c_custkey, trim(regexp_replace(lower(c_name), '[^{W}]+', ' ', 'g')) AS name_key FROM customer")
def _(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", tx.name_plain(F.col("c_name")).alias("name_key"))


_LEGAL = r"\b(oyj|oy|ab|ltd|limited|inc|gmbh|as)\b"
_STATUS = r"\b(suljettu|closed|myynti|hr lahjat|ei saa laskuttaa|ylitoimituksia)\b"


def name_for_matching_sql(expr: str) -> str:
    return (
        f"nullif(trim(regexp_replace(regexp_replace(regexp_replace(translate(regexp_replace(lower(trim({expr})), '\\([^)]*\\)', ' ', 'g'), "
        f"'äöå', 'aoa'), '{_LEGAL}', ' ', 'g'), '{_STATUS}', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')), '')"
    )


@query("str_05_name_for_matching", sql("crm", f"SELECT crm_row_id, {name_for_matching_sql('name')} AS name_key FROM crm"))
def _(spark, sf):
    return crm_potentials(spark, sf).select("crm_row_id", tx.name_for_matching(F.col("name")).alias("name_key"))


_FORMS = r"\b(oyj|oy|ab|ltd|limited|inc|gmbh|plc|konserni|group)\b"


def name_of_account_sql(expr: str) -> str:
    return (
        f"coalesce(trim(regexp_replace(regexp_replace(regexp_replace(lower({expr}), '\\([^)]*\\)', ' ', 'g'), "
        f"'{_FORMS}', ' ', 'g'), '[^{W}]+', ' ', 'g')), '')"
    )


@query("str_06_name_of_account", sql("crm", f"SELECT crm_row_id, {name_of_account_sql('name')} AS name_key FROM crm"))
def _(spark, sf):
    return crm_potentials(spark, sf).select("crm_row_id", tx.name_of_account(F.col("name")).alias("name_key"))


def fold_sql(expr: str) -> str:
    return f"coalesce(trim(regexp_replace(strip_accents(lower(trim({expr}))), '[^a-z0-9]+', ' ', 'g')), '')"


@query("str_07_fold", f"SELECT doc_id, md5({fold_sql('text')}) AS folded_md5, length({fold_sql('text')})::INTEGER AS folded_length FROM documents")
def _(spark, sf):
    folded = tx.fold(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.md5(folded).alias("folded_md5"), F.length(folded).alias("folded_length"))


@query("str_08_product_name_key", sql("prod", f"""
SELECT product_id, trim(regexp_replace(lower(product_name), '\\s+', ' ', 'g')) AS name_key,
  regexp_replace(trim(regexp_replace(lower(product_name), '\\s+', ' ', 'g')), '[^{W}]+', '', 'g') AS compact_key FROM prod"""))
def _(spark, sf):
    return products(spark, sf).select(
        "product_id", tx.product_name_key(F.col("product_name")).alias("name_key"), tx.compact_key(F.col("product_name")).alias("compact_key")
    )


@query("str_09_code_key", sql("prod", """
SELECT product_id, upper(trim(code)) AS code_key, regexp_replace(upper(trim(product_name)), '\\s+', '', 'g') AS packed_key,
  regexp_replace(upper(trim(price::DECIMAL(12,1)::VARCHAR)), '\\.0$', '') AS price_key FROM prod"""))
def _(spark, sf):
    return products(spark, sf).select(
        "product_id", tx.code_key(F.col("code")).alias("code_key"),
        tx.code_key(F.col("product_name"), drop_spaces=True).alias("packed_key"),
        tx.code_key(F.col("price").cast("decimal(12,1)").cast("string"), drop_decimal=True).alias("price_key"),
    )


@query("str_10_variant_text", """
SELECT p_partkey, regexp_replace(regexp_replace(v, '([0-9])\\s*x\\s*([0-9])', '\\1x\\2', 'g'), '([0-9])\\s+cm\\b', '\\1cm', 'g') AS variant FROM
 (SELECT p_partkey, replace(lower(p_name), '-', ' ') || ' ' || p_size || ' x ' || p_size || ' cm' AS v FROM part)""")
def _(spark, sf):
    size = F.col("p_size").cast("string")
    raw = F.concat(F.col("p_name"), F.lit("-"), size, F.lit(" x "), size, F.lit(" cm"))
    return table(spark, sf, "part").select("p_partkey", tx.variant_text(raw, join_cm=True).alias("variant"))


@query("str_11_strip_control", "SELECT doc_id, md5(regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g')) AS clean_md5 FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(tx.strip_control(F.col("text"))).alias("clean_md5"))


@query("str_12_repair_misread", "SELECT p_partkey, p_name || ' keittiö työ' AS repaired FROM part")
def _(spark, sf):
    broken = F.concat(F.col("p_name"), F.lit(" keitti� ty�"))
    return table(spark, sf, "part").select("p_partkey", tx.repair_misread(broken).alias("repaired"))


@query("str_13_has_any", f"""
SELECT doc_id, regexp_matches(lower(text), '(the|und|que)') AS has_part,
  regexp_matches(lower(text), '(^|[^{W}])(the|und|que)($|[^{W}])') AS has_word FROM documents""")
def _(spark, sf):
    low = F.lower("text")
    return table(spark, sf, "documents").select(
        "doc_id", tx.has_any(low, ["the", "und", "que"]).alias("has_part"),
        tx.has_any(low, ["the", "und", "que"], whole_words=True).alias("has_word"),
    )


@query("str_14_tokens_bigrams", f"""
WITH t AS (SELECT p_partkey, regexp_extract_all(lower(p_name), '[{W}]{{3,}}') AS w FROM part)
SELECT p_partkey, array_to_string(w, '|') AS words, coalesce(array_to_string(list_transform(range(1, len(w)), lambda i : w[i] || ' ' || w[i+1]), '|'), '') AS pairs FROM t""")
def _(spark, sf):
    words = tx.tokens(F.lower("p_name"), 3)
    return table(spark, sf, "part").select(
        "p_partkey", F.array_join(words, "|").alias("words"), F.array_join(tx.bigrams(words), "|").alias("pairs")
    )


@query("str_15_positive_signals", sql("comp", """
SELECT business_id, CASE WHEN revenue_k_eur >= 20000 THEN 'suuri' END AS big,
 coalesce(nullif(concat_ws(', ', CASE WHEN revenue_k_eur >= 20000 THEN 'suuri' END, CASE WHEN headcount >= 250 THEN 'paljon väkeä' END,
   CASE WHEN industry IS NOT NULL THEN 'toimiala ' || industry END), ''), 'ei tietoa') AS reasons FROM comp"""))
def _(spark, sf):
    big = F.when(F.col("revenue_k_eur") >= 20000, "suuri")
    parts = [big, F.when(F.col("headcount") >= 250, "paljon väkeä"), F.when(F.col("industry").isNotNull(), F.concat(F.lit("toimiala "), "industry"))]
    return companies(spark, sf).select("business_id", big.alias("big"), tx.sentence(parts, limit=4, default="ei tietoa").alias("reasons"))


@query("str_16_search_text", sql("prod", f"SELECT product_id, {fold_sql('concat_ws(chr(32), sku, product_name, title_fi, brand_name)')} AS search_text FROM prod"))
def _(spark, sf):
    cols = [F.col(c) for c in ("sku", "product_name", "title_fi", "brand_name")]
    return products(spark, sf).select("product_id", tx.search_text(*cols).alias("search_text"))


@query("str_17_url_clean", """
WITH u AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(trim(url), '#.*$', ''), '\\?.*$', ''), '/+$', '') AS clean_url FROM pages)
SELECT page_id, clean_url, lower(regexp_extract(clean_url, '^https?://([^/?#]+)', 1)) AS domain FROM u""")
def _(spark, sf):
    clean = tx.url_clean(F.col("url"))
    return table(spark, sf, "pages").select("page_id", clean.alias("clean_url"), tx.url_domain(clean).alias("domain"))


@query("str_18_name_tokens", """
SELECT doc_id, array_to_string(list_filter(regexp_extract_all(lower(text), '[a-zåäö0-9]+'), lambda w : length(w) >= 3 AND w NOT IN ('and','the','for','with','sis','cm','mm','kpl','sekä','ja')), ' ') AS words
FROM documents""")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(tx.name_tokens(F.col("text")), " ").alias("words"))


@query("str_19_numeric_id_key", """
SELECT p_partkey, p_partkey::VARCHAR AS from_float, p_name AS from_text, CASE WHEN p_size % 2 = 0 THEN p_size::VARCHAR ELSE '' END AS package FROM part""")
def _(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey",
        tx.numeric_id_key(F.col("p_partkey").cast("double").cast("string")).alias("from_float"),
        tx.numeric_id_key(F.concat(F.lit(" "), F.col("p_name"), F.lit(".0"))).alias("from_text"),
        tx.package_size_text(F.when(F.col("p_size") % 2 == 0, F.concat(F.col("p_size").cast("string"), F.lit(".0"))).otherwise("NaN")).alias("package"),
    )


@query("num_01_to_number", """
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS value FROM orders""")
def _(spark, sf):
    raw = F.when(F.col("o_orderkey") % 5 == 0, F.lit("x")).otherwise(F.replace(F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit("."), F.lit(",")))
    return table(spark, sf, "orders").select("o_orderkey", nm.to_number(raw).alias("value"))


@query("num_02_first_number", "SELECT page_id, TRY_CAST(nullif(regexp_extract(replace(replace(url, chr(160), ' '), ',', '.'), '-?[0-9]+(?:\\.[0-9]+)?'), '') AS DOUBLE) AS number FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", nm.first_number(F.col("url")).alias("number"))


@query("num_03_weight_and_length", """
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_size / 1000.0::DOUBLE WHEN 1 THEN p_size::DOUBLE ELSE p_size::DOUBLE END AS kg,
 CASE p_partkey % 3 WHEN 0 THEN p_size / 10.0::DOUBLE WHEN 1 THEN p_size * 100.0::DOUBLE ELSE p_size::DOUBLE END AS cm FROM part""")
def _(spark, sf):
    key, size = F.col("p_partkey") % 3, F.col("p_size").cast("string")
    weight = F.concat(size, F.when(key == 0, " g").when(key == 1, " kg").otherwise(""))
    length = F.concat(size, F.when(key == 0, " mm").when(key == 1, " m").otherwise(" cm"))
    return table(spark, sf, "part").select("p_partkey", nm.weight_kg(weight).alias("kg"), nm.length_cm(length).alias("cm"))


@query("num_04_unit_to_cm", """
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size / 10.0::DOUBLE WHEN 1 THEN p_size::DOUBLE WHEN 2 THEN p_size * 100.0::DOUBLE END AS cm FROM part""")
def _(spark, sf):
    key = F.col("p_partkey") % 4
    unit = F.when(key == 0, " MM").when(key == 1, "cm").when(key == 2, "m").otherwise("inch")
    return table(spark, sf, "part").select("p_partkey", nm.unit_to_cm(F.col("p_size").cast("string"), unit).alias("cm"))


@query("num_05_continuous_baseline", sql("comp", """
SELECT business_id, round((greatest(ln(1 + coalesce(greatest(revenue_k_eur * 1000.0::DOUBLE, 0), 0)) - ln(1000001::DOUBLE), 0) * 22000
  + ln(1 + greatest(coalesce(headcount, 25), 1)) * 6500) * least(greatest(coalesce(growth_pct / 100, 1), 0.7), 1.8), 3) AS baseline FROM comp"""))
def _(spark, sf):
    value = nm.continuous_baseline(F.col("revenue_k_eur"), F.col("headcount"), F.col("growth_pct") / 100)
    return companies(spark, sf).select("business_id", F.round(value, 3).alias("baseline"))


@query("num_06_share_of_one", sql("crm", """
SELECT crm_row_id, coalesce(CASE WHEN probability > 1 THEN probability / 100 ELSE probability END, 1) AS chance,
 least(greatest(coalesce(CASE WHEN probability > 1 THEN probability / 100 ELSE probability END, 0), 0), 1) AS bounded_chance FROM crm"""))
def _(spark, sf):
    p = F.col("probability")
    return crm_potentials(spark, sf).select(
        "crm_row_id", nm.share_of_one(p).alias("chance"), nm.share_of_one(p, missing=0.0, bounded=True).alias("bounded_chance")
    )


@query("num_07_close_enough", """
SELECT l_orderkey, l_linenumber, abs(l_extendedprice - l_extendedprice * (1 - l_tax)) <= greatest(2.0::DOUBLE, abs(l_extendedprice) * 0.02::DOUBLE) AS close FROM lineitem""")
def _(spark, sf):
    a, b = F.col("l_extendedprice"), F.col("l_extendedprice") * (1 - F.col("l_tax"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", nm.close_enough(a, b).alias("close"))


@query("num_08_round_even", "SELECT l_orderkey, l_linenumber, round_even(l_quantity / 2, 0) AS even, ceil(l_quantity / 2) AS up FROM lineitem")
def _(spark, sf):
    half = F.col("l_quantity") / 2
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", nm.round_even(half).alias("even"), F.ceil(half).cast("double").alias("up"))


@query("dat_01_month_start", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE date_trunc('month', o_orderdate)::DATE END AS month_start FROM orders")
def _(spark, sf):
    text = F.when(F.col("o_orderkey") % 7 == 0, F.lit("2024-13")).otherwise(F.date_format("o_orderdate", "yyyy-MM"))
    return table(spark, sf, "orders").select("o_orderkey", dt.month_start(text).alias("month_start"))


@query("dat_02_parse_timestamp", """
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE strftime(o_orderdate, '%Y-%m') END AS month,
 CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE year(o_orderdate)::INTEGER END AS year, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE quarter(o_orderdate)::INTEGER END AS quarter FROM orders""")
def _(spark, sf):
    kind = F.col("o_orderkey") % 4
    text = (
        F.when(kind == 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(kind == 1, F.date_format("o_orderdate", "dd.MM.yyyy"))
        .when(kind == 2, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("bad")
    )
    stamp = dt.parse_timestamp(text)
    return table(spark, sf, "orders").select("o_orderkey", dt.month_text(stamp).alias("month"), F.year(stamp).alias("year"), F.quarter(stamp).alias("quarter"))


@query("dat_03_days_since", """
SELECT c_custkey, greatest(coalesce(date_diff('day', max(o_orderdate)::DATE, DATE '2001-01-01'), 9999), 0)::INTEGER AS days_since
FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY c_custkey""")
def _(spark, sf):
    last = table(spark, sf, "orders").filter("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last"))
    c = table(spark, sf, "customer")
    return c.join(last, c.c_custkey == last.o_custkey, "left").select(
        "c_custkey", dt.days_since(F.lit("2001-01-01").cast("date"), F.col("last")).alias("days_since")
    )


@query("dat_04_snapshot_dates", """
WITH s AS (SELECT min(o_orderdate)::DATE + 365 AS a, max(o_orderdate)::DATE AS b FROM orders)
SELECT last_day(m)::DATE AS snapshot_date FROM s, unnest(generate_series(date_trunc('month', a), date_trunc('month', b), INTERVAL 1 MONTH)) t(m)
WHERE last_day(m) BETWEEN a AND b""")
def _(spark, sf):
    return dt.snapshot_dates(table(spark, sf, "orders"), "o_orderdate", lookback_days=365)


_REV = """CASE WHEN revenue_k_eur IS NULL THEN 'unknown' WHEN revenue_k_eur < 1000 THEN '0-1M' WHEN revenue_k_eur < 5000 THEN '1-5M'
 WHEN revenue_k_eur < 20000 THEN '5-20M' WHEN revenue_k_eur < 100000 THEN '20-100M' ELSE '100M+' END"""
_HEAD = """CASE WHEN headcount IS NULL THEN 'unknown' WHEN headcount < 10 THEN '1-10' WHEN headcount < 50 THEN '10-50'
 WHEN headcount < 250 THEN '50-250' WHEN headcount < 1000 THEN '250-1000' ELSE '1000+' END"""
_REVL = """CASE WHEN revenue_class LIKE '%20+%' THEN '20-100M' WHEN revenue_class LIKE '%10-20%' THEN '5-20M'
 WHEN revenue_class LIKE '%2-10%' OR revenue_class LIKE '%1 - 2%' THEN '1-5M' WHEN revenue_class LIKE '%0,4-1%' THEN '0-1M' END"""
_HEADL = """CASE WHEN headcount_class LIKE '%250 - 499%' THEN '250-1000' WHEN headcount_class LIKE '%100-249%' THEN '50-250'
 WHEN headcount_class LIKE '%20-49%' THEN '10-50' WHEN headcount_class LIKE '%1-9%' THEN '1-10' END"""
_GROW = """CASE WHEN growth_pct <= -5 THEN 'decline' WHEN growth_pct <= 5 THEN 'stable' WHEN growth_pct <= 20 THEN 'growth'
 WHEN growth_pct IS NOT NULL THEN 'high_growth' END"""


@query("bin_01_revenue_bucket", sql("comp", f"SELECT business_id, {_REV} AS bucket FROM comp"))
def _(spark, sf):
    return companies(spark, sf).select("business_id", bk.revenue_bucket(F.col("revenue_k_eur")).alias("bucket"))


@query("bin_02_headcount_bucket", sql("comp", f"SELECT business_id, {_HEAD} AS bucket FROM comp"))
def _(spark, sf):
    return companies(spark, sf).select("business_id", bk.headcount_bucket(F.col("headcount")).alias("bucket"))


@query("bin_03_bucket_from_label", sql("comp", f"SELECT business_id, {_REVL} AS revenue_bucket, {_HEADL} AS headcount_bucket FROM comp"))
def _(spark, sf):
    return companies(spark, sf).select(
        "business_id", bk.bucket_from_label(F.col("revenue_class"), bk.REVENUE_LABELS).alias("revenue_bucket"),
        bk.bucket_from_label(F.col("headcount_class"), bk.HEADCOUNT_LABELS).alias("headcount_bucket"),
    )


SEGMENT_SQL = f"""SELECT *, revenue_bucket || '_' || headcount_bucket AS company_segment FROM (SELECT *,
 coalesce(nullif({_REV}, 'unknown'), {_REVL}, 'unknown') AS revenue_bucket, coalesce({_HEADL}, {_HEAD}) AS headcount_bucket,
 CASE WHEN headcount > 0 THEN revenue_k_eur * 1000.0::DOUBLE / headcount END AS revenue_per_employee, {_GROW} AS growth_bucket FROM"""


@query("bin_04_segment", sql("comp", f"""
SELECT business_id, revenue_bucket, headcount_bucket, company_segment, round(revenue_per_employee, 4) AS revenue_per_employee, growth_bucket FROM ({SEGMENT_SQL} comp))"""))
def _(spark, sf):
    return bk.add_segment_features(companies(spark, sf)).select(
        "business_id", "revenue_bucket", "headcount_bucket", "company_segment", F.round("revenue_per_employee", 4).alias("revenue_per_employee"), "growth_bucket"
    )


@query("bin_05_priority", """
SELECT p_partkey, CASE WHEN p_partkey <= 100 THEN 'A' WHEN p_partkey <= 500 THEN 'B' WHEN p_partkey <= 1000 THEN 'C' ELSE 'D' END AS priority,
 CASE WHEN p_partkey <= 100 THEN 'A' WHEN p_partkey <= 500 THEN 'B' WHEN p_partkey <= 1500 THEN 'C' ELSE 'D' END AS commercial_priority FROM part""")
def _(spark, sf):
    rank = F.col("p_partkey")
    return table(spark, sf, "part").select("p_partkey", bk.priority(rank).alias("priority"), bk.priority(rank, bk.COMMERCIAL_CUTS).alias("commercial_priority"))


@query("bin_06_potential_segment", """
SELECT o_orderkey, CASE WHEN o_totalprice < 4000 THEN 'Partner' WHEN o_totalprice >= 100000 THEN 'A' WHEN o_totalprice >= 50000 THEN 'B'
 WHEN o_totalprice >= 10000 THEN 'C' ELSE 'Below C' END AS segment FROM orders""")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", bk.potential_segment(F.col("o_totalprice")).alias("segment"))


@query("bin_07_sales_priority", """
SELECT event_id, CASE WHEN value > 100 THEN NULL WHEN value <= 39.999 THEN 'Low' WHEN value <= 69.999 THEN 'Medium' ELSE 'High' END AS priority FROM events""")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", bk.sales_priority(F.col("value")).alias("priority"))


@query("bin_08_sales_year_bucket", sql("lines", """
SELECT order_id, line_no, CASE WHEN d <= 365 THEN 'recent_12m' WHEN d <= 730 THEN 'middle_12m' ELSE 'oldest_12m' END AS bucket
FROM (SELECT order_id, line_no, date_diff('day', sold_on, DATE '2001-08-01') AS d FROM lines)"""))
def _(spark, sf):
    days = F.datediff(F.lit("2001-08-01").cast("date"), "sold_on")
    return sales_lines(spark, sf).select("order_id", "line_no", bk.sales_year_bucket(days).alias("bucket"))


@query("map_01_match_confidence", sql("lines", """
SELECT order_id, line_no, CASE line_no WHEN 1 THEN 1.0::DOUBLE WHEN 2 THEN 0.8 WHEN 3 THEN 0.85 WHEN 4 THEN 0.8 WHEN 5 THEN 0.75 WHEN 6 THEN 0.7 ELSE 0.0 END AS last_rule,
 CASE line_no WHEN 1 THEN 1.0::DOUBLE WHEN 2 THEN 0.95 WHEN 3 THEN 0.85 WHEN 4 THEN 0.8 WHEN 5 THEN 0.75 WHEN 6 THEN 0.7 ELSE 0.0 END AS first_rule FROM lines"""))
def _(spark, sf):
    method = F.col("product_group_match_method")
    return sales_lines(spark, sf).select(
        "order_id", "line_no", bk.match_confidence(method).alias("last_rule"), bk.match_confidence(method, rule_order="first").alias("first_rule")
    )


@query("map_02_priority_scale", """
SELECT o_orderkey, CASE left(o_orderpriority, 1) WHEN '1' THEN 1.0::DOUBLE WHEN '2' THEN 0.85 WHEN '3' THEN 0.65 WHEN '4' THEN 0.45 ELSE 0.55 END AS multiplier,
 CASE left(o_orderpriority, 1) WHEN '1' THEN 0.6::DOUBLE WHEN '2' THEN 0.45 WHEN '3' THEN 0.3 WHEN '4' THEN 0.2 ELSE 0.25 END AS cap_pct,
 CASE left(o_orderpriority, 1) WHEN '1' THEN 15000.0::DOUBLE WHEN '2' THEN 10000 WHEN '3' THEN 6000 WHEN '4' THEN 3000 ELSE 5000 END AS cap_floor FROM orders""")
def _(spark, sf):
    letter = F.translate(F.substring("o_orderpriority", 1, 1), "12345", "ABCDE")
    return table(spark, sf, "orders").select(
        "o_orderkey", bk.by_priority(letter, bk.PRIORITY_MULTIPLIER, 0.55).alias("multiplier"),
        bk.by_priority(letter, bk.PRIORITY_CAP_PCT, 0.25).alias("cap_pct"), bk.by_priority(letter, bk.PRIORITY_CAP_FLOOR, 5000.0).alias("cap_floor"),
    )
