"""The library's logical tables bound to the star-schema test tables.

Every binding is a projection or join of the given tables, so work grows with them.  The matching
SQL texts (``CTES``) serve the side-by-side check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlift.functions.text import business_id
from ledgerlift.session import fit_shuffles, tune

LAST_YEAR = 2001  # year in progress in the test orders
YEARS = {1998: "sales_y1_eur", 1999: "sales_y2_eur", 2000: "actual_sales_y3_eur", 2001: "sales_y4_ytd_eur"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    fit_shuffles(tune(spark), path)
    return spark.read.parquet(path)


def _raw_id(number: Column, key: Column) -> Column:
    """Business numbers written the ways people write them."""
    text = number.cast("string")
    return (
        F.when(key % 17 == 0, F.lit(None))
        .when(key % 5 == 0, F.concat(F.lit("FI"), text))
        .when(key % 5 == 1, F.concat(F.lit(" "), text, F.lit(" ")))
        .otherwise(text)
    )


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """account_id, account_name, company_name, business ids (raw and clean), customer_status, country, category."""
    c = table(spark, sf_dir, "customer")
    number = F.floor(F.col("c_custkey") / 2) + 1000000
    parent = F.floor(F.col("c_custkey") / 8) + 1000000
    status = (
        F.when(F.col("c_mktsegment") == "BUILDING", "Active")
        .when(F.col("c_mktsegment") == "AUTOMOBILE", " active ")
        .when(F.col("c_mktsegment") == "MACHINERY", "ACTIVE+")
        .when(F.col("c_mktsegment") == "HOUSEHOLD", "Passive")
    )
    raw = _raw_id(number, F.col("c_custkey"))
    return c.select(
        F.col("c_custkey").alias("account_id"),
        F.col("c_name").alias("account_name"),
        F.col("c_name").alias("company_account_name"),
        raw.alias("business_id_raw"),
        business_id(raw).alias("business_id"),
        business_id(F.when(F.col("c_custkey") % 4 != 0, parent.cast("string"))).alias("parent_business_id"),
        status.alias("customer_status"),
        F.col("c_nationkey").alias("country"),
        F.col("c_mktsegment").alias("category"),
    )


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry: one row per customer key; half of them have accounts, half are prospects."""
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    key = F.col("c_custkey")
    revenue_label = (
        F.when(key % 6 == 0, "2-10 milj.").when(key % 6 == 1, "10-20 milj.").when(key % 6 == 2, "0,4-1 milj.")
        .when(key % 6 == 3, "20+ milj.").when(key % 6 == 4, "1 - 2 milj.")
    )
    staff_label = F.when(key % 7 == 0, "20-49").when(key % 7 == 1, "100-249").when(key % 7 == 2, "250 - 499").when(key % 7 == 3, "1-9")
    return (
        c.join(n, c.c_nationkey == n.n_nationkey, "left")
        .join(r, n.n_regionkey == r.r_regionkey, "left")
        .select(
            business_id((key + 1000000).cast("string")).alias("business_id"),
            F.col("c_name").alias("company_name"),
            F.when(key % 3 != 0, F.concat(F.lit("Brand "), F.col("c_name"))).alias("marketing_name"),
            business_id(F.when(key % 7 == 0, (F.floor(key / 3) + 1000000).cast("string"))).alias("parent_business_id"),
            F.when(key % 13 != 0, F.col("c_mktsegment")).alias("industry"),
            F.when(F.col("c_acctbal") > 0, F.col("c_acctbal") * 12.0).alias("revenue_k_eur"),
            F.when(key % 11 != 0, (key * 37 % 1500).cast("double")).alias("headcount"),
            F.when(key % 19 != 0, (key * 53 % 400 - 150).cast("double")).alias("growth_pct"),
            revenue_label.alias("revenue_class"),
            staff_label.alias("headcount_class"),
            F.col("n_name").alias("location"),
            F.col("n_name").alias("municipality"),
            F.col("r_name").alias("region"),
        )
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product master with a group tree; some rows lack a group or carry a double name."""
    p = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    code = F.concat(F.when(key % 4 == 0, "DIF").when(key % 4 == 1, "IF").otherwise("P"), key.cast("string"))
    has_group = key % 10 != 3
    l1, l2, l3 = F.col("p_type"), F.concat(F.col("p_type"), F.lit(" "), F.substring_index("p_name", " ", -1)), F.col("p_name")
    return p.select(
        key.alias("product_id"),
        code.alias("sku"),
        F.lower(code).alias("code"),
        F.concat_ws(" ", F.col("p_name"), F.lower("p_brand"), (key % 50).cast("string")).alias("product_name"),
        F.when(key % 6 == 0, F.initcap("p_name")).alias("title_fi"),
        F.col("p_brand").alias("inventory_category"),
        F.when(has_group, l1).alias("product_group_l1_name"),
        F.when(has_group, l2).alias("product_group_l2_name"),
        F.when(has_group & (key % 10 != 7), l3).alias("product_group_l3_name"),
        F.col("p_size").alias("size"),
        F.col("p_retailprice").alias("price"),
        F.col("p_brand").alias("brand_name"),
    )


def sales_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines: account, order, product, value, day, status and the way the group was matched."""
    o = table(spark, sf_dir, "orders")
    li = table(spark, sf_dir, "lineitem")
    status = F.when(F.col("o_orderstatus") == "F", "Invoiced").when(F.col("o_orderstatus") == "O", " processed ").otherwise("Open")
    method = (
        F.when(F.col("l_linenumber") == 1, "sku").when(F.col("l_linenumber") == 2, "source_zip_productcode_code")
        .when(F.col("l_linenumber") == 3, "same_sales_name_unique").when(F.col("l_linenumber") == 4, "order_reference")
        .when(F.col("l_linenumber") == 5, "manual_rule").when(F.col("l_linenumber") == 6, "category_guided_name_rule:x")
    )
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.col("o_custkey").alias("account_id"),
        F.col("o_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("line_no"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_quantity").alias("amount"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("total_value"),
        F.col("o_orderdate").cast("date").alias("sold_on"),
        status.alias("status"),
        F.col("o_orderpriority").alias("reference"),
        method.alias("product_group_match_method"),
    )


def sales_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account by month; line values are added up before they meet the account table."""
    return (
        sales_lines(spark, sf_dir)
        .groupBy("account_id", F.trunc("sold_on", "month").alias("created_at"))
        .agg(F.sum("total_value").alias("total_value"))
    )


def crm_potentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CRM rows: named like accounts (with additions), partly with ids, chances as percent or share."""
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    name = (
        F.when(key % 5 == 0, F.concat(F.col("c_name"), F.lit(" Oy (closed)")))
        .when(key % 5 == 1, F.concat(F.upper("c_name"), F.lit(" Ltd")))
        .when(key % 5 == 2, F.concat(F.lit("Old "), F.col("c_name")))
        .otherwise(F.concat(F.lit("Customer#"), F.lpad((F.floor(key / 3) * 3).cast("string"), 9, "0")))
    )
    raw = F.when(key % 9 == 0, (F.floor(key / 2) + 1000000).cast("string"))
    return c.select(
        key.alias("crm_row_id"),
        name.alias("name"),
        business_id(raw).alias("business_id"),
        F.when(key % 7 == 0, key).alias("account_id"),
        F.when(key % 2 == 0, "Upsell").otherwise("New").alias("type"),
        F.when(key % 3 == 0, "open").when(key % 3 == 1, "won").alias("status"),
        F.col("c_acctbal").alias("sales"),
        F.when(key % 10 == 9, F.lit(None)).when(key % 2 == 0, (key % 10 * 10).cast("double")).otherwise(key % 10 / 10.0).alias("probability"),
    )


def exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(business_id((F.col("s_suppkey") * 11 + 1000000).cast("string")).alias("business_id"), F.lit("ledger").alias("source"))


# --------------------------------------------------------------------------- SQL twins


def bid_sql(expr: str) -> str:
    d = f"regexp_replace(regexp_replace(trim({expr}), '^(?i)FI', ''), '[^0-9]', '', 'g')"
    return (
        f"CASE WHEN length({d}) = 7 THEN '0' || left({d}, 6) || '-' || right({d}, 1) "
        f"WHEN length({d}) >= 8 THEN left({d}, length({d}) - 1) || '-' || right({d}, 1) END"
    )


def _raw_sql(number: str) -> str:
    return (
        f"CASE WHEN c_custkey % 17 = 0 THEN NULL WHEN c_custkey % 5 = 0 THEN 'FI' || ({number})::VARCHAR "
        f"WHEN c_custkey % 5 = 1 THEN ' ' || ({number})::VARCHAR || ' ' ELSE ({number})::VARCHAR END"
    )


CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "acc": ((), f"""
SELECT c_custkey AS account_id, c_name AS account_name, c_name AS company_account_name,
  {_raw_sql('c_custkey // 2 + 1000000')} AS business_id_raw,
  {bid_sql(_raw_sql('c_custkey // 2 + 1000000'))} AS business_id,
  {bid_sql("CASE WHEN c_custkey % 4 <> 0 THEN (c_custkey // 8 + 1000000)::VARCHAR END")} AS parent_business_id,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'Active' WHEN 'AUTOMOBILE' THEN ' active ' WHEN 'MACHINERY' THEN 'ACTIVE+'
    WHEN 'HOUSEHOLD' THEN 'Passive' END AS customer_status,
  c_nationkey AS country, c_mktsegment AS category
FROM customer"""),
    "comp": ((), f"""
SELECT {bid_sql("(c_custkey + 1000000)::VARCHAR")} AS business_id, c_name AS company_name,
  CASE WHEN c_custkey % 3 <> 0 THEN 'Brand ' || c_name END AS marketing_name,
  {bid_sql("CASE WHEN c_custkey % 7 = 0 THEN (c_custkey // 3 + 1000000)::VARCHAR END")} AS parent_business_id,
  CASE WHEN c_custkey % 13 <> 0 THEN c_mktsegment END AS industry,
  CASE WHEN c_acctbal > 0 THEN c_acctbal * 12.0::DOUBLE END AS revenue_k_eur,
  CASE WHEN c_custkey % 11 <> 0 THEN (c_custkey * 37 % 1500)::DOUBLE END AS headcount,
  CASE WHEN c_custkey % 19 <> 0 THEN (c_custkey * 53 % 400 - 150)::DOUBLE END AS growth_pct,
  CASE c_custkey % 6 WHEN 0 THEN '2-10 milj.' WHEN 1 THEN '10-20 milj.' WHEN 2 THEN '0,4-1 milj.' WHEN 3 THEN '20+ milj.'
    WHEN 4 THEN '1 - 2 milj.' END AS revenue_class,
  CASE c_custkey % 7 WHEN 0 THEN '20-49' WHEN 1 THEN '100-249' WHEN 2 THEN '250 - 499' WHEN 3 THEN '1-9' END AS headcount_class,
  n_name AS location, n_name AS municipality, r_name AS region
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey"""),
    "prod": ((), """
SELECT p_partkey AS product_id,
  CASE p_partkey % 4 WHEN 0 THEN 'DIF' WHEN 1 THEN 'IF' ELSE 'P' END || p_partkey AS sku,
  lower(CASE p_partkey % 4 WHEN 0 THEN 'DIF' WHEN 1 THEN 'IF' ELSE 'P' END || p_partkey) AS code,
  p_name || ' ' || lower(p_brand) || ' ' || (p_partkey % 50) AS product_name,
  CASE WHEN p_partkey % 6 = 0 THEN upper(split_part(p_name,' ',1)[1]) || split_part(p_name,' ',1)[2:] || ' '
    || upper(split_part(p_name,' ',2)[1]) || split_part(p_name,' ',2)[2:] END AS title_fi,
  p_brand AS inventory_category,
  CASE WHEN p_partkey % 10 <> 3 THEN p_type END AS product_group_l1_name,
  CASE WHEN p_partkey % 10 <> 3 THEN p_type || ' ' || split_part(p_name, ' ', 2) END AS product_group_l2_name,
  CASE WHEN p_partkey % 10 NOT IN (3, 7) THEN p_name END AS product_group_l3_name,
  p_size AS size, p_retailprice AS price, p_brand AS brand_name
FROM part"""),
    "lines": ((), """
SELECT o_custkey AS account_id, o_orderkey AS order_id, l_linenumber AS line_no, l_partkey AS product_id, l_quantity AS amount,
  l_extendedprice * (1 - l_discount) AS total_value, o_orderdate::DATE AS sold_on,
  CASE o_orderstatus WHEN 'F' THEN 'Invoiced' WHEN 'O' THEN ' processed ' ELSE 'Open' END AS status,
  o_orderpriority AS reference,
  CASE l_linenumber WHEN 1 THEN 'sku' WHEN 2 THEN 'source_zip_productcode_code' WHEN 3 THEN 'same_sales_name_unique'
    WHEN 4 THEN 'order_reference' WHEN 5 THEN 'manual_rule' WHEN 6 THEN 'category_guided_name_rule:x' END AS product_group_match_method
FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""),
    "months": (("lines",), """
SELECT account_id, date_trunc('month', sold_on)::DATE AS created_at, sum(total_value) AS total_value FROM lines GROUP BY ALL"""),
    "crm": ((), f"""
SELECT c_custkey AS crm_row_id,
  CASE c_custkey % 5 WHEN 0 THEN c_name || ' Oy (closed)' WHEN 1 THEN upper(c_name) || ' Ltd' WHEN 2 THEN 'Old ' || c_name
    ELSE 'Customer#' || lpad((c_custkey // 3 * 3)::VARCHAR, 9, '0') END AS name,
  {bid_sql("CASE WHEN c_custkey % 9 = 0 THEN (c_custkey // 2 + 1000000)::VARCHAR END")} AS business_id,
  CASE WHEN c_custkey % 7 = 0 THEN c_custkey END AS account_id,
  CASE WHEN c_custkey % 2 = 0 THEN 'Upsell' ELSE 'New' END AS type,
  CASE c_custkey % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'won' END AS status,
  c_acctbal AS sales,
  CASE WHEN c_custkey % 10 = 9 THEN NULL WHEN c_custkey % 2 = 0 THEN (c_custkey % 10 * 10)::DOUBLE
    ELSE (c_custkey % 10)::DOUBLE / 10.0::DOUBLE END AS probability
FROM customer"""),
    "excl": ((), f"""
SELECT {bid_sql("(s_suppkey * 11 + 1000000)::VARCHAR")} AS business_id, 'ledger' AS source FROM supplier"""),
}


def sql(names: str | tuple[str, ...], body: str, extra: dict[str, str] | None = None) -> str:
    """SQL text with the named CTEs (and what they need) in front of ``body``."""
    wanted = names.split() if isinstance(names, str) else list(names)
    ordered: list[str] = []

    def add(name: str) -> None:
        if name in ordered:
            return
        for need in CTES[name][0]:
            add(need)
        ordered.append(name)

    for name in wanted:
        add(name)
    parts = [f"{name} AS ({CTES[name][1].strip()})" for name in ordered]
    parts += [f"{name} AS ({text.strip()})" for name, text in (extra or {}).items()]
    body = body.strip()
    if body.upper().startswith("WITH ") and parts:
        return "WITH " + ",\n".join(parts) + ",\n" + body[5:]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body
