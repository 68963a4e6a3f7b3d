"""Queries for the product taxonomy and for filling product and sales rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlift.catalog.bindings import CTES, products, sql, table
from ledgerlift.catalog.queries_features import history_lines
from ledgerlift.catalog.queries_recommend import product_master
from ledgerlift.catalog.queries_scalar import fold_sql
from ledgerlift.catalog.registry import query
from ledgerlift.functions import numbers as nm
from ledgerlift.functions import text as tx
from ledgerlift.operators import aggregates as ag
from ledgerlift.plans import enrich as en
from ledgerlift.plans import taxonomy as tax
from ledgerlift.session import stage

# --------------------------------------------------------------------------- rules

# words of the test parts put into the rule vocabulary, so that the shipped rules have something to find
WORDS = {"bolt": "muki", "gear": "huppari", "widget": "kynä", "plate": "reppu", "ring": "pipo", "gizmo": "pullo", "anvil": "heijastin"}


def _translated():
    out = F.lower(F.col("p_name"))
    for word, other in WORDS.items():
        out = F.replace(out, F.lit(word), F.lit(other))
    return F.concat_ws(" ", out, F.lower("p_type"))


def _translated_sql() -> str:
    out = "lower(p_name)"
    for word, other in WORDS.items():
        out = f"replace({out}, '{word}', '{other}')"
    return f"{out} || ' ' || lower(p_type)"


def _rules_sql(rules, text: str, value: str, *, folded: bool, where: str = "TRUE") -> str:
    """CASE over the rule table; RE2 has no Unicode word edges, so edges are spelled out."""
    arms = []
    for r in rules:
        if r.words:
            test = "(" + " OR ".join(f"contains({text}, '{w}')" for w in r.words) + ")"
        else:
            body = tax.fold_pattern(r.pattern) if folded else r.pattern
            body = body.replace("\\b", "(?:^|$|[^a-z0-9_åäö])") if not body.startswith("\\b(") else "(?:^|[^a-z0-9_åäö])" + body[2:].replace("\\b)", ")").removesuffix("\\b") + "(?:$|[^a-z0-9_åäö])"
            test = f"regexp_matches({text}, '(?i){body}')"
        if r.categories:
            test += " AND coalesce(cat, '') IN (" + ", ".join(f"'{c}'" for c in r.categories) + ")"
        arms.append(f"WHEN {test} THEN '{r.name if value == 'name' else r.path[int(value)]}'")
    return "CASE " + "\n ".join(arms) + " END"


_TEXT_RULES = tax.pattern_rules("product_text")


@query("tx_01_rule_classifier", f"""
WITH t AS (SELECT p_partkey, translate({_translated_sql()}, 'äöåéèáü', 'aoaeeau') AS x FROM part)
SELECT p_partkey, coalesce(src, 'manual_review_no_rule_match') AS source, coalesce(l3, 'Tarkistettavat') AS l3 FROM (
SELECT p_partkey, {_rules_sql(_TEXT_RULES, 'x', 'name', folded=True)} AS src, {_rules_sql(_TEXT_RULES, 'x', '2', folded=True)} AS l3 FROM t)""")
def _(spark, sf):
    text = F.translate(_translated(), "äöåéèáü", "aoaeeau")
    return tax.classify_or_review(table(spark, sf, "part"), _TEXT_RULES, text).select("p_partkey", "source", "l3")


_IMPROVE = tax.word_rules("other_improvement")


@query("tx_01_other_improvement", f"""
WITH t AS (SELECT {fold_sql('text')} AS x FROM documents)
SELECT coalesce({_rules_sql(_IMPROVE, 'x', 'name', folded=False)}, 'none') AS rule, coalesce({_rules_sql(_IMPROVE, 'x', '3', folded=False)}, '') AS l4, count(*) AS documents FROM t GROUP BY 1, 2""")
def _(spark, sf):
    """Words that lift a product out of an "other" group, over whole documents: the first rule of each, with its lowest group."""
    out = tax.classify(table(spark, sf, "documents"), _IMPROVE, tx.fold(F.col("text")))
    return out.groupBy(F.coalesce(F.col("group.source"), F.lit("none")).alias("rule"), F.coalesce(F.col("group.l4"), F.lit("")).alias("l4")).agg(F.count("*").alias("documents"))


_SUGGEST = tax.word_rules("review_suggestions", with_confidence=True)


@query("tx_01_review_suggestions", f"""
WITH t AS (SELECT {fold_sql('text')} AS x FROM documents)
SELECT coalesce({_rules_sql(_SUGGEST, 'x', 'name', folded=False)}, 'none') AS reason, count(*) AS documents FROM t GROUP BY 1""")
def _(spark, sf):
    """Word rules over whole documents: how many documents each rule would move."""
    out = tax.classify(table(spark, sf, "documents"), _SUGGEST, tx.fold(F.col("text")))
    return out.groupBy(F.coalesce(F.col("group.source"), F.lit("none")).alias("reason")).agg(F.count("*").alias("documents"))


@query("tx_02_category_map", """
WITH c AS (SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'T-paidat' WHEN 1 THEN 'Pipo' WHEN 2 THEN 'KELLOT' WHEN 3 THEN 'Hupparit ja colleget' ELSE 'x' END AS cat FROM part)
SELECT p_partkey, CASE cat WHEN 'T-paidat' THEN 'Vaatteet' WHEN 'Pipo' THEN 'Asusteet' WHEN 'KELLOT' THEN 'Korut ja kellot' WHEN 'Hupparit ja colleget' THEN 'Vaatteet' END AS l1 FROM c""")
def _(spark, sf):
    s = F.col("p_size") % 5
    cat = F.when(s == 0, "T-paidat").when(s == 1, "Pipo").when(s == 2, "KELLOT").when(s == 3, "Hupparit ja colleget").otherwise("x")
    return tax.by_category(table(spark, sf, "part").withColumn("cat", cat), "cat", "g").select("p_partkey", F.col("g.l1").alias("l1"))


@query("tx_03_choose_group", f"""
WITH t AS (SELECT p_partkey, p_type, p_size, translate({_translated_sql()}, 'äöåéèáü', 'aoaeeau') AS x, CASE p_size % 3 WHEN 0 THEN 'Pipo' END AS cat FROM part)
SELECT p_partkey, CASE WHEN cat = 'Pipo' THEN 'inventory_category_mapped' WHEN r IS NOT NULL THEN 'title_description_rule' WHEN p_size > 10 THEN 'previous_tree_fallback' ELSE 'not_classified' END AS source,
 CASE WHEN cat = 'Pipo' THEN 'Asusteet' WHEN r IS NOT NULL THEN r WHEN p_size > 10 THEN p_type ELSE 'Muut / tarkistettavat' END AS l1
FROM (SELECT *, {_rules_sql(_TEXT_RULES, 'x', '0', folded=True)} AS r FROM t)""")
def _(spark, sf):
    p = table(spark, sf, "part").withColumn("cat", F.when(F.col("p_size") % 3 == 0, "Pipo"))
    p = tax.by_category(tax.classify(p, _TEXT_RULES, F.translate(_translated(), "äöåéèáü", "aoaeeau"), "by_text", folded=True), "cat", "by_category")
    by_text = F.when(F.col("by_text").isNotNull(), F.struct("by_text.l1", "by_text.l2", "by_text.l3", F.col("by_text.l3").alias("l4")))
    old = F.when(F.col("p_size") > 10, F.struct(F.col("p_type").alias("l1"), F.col("p_type").alias("l2"), F.col("p_type").alias("l3"), F.col("p_type").alias("l4")))
    default = ("Muut / tarkistettavat", "Muut / tarkistettavat", "Tarkistettavat tuotteet", "Tarkistettava")
    chosen = tax.choose_group([(F.col("by_category"), "inventory_category_mapped"), (by_text, "title_description_rule"), (old, "previous_tree_fallback")], default)
    return p.withColumn("g", chosen).select("p_partkey", F.col("g.source").alias("source"), F.col("g.l1").alias("l1"))


@query("tx_04_majority_group", sql("hist", """
SELECT code, l1, l2 FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY n DESC, seen, l1, l2) AS r FROM (
SELECT upper(sku) AS code, reference AS l1, status AS l2, count(*) AS n, min(line_id) AS seen FROM hist GROUP BY 1, 2, 3)) WHERE r = 1"""))
def _(spark, sf):
    lines = history_lines(spark, sf).select("sku", F.col("reference").alias("l1"), F.col("status").alias("l2"), "line_id")
    return tax.majority_groups(lines, ["sku"], ["l1", "l2"], "line_id").select("code", "l1", "l2")


@query("tx_04_canonical_group", """
SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'Toimistotuotteet' WHEN 1 THEN 'Vaatteet' WHEN 2 THEN 'Muut / tarkistettavat' ELSE p_type END AS l1,
 CASE p_size % 4 WHEN 0 THEN 'Toimistotarvikkeet' WHEN 1 THEN 'Asusteet' WHEN 2 THEN 'Toimitus- ja käsittelykulut' ELSE p_brand END AS l2,
 CASE p_size % 4 WHEN 0 THEN p_name WHEN 1 THEN p_name WHEN 2 THEN 'Toimitus- ja käsittelykulut' ELSE p_name END AS l3 FROM part""")
def _(spark, sf):
    s = F.col("p_size") % 4
    l1 = F.when(s == 0, "Toimisto, painotuotteet ja pakkaukset").when(s == 1, "Asusteet").when(s == 2, "Toimitus- ja käsittelykulu").otherwise(F.col("p_type"))
    l2 = F.when(s == 0, "").otherwise(F.col("p_brand"))
    return table(spark, sf, "part").withColumn("g", tax.canonical_group(l1, l2, F.col("p_name"))).select("p_partkey", "g.l1", "g.l2", "g.l3")


_CODED = f"""
WITH t AS (SELECT p_partkey, p_type AS l1, p_brand AS l2, p_name AS l3 FROM part),
a AS (SELECT *, lpad(dense_rank() OVER (ORDER BY {fold_sql('l1')}, l1)::VARCHAR, 2, '0') AS c1 FROM t),
b AS (SELECT *, c1 || '.' || lpad(dense_rank() OVER (PARTITION BY l1 ORDER BY {fold_sql('l2')}, l2)::VARCHAR, 2, '0') AS c2 FROM a),
c AS (SELECT *, c2 || '.' || lpad(dense_rank() OVER (PARTITION BY l1, l2 ORDER BY {fold_sql('l3')}, l3)::VARCHAR, 2, '0') AS c3 FROM b)"""


def _coded(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.col("p_type").alias("l1"), F.col("p_brand").alias("l2"), F.col("p_name").alias("l3"))
    return tax.tree_codes(p, ["l1", "l2", "l3"])


@query("tx_05_tree_codes", _CODED + " SELECT p_partkey, c3 AS l3_code, c1 || ' > ' || c2 || ' > ' || c3 AS path_code, l1 || ' > ' || l2 || ' > ' || l3 AS path_name FROM c")
def _(spark, sf):
    return _coded(spark, sf)[0].select("p_partkey", "l3_code", "path_code", "path_name")


@query("wn_07_sibling_numbers", _CODED + " SELECT 1 AS level, c1 AS code, l1 AS name, '' AS parent_code, count(*) AS product_count FROM c GROUP BY ALL UNION ALL SELECT 2, c2, l2, c1, count(*) FROM c GROUP BY ALL UNION ALL SELECT 3, c3, l3, c2, count(*) FROM c GROUP BY ALL")
def _(spark, sf):
    return _coded(spark, sf)[1].select("level", "code", "name", "parent_code", "product_count")


@query("tx_06_next_codes", _CODED + """
SELECT parent_code, name, parent_code || '.' || lpad((coalesce(m, 0) + row_number() OVER (PARTITION BY parent_code ORDER BY name))::VARCHAR, 2, '0') AS code FROM
(SELECT DISTINCT c1 AS parent_code, 'new ' || l3 AS name FROM c) LEFT JOIN (SELECT c1 AS parent_code, max(split_part(c2, '.', 2)::INTEGER) AS m FROM c GROUP BY 1) USING (parent_code)""")
def _(spark, sf):
    coded, nodes = _coded(spark, sf)
    fresh = coded.select(F.col("l1_code").alias("parent_code"), F.concat(F.lit("new "), "l3").alias("name"))
    return tax.next_codes(nodes.filter("level = 2").select("parent_code", "code"), fresh)


@query("tx_07_apply_suggestions", """
SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'A > ' || p_name ELSE p_type END AS path, p_partkey % 7 = 0 AS changed FROM part""")
def _(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.col("p_type").alias("path"), "p_name")
    s = p.filter("p_partkey % 7 = 0").select("p_partkey", F.explode(F.array(F.struct(F.concat(F.lit("A > "), "p_name").alias("path"), F.lit(1).alias("o")), F.struct(F.lit("B").alias("path"), F.lit(2).alias("o")))).alias("s"))
    return tax.apply_suggestions(p, s.select("p_partkey", "s.path", "s.o"), "p_partkey", "path", "o").select("p_partkey", "path", "changed")


@query("tx_08_merge_small_leaves", """
SELECT p_partkey, CASE WHEN n < 12 THEN 'Tarkistettavat' ELSE p_brand END AS l3, CASE WHEN n < 12 THEN 's_merged_small_l3' ELSE 's' END AS source FROM (SELECT *, count(*) OVER (PARTITION BY p_type, p_size, p_brand) AS n FROM (SELECT *  REPLACE (p_size % 2 AS p_size) FROM part))""")
def _(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.col("p_type").alias("l1"), (F.col("p_size") % 2).cast("string").alias("l2"), F.col("p_brand").alias("l3"), F.lit("s").alias("source"), F.lit("medium").alias("confidence"))
    return tax.merge_small_leaves(p, ["l1", "l2", "l3"], 12).select("p_partkey", "l3", "source")


@query("flt_06_excluded_terms", "SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '(erth|aufle|quel|rahti)')")
def _(spark, sf):
    return table(spark, sf, "documents").filter(tx.has_any(F.lower("text"), ["erth", "aufle", "quel", "rahti"])).select("doc_id")


@query("flt_08_other_groups", "SELECT p_partkey, p_size % 3 = 0 AS other_like FROM part")
def _(spark, sf):
    level = F.when(F.col("p_size") % 3 == 0, F.when(F.col("p_size") % 2 == 0, "Muut tuotteet").otherwise("TARKISTETTAVAT")).otherwise(F.col("p_type"))
    return table(spark, sf, "part").select("p_partkey", tax.is_other_like(F.col("p_brand"), level).alias("other_like"))


@query("flt_10_missing_or_zero", "SELECT p_partkey, p_size % 4 IN (0, 1, 2) AS missing FROM part")
def _(spark, sf):
    s = F.col("p_size") % 4
    value = F.when(s == 0, "0,0").when(s == 1, " ").when(s == 3, F.col("p_size").cast("string"))
    return table(spark, sf, "part").select("p_partkey", nm.missing_or_zero(value).alias("missing"))


# --------------------------------------------------------------------------- group fills

def _fill_rows(spark, sf):
    """Sales rows with keys, part of them without a group; and the master that knows most codes."""
    p = products(spark, sf)
    master = p.select(
        tx.source_code_key(F.col("code")).alias("code_key"), tx.source_code_key(F.col("sku")).alias("sku_key"), tx.product_name_key(F.col("product_name")).alias("name_key"),
        tx.product_name_key(F.col("title_fi")).alias("title_key"), tx.product_name_key(F.col("inventory_category")).alias("category_key"),
        F.col("product_group_l1_name").alias("group_l1"), F.col("product_group_l2_name").alias("group_l2"), F.col("product_group_l3_name").alias("group_l3"),
    )
    normal = [tx.source_code_key(F.col("sku")).alias("sku_key"), tx.product_name_key(F.col("product_name")).alias("name_key"), tx.product_name_key(F.col("inventory_category")).alias("category_key")]
    lines = history_lines(spark, sf, [*normal, "product_group_l1_name", "product_group_l2_name", "product_group_l3_name"])
    # what a line without a product has
    text = lambda c: F.coalesce(c, F.lit(""))
    k = F.col("line_id") % 5
    keep = k == 0
    sales = lines.select(
        "line_id", F.when(k == 1, text("sku_key")).otherwise("").alias("code_key"), F.when(k == 2, text("sku_key")).otherwise("").alias("option_key"),
        F.when(k != 1, text("name_key")).otherwise("").alias("name_key"), text("category_key").alias("category_key"),
        tx.product_name_key(F.col("reference")).alias("reference_key"), F.when(keep, F.col("product_group_l1_name")).alias("group_l1"),
        F.when(keep, F.col("product_group_l2_name")).alias("group_l2"), F.when(keep, F.col("product_group_l3_name")).alias("group_l3"), F.when(keep, "given").alias("match_method"),
    )
    return sales, master


def _unique_sql(source: str, keys: str, where: str) -> str:
    return f"""SELECT {keys}, struct_pack(g1 := min(g1), g2 := min(g2), g3 := min(g3)) AS g FROM {source} WHERE {where} AND coalesce(g3, '') <> '' GROUP BY ALL
 HAVING count(DISTINCT g1) = 1 AND count(DISTINCT g2) = 1 AND count(DISTINCT g3) = 1"""


def _step_sql(source: str, lookup: str, on: str, method: str) -> str:
    hit = "coalesce(s.g3, '') = '' AND u.g IS NOT NULL"
    return f"""SELECT s.* REPLACE (CASE WHEN {hit} THEN u.g.g1 ELSE s.g1 END AS g1, CASE WHEN {hit} THEN u.g.g2 ELSE s.g2 END AS g2, CASE WHEN {hit} THEN u.g.g3 ELSE s.g3 END AS g3,
 CASE WHEN {hit} THEN '{method}' ELSE s.m END AS m) FROM {source} s LEFT JOIN {lookup} u ON {on}"""


_FILL_KEYS = {
    "r0": """SELECT h.line_id, CASE WHEN h.line_id % 5 = 1 THEN upper(h.sku) ELSE '' END AS ck, CASE WHEN h.line_id % 5 = 2 THEN upper(h.sku) ELSE '' END AS ok, CASE WHEN h.line_id % 5 <> 1 THEN h.product_name ELSE '' END AS nk, lower(h.inventory_category) AS cat,
 lower(h.reference) AS ref, CASE WHEN h.line_id % 5 = 0 THEN p.product_group_l1_name END AS g1, CASE WHEN h.line_id % 5 = 0 THEN p.product_group_l2_name END AS g2, CASE WHEN h.line_id % 5 = 0 THEN p.product_group_l3_name END AS g3,
 CASE WHEN h.line_id % 5 = 0 THEN 'given' END AS m FROM hist h LEFT JOIN prod p USING (product_id)""",
    "pk": "SELECT upper(code) AS k, product_name AS nk, lower(title_fi) AS tk, lower(inventory_category) AS cat, product_group_l1_name AS g1, product_group_l2_name AS g2, product_group_l3_name AS g3 FROM prod",
    "nm": "SELECT nk, cat, g1, g2, g3 FROM pk UNION ALL SELECT tk, cat, g1, g2, g3 FROM pk WHERE tk IS NOT NULL",
    "bc": _unique_sql("pk", "k", "k <> ''"), "nc": _unique_sql("nm", "nk, cat", "nk <> '' AND cat <> ''"), "nn": _unique_sql("nm", "nk", "nk <> ''"),
    "r1": _step_sql("r0", "bc", "u.k = s.ck", "source_zip_productcode_code"), "r2": _step_sql("r1", "bc", "u.k = s.ok", "source_zip_optioncode_code"),
    "r3": _step_sql("r2", "nc", "u.nk = s.nk AND u.cat = s.cat", "source_zip_name_category_unique"), "r4": _step_sql("r3", "nn", "u.nk = s.nk", "source_zip_name_unique"),
    "u1": _unique_sql("r4", "ck", "ck <> ''"), "u2": _unique_sql("r4", "ok", "ok <> ''"), "u3": _unique_sql("r4", "nk, cat, ref", "nk <> '' AND cat <> '' AND ref <> ''"),
    "u4": _unique_sql("r4", "nk, cat", "nk <> '' AND cat <> ''"), "u5": _unique_sql("r4", "nk", "nk <> ''"),
    "r5": _step_sql("r4", "u1", "u.ck = s.ck", "same_sales_productcode_unique"), "r6": _step_sql("r5", "u2", "u.ok = s.ok", "same_sales_optioncode_unique"),
    "r7": _step_sql("r6", "u3", "u.nk = s.nk AND u.cat = s.cat AND u.ref = s.ref", "same_sales_name_category_reference_unique"),
    "r8": _step_sql("r7", "u4", "u.nk = s.nk AND u.cat = s.cat", "same_sales_name_category_unique"), "r9": _step_sql("r8", "u5", "u.nk = s.nk", "same_sales_name_unique"),
}


@query("en_01_fill_cascade", sql("hist prod", "SELECT line_id, g3 AS group_l3, m AS match_method FROM r9", _FILL_KEYS))
def _(spark, sf):
    sales, master = _fill_rows(spark, sf)
    return en.fill_missing_groups(sales, master, row_id=["line_id"]).select("line_id", "group_l3", "match_method")


@query("en_02_same_key_fill", """
WITH t AS (SELECT o_orderkey, o_orderpriority AS ref, o_orderstatus AS cat, 'c' || o_custkey AS cust, CASE WHEN o_orderkey % 4 <> 0 THEN 'g' || (o_custkey % 7) END AS g FROM orders),
a AS (SELECT ref, cat, min(g) AS v FROM t WHERE g IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT g) = 1), t1 AS (SELECT t.* REPLACE (coalesce(t.g, v) AS g), CASE WHEN t.g IS NULL AND v IS NOT NULL THEN 'same_ref_category_unique_refresh' END AS m FROM t LEFT JOIN a USING (ref, cat)),
b AS (SELECT cust, cat, min(g) AS v FROM t1 WHERE g IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT g) = 1)
SELECT o_orderkey, coalesce(t1.g, v) AS group_l3, coalesce(m, CASE WHEN t1.g IS NULL AND v IS NOT NULL THEN 'same_cust_category_unique_refresh' END) AS match_method FROM t1 LEFT JOIN b USING (cust, cat)""")
def _(spark, sf):
    g = F.when(F.col("o_orderkey") % 4 != 0, F.concat(F.lit("g"), (F.col("o_custkey") % 7).cast("string")))
    o = table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_orderpriority").alias("ref"), F.col("o_orderstatus").alias("cat"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("cust"),
        g.alias("group_l3"), F.lit(None).cast("string").alias("match_method"),
    )
    return en.fill_from_same_key(o, ["ref", "cust"], "cat", groups=["group_l3"]).select("o_orderkey", "group_l3", "match_method")


_GUIDED = tax.pattern_rules("category_guided")
_CAT_SQL = "CASE p_size % 4 WHEN 0 THEN 'Sales promotion' WHEN 1 THEN 'Suojaimet' WHEN 2 THEN 'Liikelahjat' END"


def _category():
    s = F.col("p_size") % 4
    return F.when(s == 0, "Sales promotion").when(s == 1, "Suojaimet").when(s == 2, "Liikelahjat")


@query("en_03_rules_on_missing", f"""
WITH t AS (SELECT p_partkey, {_translated_sql()} AS x, {_CAT_SQL} AS cat, CASE WHEN p_partkey % 3 = 0 THEN p_type END AS g FROM part)
SELECT p_partkey, coalesce(g, r) AS group_l3, CASE WHEN g IS NULL AND r IS NOT NULL THEN 'category_guided_name_rule:' || nm END AS match_method FROM (
SELECT *, {_rules_sql(_GUIDED, 'x', '2', folded=False)} AS r, {_rules_sql(_GUIDED, 'x', 'name', folded=False)} AS nm FROM t)""")
def _(spark, sf):
    given = F.when(F.col("p_partkey") % 3 == 0, F.col("p_type"))
    p = table(spark, sf, "part").withColumns({"cat": _category(), **{g: given for g in en.GROUP}, "match_method": F.lit(None).cast("string")})
    return en.fill_by_rules(p, _GUIDED, _translated(), F.col("cat")).select("p_partkey", "group_l3", "match_method")


@query("en_04_rules_overwrite", f"""
SELECT p_partkey, CASE WHEN contains({_translated_sql()}, 'muki') THEN 'Mukit' ELSE p_type END AS group_l3 FROM part""")
def _(spark, sf):
    rule = tax.Rule("mugs", ("Koti ja keittiö", "Juoma-astiat", "Mukit"), words=("muki",))
    p = table(spark, sf, "part").withColumns({**{g: F.col("p_type") for g in en.GROUP}, "match_method": F.lit("old")})
    return en.fill_by_rules(p, [rule], _translated(), None, prefix="named_rule", only_missing=False).select("p_partkey", "group_l3")


# name, category, expected group and method, written by hand
_NAMED = (
    ("Musta Softshell-takki L", None, "Takit", "name_keyword:softshell takki"), ("Takkilan tuote", None, None, None), ("valkoinen MUKI", "Liikelahjat", "Mukit", "name_keyword:muki"),
    ("Pehmeä kylpypyyhe 70 x 140 cm", None, "Pyyhkeet ja laudeliinat", "name_keyword:kylpypyyhe"), ("Luhta Aalto kylpypyyhe 70 x 140 cm", None, "Pyyhkeet ja laudeliinat", "manual_luhta_aalto_towel_rule"),
    ("Polo shirt navy", None, "Pikeepaidat", "common_name_keyword:pikeepaita/polo"), ("notebook", "Liikelahja ", "Muut lahjasetit", "manual_missing_liikelahjat_to_gift_sets_rule"), ("Note A6", None, "Kortit ja julkaisut", "common_name_keyword:saatekortti/note"),
    ("Import  Export   duties", None, "Toimitus- ja käsittelykulu", "manual_delivery_duties_customization_rule"), ("Exports", None, None, None), ("Seinäkello puu", None, "Muut korut ja kellot", "manual_kello_keyword_rule"),
    ("Pick & pack", None, "Toimitus- ja käsittelykulu", "manual_express_pick_pack_rule"), ("pick & pack", None, None, None), ("Urheilupullo 0,5 l", None, "Juomapullot ja termospullot", "manual_urheilupullo_rule"), ("T-paita lasten", None, "T-paidat", "common_name_keyword:t-paita/t-shirt/fanipaita"),
)


def _quoted(value):
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


@query("en_03_name_fills", f"""
WITH e AS (SELECT * FROM (VALUES {", ".join(f"({i}, {_quoted(g)}, {_quoted(m)})" for i, (_, _, g, m) in enumerate(_NAMED))}) v(i, g, m))
SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 AND coalesce(m, '') NOT LIKE 'manual_%' OR p_partkey % 4 = 0 AND (m LIKE '%duties%' OR m LIKE '%liikelahjat%') THEN 'given' ELSE g END AS group_l3,
 CASE WHEN p_partkey % 4 = 0 AND coalesce(m, '') NOT LIKE 'manual_%' OR p_partkey % 4 = 0 AND (m LIKE '%duties%' OR m LIKE '%liikelahjat%') THEN 'old' ELSE m END AS match_method FROM part JOIN e ON i = p_partkey % {len(_NAMED)}""")
def _(spark, sf):
    k = F.col("p_partkey") % len(_NAMED)
    pick = lambda j: F.element_at(F.array(*[F.lit(r[j]).cast("string") for r in _NAMED]), k.cast("int") + 1)
    given = F.col("p_partkey") % 4 == 0
    rows = table(spark, sf, "part").withColumns({"name": pick(0), "cat": pick(1), **{g: F.when(given, "given") for g in en.GROUP}, "match_method": F.when(given, "old")})
    return en.fill_by_names(rows, F.col("name"), F.col("cat")).select("p_partkey", "group_l3", "match_method")


@query("en_05_group_by_code", """
WITH m AS (SELECT 'K' || (p_partkey % 1200) AS c, p_type AS g FROM part WHERE p_partkey % 5 <> 0), s AS (SELECT c, CASE WHEN min(g) = max(g) THEN min(g) END AS g, count(DISTINCT g) AS n FROM m GROUP BY 1)
SELECT l_orderkey, l_linenumber, l_partkey, g AS product_group_from_code, CASE WHEN l_partkey % 9 = 0 THEN 'missing_code' WHEN n = 1 THEN 'unique_master_code' WHEN n > 1 THEN 'ambiguous_code' ELSE 'unmatched_code' END AS product_code_match
FROM lineitem LEFT JOIN s ON l_partkey % 9 <> 0 AND c = 'K' || (l_partkey % 1500)""")
def _(spark, sf):
    key = F.col("p_partkey")
    master = table(spark, sf, "part").filter("p_partkey % 5 <> 0").select(F.concat(F.lit("K"), (key % 1200).cast("string")).alias("product_code"), F.col("p_type").alias("product_group"))
    code = F.when(F.col("l_partkey") % 9 != 0, F.concat(F.lit("K"), (F.col("l_partkey") % 1500).cast("string"))).otherwise("")
    out = en.group_by_code(table(spark, sf, "lineitem").withColumn("product_code", code), master, row_id=["l_orderkey", "l_linenumber"])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "product_group_from_code", "product_code_match")


@query("en_06_group_by_name")
def _(spark, sf):
    """Names altered in known ways against the product master; the cascade says how each was found."""
    m = product_master(spark, sf).select("product_code", F.lower("product_name").alias("name_key"), "product_group").filter(F.col("product_group").isNotNull())
    k = F.crc32("name_key") % 6
    altered = (
        F.when(k == 0, F.col("name_key")).when(k == 1, F.regexp_replace("name_key", " ", "-")).when(k == 2, F.concat(F.col("name_key"), F.lit(" toimitus")))
        .when(k == 3, F.concat(F.lit("x"), F.col("name_key"))).when(k == 4, F.concat(F.lit("erikois "), F.substring_index("name_key", " ", 2))).otherwise(F.lit("tuntematon"))
    )
    names = m.select(altered.alias("name_key"), F.when(k == 5, F.lower("product_group")).otherwise("").alias("category_key"))
    from ledgerlift.plans.recommend import EXCLUDED_PRODUCT_TERMS

    return en.group_by_name(names, m, terms=EXCLUDED_PRODUCT_TERMS, aliases={"lahjakortti": "small ring"})


@query("en_07_context_fill", sql("hist", """
WITH t AS (SELECT line_id, account_id, order_id, reference, product_name AS nk, CASE WHEN line_id % 3 = 0 THEN product_group END AS g FROM hist),
r AS (SELECT reference, min(g) AS v FROM t WHERE g IS NOT NULL GROUP BY 1 HAVING count(DISTINCT g) = 1), t1 AS (SELECT t.* REPLACE (coalesce(g, v) AS g), CASE WHEN g IS NULL THEN CASE WHEN v IS NOT NULL THEN 'reference_context' ELSE 'unmatched' END END AS s FROM t LEFT JOIN r USING (reference)),
o AS (SELECT order_id, min(g) AS v FROM t1 WHERE g IS NOT NULL GROUP BY 1 HAVING count(DISTINCT g) = 1), t2 AS (SELECT t1.* REPLACE (coalesce(g, v) AS g, CASE WHEN g IS NULL AND v IS NOT NULL THEN 'order_context' ELSE s END AS s) FROM t1 LEFT JOIN o USING (order_id)),
c AS (SELECT account_id, nk, min(g) AS v FROM t2 WHERE g IS NOT NULL AND nk IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT g) = 1)
SELECT line_id, coalesce(g, v) AS product_group, CASE WHEN g IS NULL AND v IS NOT NULL THEN 'customer_history' ELSE s END AS context_source FROM t2 LEFT JOIN c USING (account_id, nk)"""))
def _(spark, sf):
    lines = history_lines(spark, sf).select(
        "line_id", "account_id", "order_id", "reference", F.col("product_name").alias("name_key"), F.when(F.col("line_id") % 3 == 0, F.col("product_group")).alias("product_group")
    )
    return en.group_by_context(lines, row_id=["line_id"]).select("line_id", "product_group", "context_source")


@query("en_08_enrich_sales_rows", sql("hist", """
SELECT line_id, coalesce(g1, g2) AS product_group, CASE WHEN g1 IS NOT NULL THEN 'code' WHEN g2 IS NOT NULL THEN 'name' ELSE 'open' END AS step FROM (SELECT h.line_id, CASE WHEN h.line_id % 2 = 0 THEN h.product_group END AS g1, n.g AS g2 FROM hist h
LEFT JOIN (SELECT product_name AS nk, min(product_group) AS g FROM (SELECT DISTINCT product_name, product_group, sku FROM hist WHERE product_group IS NOT NULL) GROUP BY 1 HAVING count(DISTINCT sku) = 1) n ON n.nk = h.product_name)"""))
def _(spark, sf):
    """Code first, exact name for what is left: on distinct names, joined back to every row."""
    from ledgerlift.operators.lookup import sparse_join, unique_lookup

    lines = history_lines(spark, sf).select("line_id", "sku", F.col("product_name").alias("name_key"), "product_group")
    master = lines.filter(F.col("product_group").isNotNull()).select("name_key", F.col("sku").alias("product_code"), "product_group").distinct()
    by_code = en.group_by_code(
        lines.drop("product_group").withColumn("product_code", F.when(F.col("line_id") % 2 == 0, F.col("sku")).otherwise("")), master.select("product_code", "product_group").distinct(), row_id=["line_id"],
    )
    names = unique_lookup(master, ["name_key"], ["product_code", "product_group"], must_agree=["product_code", "product_group"]).select("name_key", F.col("product_group").alias("_g"))
    out = sparse_join(by_code, names, ["name_key"], F.col("product_group_from_code").isNull(), spread=["line_id"])
    step = F.when(F.col("product_group_from_code").isNotNull(), "code").when(F.col("_g").isNotNull(), "name").otherwise("open")
    return out.select("line_id", F.coalesce("product_group_from_code", "_g").alias("product_group"), step.alias("step"))


@query("en_18_lowest_group", sql("hist prod", """
SELECT line_id, coalesce(nullif(product_group_l3_name, ''), nullif(h.inventory_category, ''), h.reference) AS lowest_group, CASE WHEN product_group_l3_name IS NULL THEN 'sales_category_or_reference' ELSE 'product_master_sku' END AS product_group_source
FROM hist h LEFT JOIN prod p USING (product_id)"""))
def _(spark, sf):
    master = products(spark, sf).withColumn("lowest_group", F.col("product_group_l3_name"))
    lines = history_lines(spark, sf).select("line_id", "sku", F.col("inventory_category").alias("category"), "reference")
    return en.lowest_group_of_sales(lines, master, ["sku", "code", "product_id"], row_id=["line_id"]).select("line_id", "lowest_group", "product_group_source")


# --------------------------------------------------------------------------- measures

def _described(spark, sf):
    size = F.col("p_size").cast("string")
    k = F.col("p_partkey") % 6
    text = (
        F.when(k == 0, F.concat(F.lit("Paino: "), size, F.lit(",5 kg, leveys "), size, F.lit(" cm ja pituus "), size, F.lit(" mm")))
        .when(k == 1, F.concat(F.lit("kangas "), size, F.lit(" g/m2, paino "), size, F.lit(" g. Koko "), size, F.lit(" x 10 x 3,5 cm")))
        .when(k == 2, F.concat(F.lit("width: "), size)).when(k == 3, F.concat(F.col("p_name"), F.lit(" "), size, F.lit(" x 2 x 3")))
        .when(k == 4, F.col("p_name"))
    )
    return table(spark, sf, "part").withColumn("description", text)


@query("en_09_extract_weight", """
SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_size + 0.5::DOUBLE WHEN 1 THEN p_size::DOUBLE END AS weight_value, CASE p_partkey % 6 WHEN 0 THEN 'kg' WHEN 1 THEN 'g' ELSE '' END AS weight_unit,
 CASE p_partkey % 6 WHEN 0 THEN (p_size + 0.5::DOUBLE) * 1000 WHEN 1 THEN p_size::DOUBLE END AS weight_g FROM part""")
def _(spark, sf):
    return en.extract_weight(_described(spark, sf), "description").select("p_partkey", "weight_value", "weight_unit", "weight_g")


@query("en_10_extract_dimensions", """
SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'parsed_explicit' WHEN 1 THEN 'parsed_assumed_order' WHEN 2 THEN 'value_found_unit_missing' WHEN 3 THEN 'value_found_unit_missing' ELSE 'not_found' END AS dimension_parse_status,
 CASE p_partkey % 6 WHEN 0 THEN p_size::DOUBLE WHEN 1 THEN 10.0::DOUBLE END AS width_value, CASE p_partkey % 6 WHEN 0 THEN p_size::DOUBLE WHEN 1 THEN p_size::DOUBLE END AS length_value,
 CASE p_partkey % 6 WHEN 0 THEN 'mm' WHEN 1 THEN 'cm' ELSE '' END AS length_unit, CASE p_partkey % 6 WHEN 1 THEN 3.5::DOUBLE END AS depth_value FROM part""")
def _(spark, sf):
    return en.extract_dimensions(_described(spark, sf), "description").select("p_partkey", "dimension_parse_status", "width_value", "length_value", "length_unit", "depth_value")


_NUMBER, _UNITS = r"\d+(?:[.,]\d+)?", "kilograms|kilogram|kg|grams|gram|g"
_SIZES, _LONG_UNITS = rf"{_NUMBER}\s*(?:x|×|\*|by)\s*{_NUMBER}(?:\s*(?:x|×|\*|by)\s*{_NUMBER})?", "millimeter|millimetre|centimeter|centimetre|mm|cm|m"


def _visible_sql(html: str) -> str:
    """Visible text of a page, with the references that the pages use."""
    for tag in ("script", "style", "noscript"):
        html = f"regexp_replace({html}, '<{tag}\\b.*?</{tag}\\s*>', ' ', 'gis')"
    html = f"regexp_replace(regexp_replace({html}, '<!--.*?-->', ' ', 'gs'), '<[^>]*>', ' ', 'gs')"
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&nbsp;", " "), ("&amp;", "&")):
        html = f"replace({html}, '{name}', '{char}')"
    return f"trim(regexp_replace({html}, '\\s+', ' ', 'g'))"


def _fact_sql(patterns: list[str], group: int) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract(t, '{p}', {group}), '')" for p in patterns) + ")"


_WEIGHTS_SQL = [rf"\b(?:{en.WEIGHT_WORDS})\b\s*[:\-]?\s*({_NUMBER})\s*({_UNITS})\b", rf"({_NUMBER})\s*({_UNITS})\s*(?:\b(?:{en.WEIGHT_WORDS})\b)"]
_SIZES_SQL = [rf"\b(?:{en.SIZE_WORDS})\b\s*[:\-]?\s*({_SIZES})\s*({_LONG_UNITS})\b", rf"({_SIZES})\s*({_LONG_UNITS})\s*(?:\b(?:{en.SIZE_WORDS})\b)", rf"\b({_SIZES})\s*({_LONG_UNITS})\b"]


@query("en_11_page_facts", rf"""
SELECT page_id, replace({_fact_sql(_WEIGHTS_SQL, 1)}, ',', '.') AS extracted_weight, CASE WHEN {_fact_sql(_WEIGHTS_SQL, 2)} LIKE 'k%' THEN 'kg' WHEN {_fact_sql(_WEIGHTS_SQL, 2)} IS NOT NULL THEN 'g' END AS extracted_weight_unit,
 regexp_replace(translate({_fact_sql(_SIZES_SQL, 1)}, '×*,', 'xx.'), '\s*(?:x|\bby\b)\s*', ' x ', 'g') AS extracted_dimensions,
 CASE WHEN {_fact_sql(_SIZES_SQL, 2)} LIKE 'milli%' THEN 'mm' WHEN {_fact_sql(_SIZES_SQL, 2)} LIKE 'centi%' THEN 'cm' ELSE {_fact_sql(_SIZES_SQL, 2)} END AS extracted_dimension_unit
FROM (SELECT page_id, lower({_visible_sql("html")}) AS t FROM pages)""")
def _(spark, sf):
    """Weights and sizes found anywhere in the visible text of whole pages."""
    pages = table(spark, sf, "pages").withColumn("page_text", tx.html_text(F.col("html")))
    return en.page_facts(pages, "page_text").select("page_id", "extracted_weight", "extracted_weight_unit", "extracted_dimensions", "extracted_dimension_unit")


def _site_pages(spark, sf):
    return table(spark, sf, "pages").select("page_id", "url", "html", tx.url_domain(F.col("url")).alias("domain"))


_STOPS = ", ".join(f"'{w}'" for w in tx.NAME_STOP_WORDS)
_HINTS_SQL = " + ".join(f"CASE WHEN contains(lower(link), '{h}') THEN 0.5::DOUBLE ELSE 0 END" for h in en.PAGE_HINTS)


@query("en_17_rank_links", rf"""
WITH p AS (SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS domain, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS root, html FROM pages),
h AS (SELECT page_id, domain, root, regexp_extract_all(html, '<a [^>]*href="(/[^"]*)"', 1) AS hs FROM p),
l AS (SELECT page_id, domain, regexp_replace(root || regexp_replace(unnest(hs), '#.*$', ''), '/+$', '') AS link, unnest(range(len(hs))) AS i FROM h),
f AS (SELECT page_id, domain, link, row_number() OVER (PARTITION BY page_id ORDER BY i) AS place FROM (SELECT page_id, domain, link, min(i) AS i FROM l GROUP BY ALL)),
k AS (SELECT domain, link, min(place) AS place FROM f GROUP BY ALL),
t AS (SELECT page_id AS product_id, domain, list_filter(regexp_extract_all(lower(regexp_extract(html, '(?is)<title>(.*?)</title>', 1)), '[a-zåäö0-9]+'), lambda w: length(w) >= 3 AND w NOT IN ({_STOPS})) AS words FROM p),
s AS (SELECT product_id, link, place, len(list_filter(words, lambda w: contains(lower(link), w))) + {_HINTS_SQL} AS link_score FROM t JOIN k USING (domain))
SELECT product_id, link, link_score, rn::INTEGER AS link_rank FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY link_score DESC, place, link) AS rn FROM s WHERE link_score > 0) WHERE rn <= 6""")
def _(spark, sf):
    pages = _site_pages(spark, sf)
    links = pages.select("domain", "page_id", F.posexplode(tx.page_links(F.col("html"), F.col("url"))).alias("place", "link"))
    links = links.groupBy("domain", "link").agg(F.min("place").alias("place")).select("domain", "link", (F.col("place") + 1).alias("place"))
    titles = pages.select(F.col("page_id").alias("product_id"), F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1).alias("product_name"), "domain")
    return en.rank_links(titles, links)


@query("en_20_best_page")
def _(spark, sf):
    """Pages of a domain as candidates for the products named in the domain's titles; sizes come from the products."""
    pages = _site_pages(spark, sf).withColumn("page_text", F.concat_ws(" ", tx.html_text(F.col("html")), F.format_string("paino %d g koko %d x 4 cm", F.col("page_id") % 90 + 1, F.col("page_id") % 70 + 1)))
    titled = pages.select(F.col("page_id").alias("product_id"), tx.html_text(F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1)).alias("product_name"), "page_text", F.col("url").alias("page_url"), F.lit(1).alias("place"))
    return en.best_page(titled, titled.select("product_id", "product_name"))


def _supplier_case(spark, sf):
    p = table(spark, sf, "part")
    key = F.col("p_partkey")
    sku = F.concat(F.lit("SKU-"), F.lpad(key.cast("string"), 7, "0"))
    items = p.select(
        key.alias("product_id"), sku.alias("sku"), F.lit("").alias("code"), F.concat_ws(" ", "p_name", F.concat(F.lit("art "), F.lit("EAN"), F.lpad(key.cast("string"), 8, "0"))).alias("search_text"),
        F.when(key % 3 == 0, F.col("p_size").cast("double")).alias("weight_value"), F.lit(None).cast("double").alias("weight_g"), F.lit(0.0).alias("width_value"),
        F.when(key % 2 == 0, 7.0).alias("length_value"), F.lit(None).cast("double").alias("depth_value"),
    )
    li = table(spark, sf, "supplier").select("s_suppkey")
    # even ids are found by code, every other odd one by a code in the product's text, the rest by name
    ean = F.concat(F.lit("EAN"), F.lpad((F.col("s_suppkey") + 1000).cast("string"), 8, "0"))
    records = li.select(
        F.col("s_suppkey").alias("record_id"),
        F.when(F.col("s_suppkey") % 2 == 0, F.array(F.concat(F.lit("SKU-"), F.lpad(F.col("s_suppkey").cast("string"), 7, "0"))))
        .when(F.col("s_suppkey") % 4 == 1, F.array(ean)).otherwise(F.array(F.concat(F.lit("OWN-"), F.col("s_suppkey").cast("string")))).alias("match_keys"),
        F.when(F.col("s_suppkey") % 4 == 3, F.concat(F.lit("Art "), ean)).otherwise("no such name").alias("product_name"), (F.col("s_suppkey") % 10 + 1.0).alias("gross_weight_kg"), F.lit(None).cast("double").alias("net_weight_kg"),
        (F.col("s_suppkey") % 7 + 2.0).alias("width_cm"), F.lit(9.0).alias("length_cm"), F.lit(None).cast("double").alias("depth_cm"),
    )
    return items, records


@query("en_12_supplier_measures", """
SELECT p_partkey AS product_id, CASE WHEN s_suppkey IS NOT NULL AND p_partkey % 3 <> 0 THEN (s_suppkey % 10 + 1) * 1000.0::DOUBLE ELSE CASE WHEN p_partkey % 3 = 0 THEN p_size::DOUBLE END END AS weight_value,
 CASE WHEN s_suppkey IS NOT NULL AND p_partkey % 3 <> 0 THEN (s_suppkey % 10 + 1) * 1000.0::DOUBLE END AS weight_g, CASE WHEN s_suppkey IS NOT NULL THEN s_suppkey % 7 + 2.0::DOUBLE ELSE 0 END AS width_value,
 CASE WHEN p_partkey % 2 = 0 THEN 7.0::DOUBLE WHEN s_suppkey IS NOT NULL THEN 9.0::DOUBLE END AS length_value FROM part LEFT JOIN supplier ON (s_suppkey % 2 = 0 AND p_partkey = s_suppkey) OR (s_suppkey % 2 = 1 AND p_partkey = s_suppkey + 1000)""")
def _(spark, sf):
    items, records = _supplier_case(spark, sf)
    return en.merge_supplier_measures(items, records, en.match_suppliers(items, records)).select("product_id", "weight_value", "weight_g", "width_value", "length_value")


@query("en_13_carton_fields", """
WITH b AS (SELECT lower(p_brand) AS bk, lower(p_name) AS nk, min(p_size / 10.0::DOUBLE) AS h, max(p_size / 10.0::DOUBLE) AS hi FROM part WHERE p_partkey % 3 = 0 GROUP BY 1, 2)
SELECT p_partkey, round(CASE WHEN p_partkey % 5 = 0 THEN 99.0::DOUBLE WHEN h = hi THEN h END, 6) AS box_height, CASE WHEN p_partkey % 5 <> 0 AND h = hi THEN 'carton list' END AS box_data_source FROM part LEFT JOIN b ON bk = lower(p_brand) AND nk = lower(p_name)""")
def _(spark, sf):
    p = table(spark, sf, "part")
    boxes = p.filter("p_partkey % 3 = 0").select(F.col("p_brand").alias("brand"), F.col("p_name").alias("product_name"), F.col("p_size").cast("string").alias("box_height"))
    stable = en.stable_boxes(boxes, ["box_height"], in_mm=["box_height"])
    items = p.select("p_partkey", F.col("p_brand").alias("brand_name"), F.col("p_name").alias("product_name"), F.when(F.col("p_partkey") % 5 == 0, 99.0).alias("box_height"))
    return en.merge_boxes(items, stable, ["box_height"], row_id=["p_partkey"]).select("p_partkey", "box_height", "box_data_source")


@query("en_14_backfill_measures", "SELECT p_partkey AS product_id, CASE WHEN p_partkey % 2 = 0 THEN 5.0::DOUBLE WHEN p_partkey % 3 = 0 THEN p_size::DOUBLE ELSE 0 END AS weight_value FROM part")
def _(spark, sf):
    p = table(spark, sf, "part")
    items = p.select(F.col("p_partkey").alias("product_id"), F.when(F.col("p_partkey") % 2 == 0, 5.0).otherwise(0.0).alias("weight_value"))
    curated = p.filter("p_partkey % 3 = 0").select(F.col("p_partkey").cast("double").alias("product_id"), F.col("p_size").cast("double").alias("weight_value"))
    return en.backfill_measures(items, curated, "product_id", ["weight_value"]).select("product_id", "weight_value")


@query("en_15_brand_join", "SELECT p_partkey, CASE WHEN p_size % 10 BETWEEN 1 AND 7 THEN 'Brand ' || (p_size % 10) END AS brand_name FROM part")
def _(spark, sf):
    p = table(spark, sf, "part")
    brands = p.filter("p_size % 10 BETWEEN 1 AND 7").select((F.col("p_size") % 10).cast("double").alias("brand_id")).distinct().withColumn("brand_name", F.concat(F.lit("Brand "), F.col("brand_id").cast("int").cast("string")))
    out, _ = en.with_brands(p.select("p_partkey", (F.col("p_size") % 10).alias("brand_id")), brands, row_id=["p_partkey"])
    return out.select("p_partkey", "brand_name")


@query("en_15_unmapped_brands", "SELECT (p_size % 10)::VARCHAR AS brand_key, count(*) AS products FROM part WHERE p_size % 10 > 7 GROUP BY 1")
def _(spark, sf):
    p = table(spark, sf, "part")
    brands = p.filter("p_size % 10 BETWEEN 1 AND 7").select((F.col("p_size") % 10).alias("brand_id")).distinct().withColumn("brand_name", F.lit("b"))
    return en.with_brands(p.select("p_partkey", (F.col("p_size") % 10).alias("brand_id")), brands, row_id=["p_partkey"])[1]


_MASTER = tax.pattern_rules("master_categories")


@query("en_16_master_categories", f"""
WITH t AS (SELECT p_partkey, {_translated_sql()} AS x FROM part)
SELECT p_partkey, {' '.join(_rules_sql(_MASTER, 'x', '2', folded=False).split())} AS category_level_3 FROM t""")
def _(spark, sf):
    out = tax.classify(table(spark, sf, "part"), _MASTER, _translated(), "g")
    return out.select("p_partkey", F.col("g.l3").alias("category_level_3"))


@query("en_19_variants", "SELECT l_orderkey AS product_id, count(*)::INTEGER AS variant_count, count_if(l_returnflag = 'N')::INTEGER AS active_variant_count FROM lineitem GROUP BY 1")
def _(spark, sf):
    opts = F.array_sort(F.collect_list(F.struct(F.col("l_partkey").cast("string").alias("code"), F.when(F.col("l_returnflag") == "N", 1).otherwise(0).alias("status"))))
    items = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("product_id")).agg(opts.alias("options"))
    return en.variant_facts(items).select("product_id", "variant_count", "active_variant_count")


@query("en_19_new_products", "SELECT p_partkey, p_partkey % 4 = 0 AS is_new_or_missing FROM part")
def _(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("k"), F.col("p_partkey").cast("string")).alias("code"))
    return en.new_or_missing(p, p.filter("p_partkey % 4 <> 0").select(F.upper("code").alias("code")), "code").select("p_partkey", "is_new_or_missing")
