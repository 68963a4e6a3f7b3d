"""Filling what product and sales rows lack: groups, measures, brands, page facts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlift.functions import numbers as nm
from ledgerlift.functions import text as tx
from ledgerlift.operators.lookup import (
    cascade_fill, contained_names, first_of_columns, fuzzy_best, index_join, key_status, similar_pairs, sparse_join, token_in_text_join,
    unique_lookup,
)
from ledgerlift.operators.ranking import first_per_key, grouped_row_number, join_on, take_places, top_n
from ledgerlift.plans import taxonomy as tax
from ledgerlift.session import stage

# --------------------------------------------------------------------------- groups on sales rows

GROUP = ("group_l1", "group_l2", "group_l3")


def has_group(code: str, name: str) -> Column:
    return (F.coalesce(F.trim(code), F.lit("")) != "") & (F.coalesce(F.trim(name), F.lit("")) != "")


def fill_missing_groups(sales: DataFrame, master: DataFrame, *, row_id: Sequence[str], groups: Sequence[str] = GROUP) -> DataFrame:
    """Eleven ordered lookups for rows without a group; each key must lead to exactly one group.

    First the master (codes, then name and category, then name), then the rows of the same table
    that have a group by now.  ``sales`` and ``master`` carry normalised keys: code_key,
    option_key, name_key, category_key, reference_key; master: code_key, sku_key, name_key,
    title_key, category_key.  The lookups run on the different keys of the open rows, and rows meet the outcome once
    for the master and once for their own table; rows that have a group are not moved.
    """
    missing = F.coalesce(F.trim(groups[-1]), F.lit("")) == ""
    known = stage(master.filter(~missing), "fill-known")
    names = known.unionByName(known.withColumn("name_key", F.col("title_key")))

    def lookup(df: DataFrame, keys: Sequence[str]) -> DataFrame:
        return unique_lookup(df, keys, groups)

    by_code, by_sku = lookup(known, ["code_key"]), lookup(known, ["sku_key"])
    first_steps = [
        ("source_zip_productcode_code", ["code_key"], by_code, ["code_key"]),
        ("source_zip_productcode_sku", ["code_key"], by_sku, ["sku_key"]),
        ("source_zip_optioncode_code", ["option_key"], by_code, ["code_key"]),
        ("source_zip_optioncode_sku", ["option_key"], by_sku, ["sku_key"]),
        ("source_zip_name_category_unique", ["name_key", "category_key"], lookup(names, ["name_key", "category_key"]), ["name_key", "category_key"]),
        ("source_zip_name_unique", ["name_key"], lookup(names, ["name_key"]), ["name_key"]),
    ]
    rows = stage(sales, "fill-rows")
    after_master = stage(_fill_by_keys(rows, first_steps, groups, ["code_key", "option_key", "name_key", "category_key"]), "fill-master")
    grouped = after_master.filter(~missing)
    own = {
        "same_sales_productcode_unique": ["code_key"],
        "same_sales_optioncode_unique": ["option_key"],
        "same_sales_name_category_reference_unique": ["name_key", "category_key", "reference_key"],
        "same_sales_name_category_unique": ["name_key", "category_key"],
        "same_sales_name_unique": ["name_key"],
    }
    steps = [(method, keys, lookup(grouped, keys), keys) for method, keys in own.items()]
    return _fill_by_keys(after_master, steps, groups, ["code_key", "option_key", "name_key", "category_key", "reference_key"])


def _fill_by_keys(rows: DataFrame, steps: Sequence[tuple[str, Sequence[str], DataFrame, Sequence[str]]], groups: Sequence[str], keys: Sequence[str], method: str = "match_method") -> DataFrame:
    """As :func:`cascade_fill`, once for each combination of ``keys`` that open rows hold; ``rows`` is read twice.

    Blank and missing keys match nothing, so they count as one.
    """
    missing = F.coalesce(F.trim(groups[-1]), F.lit("")) == ""
    plain = {f"_k_{k}": F.coalesce(F.col(k), F.lit("")) for k in keys}
    first = [k for _, on, _, _ in steps for k in on[:1]]
    some = F.coalesce(F.greatest(F.lit(""), *first) != "", F.lit(False))
    ask = missing & some
    types = {f.name: f.dataType for f in rows.schema}
    asked = stage(rows.filter(ask).select(*[c.alias(k) for k, c in zip(keys, plain.values())]).distinct(), "fill-keys")
    blank = asked.withColumns({c: F.lit(None).cast(types[c]) for c in (*groups, method)})
    found = cascade_fill(blank, steps, groups, method, missing, spread=keys).filter(F.col(method).isNotNull())
    found = found.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[F.col(c).alias(f"_v_{c}") for c in (*groups, method)])
    hit = F.col(f"_v_{method}").isNotNull()
    filled = rows.filter(ask).withColumns(plain).join(found, list(plain), "left").withColumns({c: F.when(hit, F.col(f"_v_{c}")).otherwise(F.col(c)) for c in (*groups, method)})
    return filled.select(*rows.columns).unionByName(rows.filter(~ask))


def fill_from_same_key(sales: DataFrame, keys: Sequence[str], category: str, *, groups: Sequence[str] = GROUP, method: str = "match_method") -> DataFrame:
    """One pass per key column: rows of the same key and category with a single group fill the others.

    Later keys see earlier fills; the table is written between passes.
    """
    out = sales
    for key in keys:
        missing = F.coalesce(F.trim(groups[-1]), F.lit("")) == ""
        norm = out.withColumns({"_key": F.coalesce(tx.collapse(F.lower(F.col(key))), F.lit("")), "_cat": F.coalesce(tx.collapse(F.lower(F.col(category))), F.lit(""))})
        known = norm.filter(~missing & (F.col("_key") != "")).withColumn("_cat", F.coalesce("_cat", F.lit("")))
        lo_hi = [f(c).alias(f"{n}_{c}") for c in groups for n, f in (("lo", F.min), ("hi", F.max))]
        single = known.groupBy("_key", "_cat").agg(*lo_hi)
        for c in groups:
            single = single.filter(F.col(f"lo_{c}").eqNullSafe(F.col(f"hi_{c}")))
        single = single.select("_key", "_cat", *[F.col(f"lo_{c}").alias(f"_v_{c}") for c in groups], F.lit(True).alias("_hit"))
        open_rows = norm.filter(missing & (F.col("_key") != ""))
        rest = norm.filter(~(missing & (F.col("_key") != "")))
        filled = open_rows.join(single, ["_key", "_cat"], "left").withColumns(
            {
                **{c: F.when(F.col("_hit"), F.col(f"_v_{c}")).otherwise(F.col(c)) for c in groups},
                method: F.when(F.col("_hit"), F.lit(f"same_{key}_category_unique_refresh")).otherwise(F.col(method)),
            }
        )
        out = stage(filled.select(*sales.columns).unionByName(rest.select(*sales.columns)), "same-key")
    return out


def fill_by_rules(df: DataFrame, rules: Sequence[tax.Rule], text: Column, category: Column | None, *, groups: Sequence[str] = GROUP,
                  method: str = "match_method", prefix: str = "category_guided_name_rule", only_missing: bool = True) -> DataFrame:
    """First fitting rule sets the group: only on rows without one, or on every fitting row."""
    marked = tax.classify(df, rules, text, "_g", category)
    use = F.col("_g").isNotNull()
    if only_missing:
        use = use & (F.coalesce(F.trim(groups[-1]), F.lit("")) == "")
    return marked.withColumns(
        {
            **{c: F.when(use, F.col(f"_g.l{i + 1}")).otherwise(F.col(c)) for i, c in enumerate(groups)},
            method: F.when(use, F.concat(F.lit(f"{prefix}:" if prefix else ""), F.col("_g.source"))).otherwise(F.col(method)),
        }
    ).drop("_g")


#: The sets of name rules in the order in which they run, and what they leave as the method; the last also overwrites.
NAME_FILLS = (("keywords", "name_keyword"), ("common_names", "common_name_keyword"), ("duties", ""), ("category_default", ""), ("overwrites", ""))


def fill_by_names(df: DataFrame, name: Column, category: Column, *, groups: Sequence[str] = GROUP, method: str = "match_method") -> DataFrame:
    """Groups from the shipped name rules: rows without a group first, set by set, then named overwrites on all rows."""
    for which, prefix in NAME_FILLS:
        df = fill_by_rules(df, tax.name_fill_rules(which), name, category, groups=groups, method=method, prefix=prefix, only_missing=which != "overwrites")
    return df


def group_by_code(sales: DataFrame, master: DataFrame, *, row_id: Sequence[str]) -> DataFrame:
    """Group by product code and how the code stands: missing, unmatched, ambiguous or unique."""
    status = key_status(master, "product_code", "product_group").withColumnRenamed("product_group", "product_group_from_code")
    out = sparse_join(sales, status, ["product_code"], spread=row_id)
    return out.withColumn(
        "product_code_match",
        F.when(F.coalesce("product_code", F.lit("")) == "", "missing_code").when(F.col("key_status") == "unique", "unique_master_code")
        .when(F.col("key_status") == "ambiguous", "ambiguous_code").otherwise("unmatched_code"),
    ).drop("key_status")


LEAF_SPLIT = r"\s*[>/|]\s*"
IGNORED_GROUP_WORDS = ("ja", "sekä", "muut", "other", "tuotteet", "products")


def group_by_name(names: DataFrame, master: DataFrame, *, terms: Sequence[str], aliases: dict[str, str], packaging_group: str = "Muut pakkaukset") -> DataFrame:
    """Group for each distinct product name, by falling certainty.

    ``names``: name_key, category_key and, if there are any, description_key (one row each combination).
    ``master``: product_code, name_key, product_group and, if there are any, description_key.  The first that is
    known counts: exact name, compact name, similar name, exact description, category, cost words, word pairs, alias
    words, similar words.  Works on distinct names, so copies of a line cost nothing.
    Result columns: product_group, product_code, name_match.
    """
    known = stage(master.filter((F.col("name_key") != "") & (F.col("product_code") != "") & (F.col("product_group") != "")), "master-names")
    described = "description_key" in names.columns and "description_key" in master.columns
    row_id = ["name_key", "category_key", *["description_key"] * described]
    keys = stage(names.select(row_id).distinct(), "names")

    def codes(df: DataFrame, key: str) -> DataFrame:
        one = unique_lookup(df, [key], ["product_code"])
        groups = first_per_key(df, [key], [("product_code", "asc"), ("product_group", "asc")]).select(key, "product_group")
        return one.join(groups, key)

    exact = codes(known, "name_key").select("name_key", F.col("product_code").alias("c1"), F.col("product_group").alias("g1"))
    out = sparse_join(keys, exact, ["name_key"], spread=row_id)
    compact = codes(known.withColumn("compact", tx.compact_key(F.col("name_key"))).filter(F.col("compact") != ""), "compact")
    compact = compact.select("compact", F.col("product_code").alias("c2"), F.col("product_group").alias("g2"))
    out = sparse_join(out.withColumn("compact", tx.compact_key(F.col("name_key"))), compact, ["compact"], F.col("g1").isNull(), spread=row_id)
    by_name = F.coalesce("g1", "g2")
    out = out.withColumn("g3", F.when(by_name.isNull() & tx.has_any(F.col("name_key"), terms), F.lit(packaging_group)))
    leaves = known.select("product_group").distinct().withColumn("leaf", tx.product_name_key(F.element_at(F.split("product_group", LEAF_SPLIT), -1)))
    alias = F.lit(None).cast("string")
    for word, leaf in aliases.items():
        alias = F.when(tx.has_any(F.col("name_key"), [word], whole_words=True), F.lit(leaf.lower())).otherwise(alias)
    leaf_group = leaves.groupBy("leaf").agg(F.min("product_group").alias("g4"))
    out = out.withColumn("leaf", F.when(by_name.isNull() & F.col("g3").isNull(), alias))
    out = stage(sparse_join(out, leaf_group, ["leaf"], spread=row_id).drop("leaf"), "names-sure")
    open_names = out.filter(by_name.isNull() & F.col("g3").isNull() & F.col("g4").isNull()).select("name_key").distinct()

    pairs = known.select("product_group", F.explode(F.array_distinct(tx.bigrams(tx.tokens(F.col("name_key"), 3)))).alias("pair"))
    pairs = pairs.groupBy("pair").agg(F.min("product_group").alias("lo"), F.max("product_group").alias("hi"))
    asked = open_names.select("name_key", F.explode(F.array_distinct(tx.bigrams(tx.tokens(F.col("name_key"), 3)))).alias("pair"))
    voted = asked.join(pairs, "pair").groupBy("name_key").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo = hi")
    out = out.join(voted.select("name_key", F.col("lo").alias("g5")), "name_key", "left")

    still = open_names.join(voted, "name_key", "left_anti")
    words = still.select("name_key", F.explode(F.array_distinct(tx.tokens(F.col("name_key"), 5))).alias("word"))
    group_words = leaves.select("product_group", F.explode(F.array_distinct(tx.tokens(F.lower("product_group"), 5))).alias("group_word")).filter(
        ~F.col("group_word").isin(*IGNORED_GROUP_WORDS)
    )
    alike = similar_pairs(words, "word", group_words, "group_word", 0.88)
    word_votes = words.join(alike, "word").join(group_words, "group_word").groupBy("name_key").agg(
        F.min("product_group").alias("lo"), F.max("product_group").alias("hi")
    ).filter("lo = hi")
    out = out.join(word_votes.select("name_key", F.col("lo").alias("g6")), "name_key", "left")

    parts = known.select("product_group").distinct().select("product_group", F.explode(F.split("product_group", LEAF_SPLIT)).alias("p"))
    category = unique_lookup(parts.select("product_group", tx.product_name_key(F.col("p")).alias("category_key")), ["category_key"], ["product_group"])
    out = sparse_join(out, category.withColumnRenamed("product_group", "g7"), ["category_key"], by_name.isNull(), spread=row_id)
    if described:
        text = codes(known.filter(F.col("description_key") != ""), "description_key").select("description_key", F.col("product_code").alias("c9"), F.col("product_group").alias("g9"))
        out = sparse_join(out, text, ["description_key"], by_name.isNull(), spread=row_id)
    else:
        out = out.withColumns({c: F.lit(None).cast("string") for c in ("c9", "g9")})

    unnamed = out.filter(by_name.isNull()).select("name_key").distinct()
    sure = codes(known, "name_key").select(F.col("name_key").alias("master_key"), F.col("product_code").alias("c8"), F.col("product_group").alias("g8"))
    close = fuzzy_best(unnamed, "name_key", sure, "master_key").join(sure, "master_key").select("name_key", "c8", "g8")
    out = out.join(close, "name_key", "left")
    tags = {
        "g8": "fuzzy_high_confidence", "g9": "description_exact", "g7": "category_exact", "g6": "product_group_word", "g5": "product_group_pair", "g4": "explicit_product_group_alias",
        "g3": "transport_packaging_keyword", "g2": "normalized_master_name", "g1": "unique_master_name",
    }
    method = F.lit("unmatched")
    for column, tag in reversed(list(tags.items())):
        method = F.when(F.col(column).isNotNull(), F.lit(tag)).otherwise(method)
    return out.select(
        *row_id, F.coalesce("g1", "g2", "g8", "g9", "g7", "g3", "g5", "g4", "g6").alias("product_group"),
        F.coalesce("c1", "c2", "c8", "c9").alias("product_code"), method.alias("name_match"),
    )


def name_audit(lines: DataFrame, matched: DataFrame, *, invoiced: Column) -> DataFrame:
    """Lines by the way their name was matched: how many, how many with a code and how many of them invoiced.

    ``matched`` is the result of :func:`group_by_name`; lines without a key there count as ``no_name``.
    """
    keys = [c for c in ("name_key", "category_key", "description_key") if c in matched.columns]
    per_key = lines.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(invoiced).alias("n_invoiced"))
    joined = join_on(per_key, matched.select(*keys, "product_code", "name_match"), keys, "left")
    return joined.groupBy(F.coalesce("name_match", F.lit("no_name")).alias("name_match")).agg(
        F.sum("n").alias("lines"), F.sum("n_invoiced").alias("invoiced_lines"),
        F.coalesce(F.sum(F.when(F.col("product_code").isNotNull(), F.col("n"))), F.lit(0)).alias("codes_filled"),
        F.coalesce(F.sum(F.when(F.col("product_code").isNotNull(), F.col("n_invoiced"))), F.lit(0)).alias("invoiced_codes_filled"),
    )


def group_by_context(sales: DataFrame, *, aliases: DataFrame | None = None, group: str = "product_group", row_id: Sequence[str], master: DataFrame | None = None) -> DataFrame:
    """Open rows take the group of their context if it is the only one there.

    Order: alias table (name_key, product_group), same reference, same order, same customer and name, and with a
    ``master`` (name_key, product_group) the one master name that is clearly the most similar.
    """
    out = sales.withColumns({"context_source": F.when(F.col(group).isNotNull(), F.lit(None)).otherwise(F.lit("unmatched")), "_row_open": F.col(group).isNull()})

    def fill(df: DataFrame, keys: Sequence[str], table: DataFrame, tag: str) -> DataFrame:
        # written first: a few hot keys, or none, are then seen to be few before rows are moved to meet them
        table = stage(table, "context-lookup")
        joined = sparse_join(df, table.withColumnRenamed(group, "_g"), keys, F.col(group).isNull(), spread=row_id)
        hit = F.col(group).isNull() & F.col("_g").isNotNull()
        return stage(
            joined.withColumns({"context_source": F.when(hit, F.lit(tag)).otherwise(F.col("context_source")), group: F.coalesce(group, "_g")}).drop("_g"), "context"
        )

    if aliases is not None:
        out = fill(out, ["name_key"], unique_lookup(aliases, ["name_key"], [group]), "alias")
    for keys, tag in ((["reference"], "reference_context"), (["order_id"], "order_context"), (["account_id", "name_key"], "customer_history")):
        out = fill(out, keys, unique_lookup(out.filter(F.col(group).isNotNull()), keys, [group]), tag)
    if master is not None:
        named = first_per_key(master.filter((F.col("name_key") != "") & (F.col(group) != "")), ["name_key"], [(group, "asc")]).select(F.col("name_key").alias("master_key"), group)
        open_names = out.filter(F.col(group).isNull() & (F.col("name_key") != "")).select("name_key").distinct()
        close = fuzzy_best(open_names, "name_key", named, "master_key").join(named, "master_key").select("name_key", group)
        out = fill(out, ["name_key"], close, "fuzzy_high_confidence")
    return out.withColumn("product_group_unknown", F.col(group).isNull()).drop("_row_open")


def lowest_group_of_sales(sales: DataFrame, master: DataFrame, keys: Sequence[str], *, group: str = "lowest_group", order: str = "product_id", row_id: Sequence[str]) -> DataFrame:
    """Lowest master group by any of the product keys, else the sales category or reference."""
    clean = lambda c: F.nullif(tx.code_key(c.cast("string"), drop_spaces=True), F.lit(""))
    table = first_of_columns(master, keys, [group], order, clean).select(F.col("key").alias("_key"), group)
    joined = sparse_join(sales.withColumn("_key", tx.code_key(F.col("sku"), drop_spaces=True)), table, ["_key"], spread=row_id).drop("_key")
    own = F.nullif(F.trim(group), F.lit(""))
    fallback = F.coalesce(F.nullif(F.trim(F.coalesce("category", "reference")), F.lit("")), F.lit("Unmapped product group"))
    return joined.withColumns(
        {
            "product_group_source": F.when(own.isNull(), "sales_category_or_reference").otherwise("product_master_sku"),
            "product_group_code": F.coalesce(own, F.concat(F.lit("sales_category:"), fallback)), group: F.coalesce(own, fallback),
        }
    )


# --------------------------------------------------------------------------- measures from text

_NUM = r"\d+(?:[.,]\d+)?"
_DIM = r"(?:mm|cm|m)"
_SEP = r"\s*[x×]\s*"
_LABELS = {"width": "width|w|leveys", "length": "length|l|pituus", "depth": "depth|d|syvyys|height|h|korkeus"}
_ANY_LABEL = "|".join(_LABELS.values())


def _extract(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def extract_weight(df: DataFrame, text: str) -> DataFrame:
    """First weight in a text: value, unit and grams.  A weight per something (``g/m2``) is not one."""
    low = F.lower(F.col(text))
    pattern = rf"(?U)\b({_NUM})\s*(kilograms|kilogram|kg|grams|gram|g)\b(?!\s*/)"
    value = nm.to_number(_extract(low, pattern, 1))
    unit = F.when(_extract(low, pattern, 2).startswith("k"), "kg").when(_extract(low, pattern, 2).isNotNull(), "g")
    return df.withColumns({"weight_value": value, "weight_unit": F.coalesce(unit, F.lit("")), "weight_g": F.when(unit == "kg", value * 1000).otherwise(value)})


def extract_dimensions(df: DataFrame, text: str) -> DataFrame:
    """Width, length and depth from labelled values, else from ``a x b x c unit``; the status tells which."""
    low = F.lower(F.col(text))
    named = {k: rf"(?U)\b(?:{words})\b\s*[:=]?\s*({_NUM})\s*({_DIM})\b" for k, words in _LABELS.items()}
    value = {k: nm.to_number(_extract(low, p, 1)) for k, p in named.items()}
    unit = {k: _extract(low, p, 2) for k, p in named.items()}
    explicit = F.coalesce(*value.values()).isNotNull()
    no_unit = low.rlike(rf"(?U)\b(?:{_ANY_LABEL})\b\s*[:=]?\s*{_NUM}(?!\s*{_DIM}\b)")
    triple = rf"(?U)({_NUM}){_SEP}({_NUM}){_SEP}({_NUM})\s*({_DIM})\b"
    has_triple = low.rlike(triple)
    bare = low.rlike(rf"(?U){_NUM}{_SEP}{_NUM}{_SEP}{_NUM}(?!\s*{_DIM}\b)")
    status = (
        F.when(low.isNull() | (F.trim(low) == ""), "not_found").when(explicit, "parsed_explicit").when(no_unit, "value_found_unit_missing")
        .when(has_triple, "parsed_assumed_order").when(bare, "value_found_unit_missing").otherwise("not_found")
    )
    out = df.withColumn("dimension_parse_status", status)
    spot = {"length": 1, "width": 2, "depth": 3}
    columns = {}
    for k in _LABELS:
        from_triple = F.when(F.col("dimension_parse_status") == "parsed_assumed_order", nm.to_number(_extract(low, triple, spot[k])))
        columns[f"{k}_value"] = F.when(F.col("dimension_parse_status") == "parsed_explicit", value[k]).otherwise(from_triple)
        columns[f"{k}_unit"] = F.coalesce(
            F.when(F.col("dimension_parse_status") == "parsed_explicit", unit[k]),
            F.when(F.col("dimension_parse_status") == "parsed_assumed_order", _extract(low, triple, 4)), F.lit(""),
        )
    return out.withColumns(columns)


WEIGHT_WORDS = "weight|net weight|gross weight|product weight|item weight|paino|nettopaino|netto paino|bruttopaino|brutto paino|paino noin"
SIZE_WORDS = "dimensions|dimension|size|product size|item size|measurements|length|width|height|depth|mitat|koko|pituus|leveys|korkeus|syvyys"
_PAIR = rf"{_NUM}\s*(?:x|×|\*|by)\s*{_NUM}(?:\s*(?:x|×|\*|by)\s*{_NUM})?"
_LONG_DIM = "(millimeter|millimetre|centimeter|centimetre|mm|cm|m)"


def page_facts(df: DataFrame, text: str) -> DataFrame:
    """Weight and size from page text or a name, found next to their words."""
    low = F.lower(F.col(text))
    weight = [rf"(?U)\b(?:{WEIGHT_WORDS})\b\s*[:\-]?\s*({_NUM})\s*(kilograms|kilogram|kg|grams|gram|g)\b",
              rf"(?U)({_NUM})\s*(kilograms|kilogram|kg|grams|gram|g)\s*(?:\b(?:{WEIGHT_WORDS})\b)"]
    size = [rf"(?U)\b(?:{SIZE_WORDS})\b\s*[:\-]?\s*({_PAIR})\s*{_LONG_DIM}\b", rf"(?U)({_PAIR})\s*{_LONG_DIM}\s*(?:\b(?:{SIZE_WORDS})\b)", rf"(?U)\b({_PAIR})\s*{_LONG_DIM}\b"]
    unit = F.coalesce(*[_extract(low, p, 2) for p in weight])
    spread = F.regexp_replace(F.translate(F.coalesce(*[_extract(low, p, 1) for p in size]), "×*,", "xx."), r"\s*(?:x|\bby\b)\s*", " x ")
    size_unit = F.coalesce(*[_extract(low, p, 2) for p in size])
    return df.withColumns(
        {
            "extracted_weight": F.replace(F.coalesce(*[_extract(low, p, 1) for p in weight]), F.lit(","), F.lit(".")),
            "extracted_weight_unit": F.when(unit.startswith("k"), "kg").when(unit.isNotNull(), "g"),
            "extracted_dimensions": spread,
            "extracted_dimension_unit": F.when(size_unit.startswith("milli"), "mm").when(size_unit.startswith("centi"), "cm").otherwise(size_unit),
        }
    )


def name_score(name: Column, page_text: Column) -> Column:
    """1 if the page holds the whole name, else the share of its words the page holds."""
    text = F.lower(page_text)
    words = tx.name_tokens(name)
    found = F.size(F.filter(words, lambda w: F.contains(text, w)))
    return (
        F.when((F.coalesce(name, F.lit("")) == "") | (F.coalesce(page_text, F.lit("")) == ""), 0.0)
        .when(F.contains(text, F.lower(F.trim(name))), 1.0).when(F.size(words) == 0, 0.0).otherwise(found / F.size(words))
    )


def confidence(score: Column, has_weight: Column, has_size: Column) -> Column:
    any_found, both = has_weight | has_size, has_weight & has_size
    return (
        F.when((score >= 0.9) & both, "high").when((score >= 0.7) & any_found, "high").when((score >= 0.4) & any_found, "medium")
        .when(any_found, "low").otherwise("none")
    )


PAGE_HINTS = ("product", "products", "tuote", "tuotteet", "shop", "catalog", "item", "collection")


def rank_links(products: DataFrame, links: DataFrame, *, n: int = 6, scan: int | None = None) -> DataFrame:
    """Best ``n`` of a site's links (or its first ``scan``) per product: words of the name, half a point per shop hint.

    Words are looked for in the percent-decoded link, and count as often as the name has them.  Products don't meet
    all links of their domain: an index tells the words that a link holds, and products meet links under these words.  Of
    the links that have hints only, a product looks at as many of its domain's best as it may need.

    ``products``: product_id, product_name, domain.  ``links``: domain, link, place.
    """
    near = links if scan is None else links.filter(F.col("place") <= scan)
    low = F.lower(F.coalesce(F.try_url_decode(F.replace("link", F.lit("+"), F.lit("%2B"))), "link"))
    hint = F.lit(0.0)
    for word in PAGE_HINTS:
        hint = hint + F.when(F.col("_low").contains(word), 0.5).otherwise(0.0)
    near = near.withColumns({"_low": low, "_lid": F.monotonically_increasing_id()}).withColumn("_hint", hint)
    near = stage(near.select("_lid", "domain", "link", "place", "_low", "_hint"), "links")
    named = products.select("product_id", "domain", F.explode(tx.name_tokens(F.col("product_name"))).alias("word"))
    named = stage(named.groupBy("product_id", "domain", "word").agg(F.count("*").alias("_times")), "name-words")
    held = contained_names(near, "_lid", "_low", named.select("word").distinct(), "word").select("_lid", "word")
    facts = near.select("_lid", "domain", "link", "place", "_hint")
    met = named.join(held.join(facts, "_lid"), ["domain", "word"]).groupBy("product_id", "domain", "_lid", "link", "place", "_hint").agg(F.sum("_times").alias("_hits"))
    met = stage(met.withColumn("link_score", F.col("_hits") + F.col("_hint")).drop("_hits", "_hint"), "link-hits")
    ranked = grouped_row_number(facts.filter("_hint > 0"), ["domain"], [("_hint", "desc"), ("place", "asc"), ("_lid", "asc")], "_rank")
    asked = products.select("product_id", "domain").join(met.groupBy("product_id").agg(F.count("*").alias("_m")), "product_id", "left")
    hinted = take_places(asked, ranked, ["domain"], "_rank", F.coalesce("_m", F.lit(0)) + n, ["product_id"])
    hinted = hinted.join(met.select("product_id", "_lid"), ["product_id", "_lid"], "left_anti").withColumn("link_score", F.col("_hint"))
    columns = ["product_id", "link", "place", "link_score"]
    both = met.select(*columns).unionByName(hinted.select(*columns))
    return top_n(both, ["product_id"], [("link_score", "desc"), ("place", "asc"), ("link", "asc")], n, "link_rank").select("product_id", "link", "link_score", "link_rank")


def best_page(candidates: DataFrame, products: DataFrame) -> DataFrame:
    """Per product the first fitting page with both measures, else the first with one; else the name itself.

    ``candidates``: product_id, product_name, page_url, page_text, place.  A page fits from a name score of .4.
    """
    facts = page_facts(candidates, "page_text").withColumn("name_score", name_score(F.col("product_name"), F.col("page_text")))
    has_w, has_d = F.col("extracted_weight").isNotNull(), F.col("extracted_dimensions").isNotNull()
    fit = facts.filter((has_w | has_d) & (F.col("name_score") >= 0.4)).withColumn("_both", (has_w & has_d).cast("int"))
    best = first_per_key(fit, ["product_id"], [("_both", "desc"), ("place", "asc")]).withColumn("page_confidence", confidence(F.col("name_score"), has_w, has_d))
    measures = ["extracted_weight", "extracted_weight_unit", "extracted_dimensions", "extracted_dimension_unit"]
    page = best.select("product_id", F.col("page_url").alias("_url"), *[F.col(m).alias(f"_p_{m}") for m in measures], F.col("page_confidence").alias("_conf"))
    own = page_facts(products, "product_name").join(page, "product_id", "left")
    from_page, from_name = F.col("_url").isNotNull(), F.coalesce("extracted_weight", "extracted_dimensions").isNotNull()
    w, d = F.col("_p_extracted_weight").isNotNull(), F.col("_p_extracted_dimensions").isNotNull()
    out = own.withColumns(
        {
            "status": F.when(from_page & w & d, "success_weight_and_dimensions_found").when(from_page & w, "success_weight_found")
            .when(from_page & d, "success_dimensions_found").when(from_name, "fallback_product_name_found").otherwise("not_found"),
            "confidence": F.when(from_page, F.col("_conf")).when(from_name, "low").otherwise("none"),
            "source_url": F.when(from_page, F.col("_url")).when(from_name, "product_name").otherwise(""),
        }
    )
    return out.select("product_id", *[F.when(from_page, F.col(f"_p_{m}")).otherwise(F.col(m)).alias(m) for m in measures], "status", "confidence", "source_url")


# --------------------------------------------------------------------------- measures from suppliers

MEASURES = ("weight_value", "weight_g", "width_value", "length_value", "depth_value")


def set_if_missing(current: Column, value: Column) -> Column:
    """New value where the current one is empty or zero."""
    return F.when(nm.missing_or_zero(current) & value.isNotNull(), value).otherwise(current)


def overwrite_if_nonzero(current: Column, value: Column) -> Column:
    return F.when(F.coalesce(value, F.lit(0.0)) != 0, value).otherwise(current)


def match_suppliers(products: DataFrame, records: DataFrame) -> DataFrame:
    """(record_id, product_id, match_method): exact code, else a code inside the product text, else a single name.

    Later ways only serve records the earlier ones left open.
    """
    keys = F.array(tx.source_code_key(F.col("sku")), tx.source_code_key(F.col("code")))
    exact = index_join(records, "record_id", F.col("match_keys"), products, "product_id", keys)
    open1 = records.join(exact.select("record_id").distinct(), "record_id", "left_anti")
    inside = token_in_text_join(open1, "record_id", F.col("match_keys"), products, "product_id", F.col("search_text"))
    open2 = open1.join(inside.select("record_id").distinct(), "record_id", "left_anti")
    wanted = open2.select("record_id", tx.fold(F.col("product_name")).alias("_name")).filter(F.length("_name") >= 8)
    hits = contained_names(products.select("product_id", tx.search_text(F.col("search_text")).alias("_t")), "product_id", "_t", wanted.select("_name").distinct(), "_name")
    single = hits.groupBy("_name").agg(F.min("product_id").alias("product_id"), F.max("product_id").alias("_hi")).filter(F.col("product_id") == F.col("_hi"))
    named = wanted.join(single.drop("_hi"), "_name").select("record_id", "product_id")
    return (
        exact.withColumn("match_method", F.lit("sku_or_code_exact"))
        .unionByName(inside.withColumn("match_method", F.lit("supplier_key_in_product_text")))
        .unionByName(named.withColumn("match_method", F.lit("product_name_exact_or_unique_contains")))
    )


def merge_supplier_measures(products: DataFrame, records: DataFrame, matches: DataFrame) -> DataFrame:
    """Empty measures filled from the first supplier record that has them; no guess against an existing weight.

    ``weight_g`` is left alone where the stored weight and the supplier's differ by more than two
    units or two percent.  Changed fields are listed.
    """
    joined = matches.join(records, "record_id")
    weight = F.round(F.coalesce(F.nullif(F.col("gross_weight_kg"), F.lit(0.0)), F.nullif(F.col("net_weight_kg"), F.lit(0.0))) * 1000, 3)
    offered = {"weight": weight, "width": F.col("width_cm"), "length": F.col("length_cm"), "depth": F.col("depth_cm")}
    # the first record in source order that offers the measure
    best = joined.groupBy("product_id").agg(
        *[F.min_by(F.when(expr.isNotNull(), expr), F.when(expr.isNotNull(), F.col("record_id"))).alias(f"_{k}") for k, expr in offered.items()],
        F.min("match_method").alias("match_method"),
    )
    out = products.join(best, "product_id", "left")
    stored = nm.to_number(F.col("weight_value"))
    conflict = F.coalesce((stored > 0) & F.col("_weight").isNotNull() & ~nm.close_enough(stored, F.col("_weight")), F.lit(False))
    source = {"weight_value": "_weight", "weight_g": "_weight", "width_value": "_width", "length_value": "_length", "depth_value": "_depth"}
    new = {c: set_if_missing(F.col(c), F.when(~conflict, F.col(s)) if c == "weight_g" else F.col(s)) for c, s in source.items()}
    changed = F.filter(F.array(*[F.when(~F.col(c).eqNullSafe(new[c]), F.lit(c)) for c in MEASURES]), lambda x: x.isNotNull())
    return out.withColumns({"changed_fields": F.array_join(changed, "; "), "weight_conflict": conflict, **{f"_new_{c}": e for c, e in new.items()}}).withColumns(
        {c: F.col(f"_new_{c}") for c in MEASURES}
    ).drop(*[f"_new_{c}" for c in MEASURES], "_weight", "_width", "_length", "_depth")


def stable_boxes(boxes: DataFrame, fields: Sequence[str], *, in_mm: Sequence[str] = ()) -> DataFrame:
    """Carton fields of models whose rows all agree (mm turned to cm)."""
    clean = boxes.select(
        tx.fold(F.col("brand")).alias("brand_key"), tx.fold(F.col("product_name")).alias("name_key"),
        *[F.round(nm.to_number(F.col(f)) / (10 if f in in_mm else 1), 6).alias(f) for f in fields],
    ).filter((F.col("brand_key") != "") & (F.col("name_key") != ""))
    packed = F.struct(*[F.coalesce(F.col(f), F.lit(-1.0)).alias(f) for f in fields])
    same = clean.groupBy("brand_key", "name_key").agg(F.min(packed).alias("lo"), F.max(packed).alias("hi")).filter(F.col("lo") == F.col("hi"))
    return same.select("brand_key", "name_key", *[F.nullif(F.col(f"lo.{f}"), F.lit(-1.0)).alias(f) for f in fields])


def merge_boxes(products: DataFrame, stable: DataFrame, fields: Sequence[str], *, row_id: Sequence[str]) -> DataFrame:
    """Carton fields filled where empty, with a note of the source."""
    keyed = products.withColumns({"brand_key": tx.fold(F.col("brand_name")), "name_key": tx.fold(F.col("product_name"))})
    renamed = stable.select("brand_key", "name_key", *[F.col(f).alias(f"_b_{f}") for f in fields])
    joined = sparse_join(keyed, renamed, ["brand_key", "name_key"], spread=row_id)
    filled = F.lit(False)
    for f in fields:
        filled = filled | (nm.to_number(F.col(f)).isNull() & F.col(f"_b_{f}").isNotNull())
    return joined.withColumn("box_data_source", F.when(filled, "carton list")).withColumns(
        {f: F.when(nm.to_number(F.col(f)).isNull() & F.col(f"_b_{f}").isNotNull(), F.col(f"_b_{f}")).otherwise(F.col(f)) for f in fields}
    ).drop("brand_key", "name_key", *[f"_b_{f}" for f in fields])


def backfill_measures(products: DataFrame, curated: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Empty or zero measures taken from a curated list by id."""
    one = first_per_key(curated.withColumn("_key", tx.numeric_id_key(F.col(key).cast("string"))), ["_key"], [(c, "asc") for c in columns])
    joined = products.withColumn("_key", tx.numeric_id_key(F.col(key).cast("string"))).join(one.select("_key", *[F.col(c).alias(f"_c_{c}") for c in columns]), "_key", "left")
    return joined.withColumns({c: set_if_missing(F.col(c), F.col(f"_c_{c}")) for c in columns}).drop("_key", *[f"_c_{c}" for c in columns])


def with_brands(products: DataFrame, brands: DataFrame, *, row_id: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Brand names by id (0 counts as none), and the ids that have no brand row."""
    keyed = products.withColumn("brand_key", F.nullif(tx.numeric_id_key(F.col("brand_id").cast("string")), F.lit("0")))
    table = first_per_key(brands.withColumn("brand_key", tx.numeric_id_key(F.col("brand_id").cast("string"))), ["brand_key"], [("brand_name", "asc")]).select("brand_key", "brand_name")
    joined = sparse_join(keyed, table, ["brand_key"], spread=row_id)
    unmapped = joined.filter((F.coalesce("brand_key", F.lit("")) != "") & F.col("brand_name").isNull()).groupBy("brand_key").agg(F.count("*").alias("products"))
    return joined.drop("brand_key"), unmapped


def variant_facts(products: DataFrame, *, options: str = "options", shown: int = 5) -> DataFrame:
    """Number of variants, of active ones, and a sample of their codes (array of struct code, status)."""
    opts = F.coalesce(F.col(options), F.array().cast("array<struct<code:string,status:int>>"))
    return products.withColumns(
        {
            "variant_count": F.size(opts), "active_variant_count": F.size(F.filter(opts, lambda o: o["status"] == 1)),
            "variant_codes": F.array_join(F.slice(F.transform(opts, lambda o: o["code"]), 1, shown), ", "),
        }
    )


def new_or_missing(products: DataFrame, old_master: DataFrame, code: str) -> DataFrame:
    from ledgerlift.operators.lookup import flag_member

    old = old_master.select(tx.code_key(F.col(code)).alias("_code"))
    return flag_member(products.withColumn("_own", tx.code_key(F.col(code))), "_own", old, "_code", "_in").withColumn(
        "is_new_or_missing", ~F.col("_in")
    ).drop("_own", "_in")
