"""Data-quality metrics, checks, summaries and review lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlift.functions import numbers as nm
from ledgerlift.functions import text as tx
from ledgerlift.operators.aggregates import metrics_long, top_words
from ledgerlift.operators.lookup import flag_member
from ledgerlift.operators.ranking import exact_quantiles, head, join_on
from ledgerlift.plans import taxonomy as tax


def sales_quality(sales: DataFrame, *, statuses: Sequence[str], group: str, excluded: Sequence[str], value: str = "total_value") -> DataFrame:
    """Rows and euros of a sales table by status and group state, with coverage of the model scope; one pass."""
    v = nm.zero_if_null(F.col(value))
    invoiced = F.coalesce(F.lower(F.trim("status")).isin(*[s.lower() for s in statuses]), F.lit(False))
    code = F.trim(group)
    missing, out = F.coalesce(code == "", F.lit(True)) | code.isNull(), F.coalesce(code.isin(*excluded), F.lit(False))
    scope = invoiced & ~out & F.col("sold_on").isNotNull()
    eur = lambda cond: F.round(F.sum(F.when(cond, v).otherwise(0.0)), 2)
    return metrics_long(
        sales,
        {
            "source_sales_rows": F.count("*"), "source_sales_eur": F.round(F.sum(v), 2), "invoiced_sales_rows": F.count_if(invoiced), "invoiced_sales_eur": eur(invoiced),
            "missing_product_group_rows": F.count_if(missing), "missing_product_group_sales_eur": eur(missing), "invoiced_missing_product_group_rows": F.count_if(invoiced & missing),
            "excluded_product_group_rows": F.count_if(invoiced & out), "excluded_product_group_sales_eur": eur(invoiced & out),
            "model_sales_rows_after_filters": F.count_if(scope), "model_sales_eur_after_filters": eur(scope),
            "model_row_coverage_pct": F.round(100.0 * F.count_if(scope) / F.count("*"), 2), "model_sales_coverage_pct": F.round(100.0 * F.sum(F.when(scope, v).otherwise(0.0)) / F.sum(v), 2),
        },
    )


def confidence_by_method(history: DataFrame) -> DataFrame:
    return history.groupBy("product_group_match_method").agg(
        F.count("*").alias("lines"), F.round(F.avg("product_group_match_confidence"), 4).alias("avg_confidence")
    )


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Surplus rows of repeated keys, as one metric row."""
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    return counts.agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n") - 1)), F.lit(0)).cast("double").alias("value")).select(
        F.lit(f"duplicate_{key}").alias("metric"), "value"
    )


def input_validation(sales: DataFrame, accounts: DataFrame, companies: DataFrame) -> DataFrame:
    """Row counts, bad values, date range, join hits and duplicates of the inputs, long form."""
    v = F.col("total_value")
    invoiced = F.lower(F.trim("status")) == "invoiced"
    s = metrics_long(
        sales,
        {
            "sales_rows": F.count("*"), "invoiced_rows": F.count_if(invoiced), "bad_dates": F.count_if(F.col("sold_on").isNull()), "missing_account_id": F.count_if(F.col("account_id").isNull()),
            "bad_values": F.count_if(v.isNull()), "zero_or_negative_values": F.count_if(nm.zero_if_null(v) <= 0), "invoiced_zero_or_negative": F.count_if(invoiced & (v <= 0)),
            "first_day": F.min(F.unix_date("sold_on")), "last_day": F.max(F.unix_date("sold_on")),
        },
    )
    per_account = sales.filter(F.col("account_id").isNotNull()).groupBy("account_id").agg(F.count("*").alias("_n"))
    hits = flag_member(per_account, "account_id", accounts, "account_id", "_hit").agg(
        F.sum("_n").cast("double").alias("sales_rows_with_account_id"), F.coalesce(F.sum(F.when(F.col("_hit"), F.col("_n"))), F.lit(0)).cast("double").alias("sales_rows_in_register")
    ).unpivot([], ["sales_rows_with_account_id", "sales_rows_in_register"], "metric", "value")
    a = metrics_long(accounts, {"account_rows": F.count("*"), "accounts_without_business_id": F.count_if(F.col("business_id").isNull())})
    known = flag_member(accounts.filter(F.col("business_id").isNotNull()), "business_id", companies, "business_id", "_hit")
    c = metrics_long(known, {"accounts_with_business_id": F.count("*"), "accounts_in_company_register": F.count_if("_hit")})
    return s.unionByName(hits).unionByName(a).unionByName(c).unionByName(duplicate_keys(accounts, "account_id")).unionByName(duplicate_keys(companies, "business_id"))


def technical_checks(customers: DataFrame, recommendations: DataFrame, validation: DataFrame) -> DataFrame:
    """Named checks with a value and pass, review or info."""
    base = metrics_long(
        customers,
        {
            "customer_potential_rows": F.count("*"), "matched_model_rows": F.count("model_estimated_potential_eur"),
            "unmatched_model_rows": F.count_if(F.col("model_estimated_potential_eur").isNull()), "missing_business_id_rows": F.count_if(F.col("business_id").isNull()),
        },
    )
    twice = duplicate_keys(customers, "business_id").withColumn("metric", F.lit("one_row_per_non_empty_business_id"))
    others = metrics_long(recommendations, {"recommendation_rows": F.count("*")}).unionByName(metrics_long(validation, {"validation_rows": F.count("*")}))
    checked = F.col("metric").isin("unmatched_model_rows", "missing_business_id_rows", "one_row_per_non_empty_business_id")
    status = F.when(~checked, "info").when(F.col("value") > 0, "review").otherwise("pass")
    return base.unionByName(twice).unionByName(others).select(F.col("metric").alias("check"), "value", status.alias("status"))


def status_summary(validation: DataFrame, status: str = "validation_match_status") -> DataFrame:
    total = validation.agg(F.count("*").alias("n")).scalar()
    return validation.groupBy(F.coalesce(status, F.lit("missing_status")).alias(status)).agg(F.count("*").alias("rows")).withColumn(
        "share_of_rows", F.col("rows") / total
    )


def group_summary(df: DataFrame, key: str, value: str, score: str) -> DataFrame:
    """Rows, mean score, median and total potential per group; the median is exact and group-size proof."""
    sums = df.groupBy(key).agg(
        F.count("*").alias("rows"), F.count(value).alias("matched_rows"), F.avg(score).alias("avg_score"), F.sum(value).alias("total_potential_eur")
    )
    medians = exact_quantiles(df.select(key, value), [key], value, [0.5]).select(key, F.col("value").alias("median_potential_eur"))
    return join_on(sums, medians, [key], "left")


DISTRIBUTION_POINTS = {"p10": 0.10, "p25": 0.25, "median": 0.50, "p75": 0.75, "p90": 0.90}


def distribution(df: DataFrame, column: str, label: str) -> DataFrame:
    """Count, range, quantiles, mean and sum of one column as one row."""
    points = exact_quantiles(df, [], column, list(DISTRIBUTION_POINTS.values())).agg(
        *[F.max(F.when(F.col("quantile") == p, F.col("value"))).alias(n) for n, p in DISTRIBUTION_POINTS.items()]
    )
    row = df.agg(
        F.lit(label).alias("metric"), F.count(column).alias("count"), F.min(column).alias("min"), F.max(column).alias("max"), F.avg(column).alias("mean"), F.sum(column).alias("sum")
    )
    packed = points.select(F.struct(*DISTRIBUTION_POINTS).alias("p")).scalar()
    return row.withColumn("_p", packed).select(*row.columns, "_p.*")


def review_queue(df: DataFrame, condition: Column, order: Sequence[tuple[str, str]], name: str, n: int = 100) -> DataFrame:
    return head(df.filter(condition), order, n).withColumn("queue", F.lit(name))


def review_queues(customers: DataFrame, validation: DataFrame, recommendations: DataFrame, *, n: int = 100) -> DataFrame:
    """The lists people look through, long form ``(queue, business_id, value)``."""
    p90 = exact_quantiles(customers, [], "model_estimated_potential_eur", [0.90]).select("value").scalar()
    v = validation.withColumn("absolute_diff_eur", F.abs("potential_diff_eur"))
    model = nm.zero_if_null(F.col("model_estimated_potential_eur"))
    low = customers.withColumn("_p90", p90)
    queues = [
        (v, F.col("potential_diff_eur").isNotNull(), "absolute_diff_eur", "desc", "top_crm_model_diff", n),
        (v, F.col("validation_match_status") == "model_higher", "potential_diff_eur", "desc", "top_model_higher", n),
        (v, F.col("validation_match_status") == "crm_higher", "potential_diff_eur", "asc", "top_crm_higher", n),
        (v, (nm.zero_if_null(F.col("crm_potential_eur")) == 0) & (model > 0), "model_estimated_potential_eur", "desc", "zero_crm_high_model", n),
        (customers, F.col("priority") == "A", "model_estimated_potential_eur", "desc", "a_priority_customers", n),
        (low, F.col("priority").isin("C", "D") & (model > F.col("_p90")), "model_estimated_potential_eur", "desc", "large_low_priority", n),
        (customers, F.col("business_id").isNull(), "model_estimated_potential_eur", "desc", "missing_business_id", 5 * n),
        (recommendations, F.lit(True), "recommended_group_potential_eur", "desc", "product_group_white_space", n),
        (recommendations, (nm.zero_if_null(F.col("customer_sales_eur")) > 0) & (F.col("white_space_gap") > 0), "recommended_group_potential_eur", "desc", "product_group_sanity", n),
    ]
    out = None
    for df, condition, value, way, name, size in queues:
        order = [(value, way), ("business_id", "asc")]
        if "product_group" in df.columns:
            order.append(("product_group", "asc"))
        part = review_queue(df, condition, order, name, size).select("queue", "business_id", F.col(value).cast("double").alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


def prior_comparison(outputs: dict[str, DataFrame], score: str, potential: str) -> DataFrame:
    """Score and potential of several outputs side by side."""
    rows = None
    for name, df in outputs.items():
        s, p = distribution(df, score, name), distribution(df, potential, name)
        row = s.select(F.col("metric").alias("source"), F.col("count").alias("score_count"), F.col("median").alias("score_median"), F.col("p90").alias("score_p90")).join(
            p.select(F.col("metric").alias("source"), F.col("count").alias("potential_count"), F.col("median").alias("potential_median_eur"), F.col("p90").alias("potential_p90_eur"), F.col("sum").alias("potential_total_eur")),
            "source",
        )
        rows = row if rows is None else rows.unionByName(row)
    return rows


def run_log(customers: DataFrame, settings: dict[str, object], extra: DataFrame | None = None) -> DataFrame:
    """Counts of a run and its settings as ``(metric, value)`` text rows."""
    counts = metrics_long(
        customers, {"output_rows": F.count("*"), "matched_rows": F.count("model_estimated_potential_eur"), "missing_business_id_rows": F.count_if(F.col("business_id").isNull())}
    ).select("metric", F.col("value").cast("bigint").cast("string").alias("value"))
    pairs = F.array(*[F.struct(F.lit(k).alias("metric"), F.lit(str(v)).alias("value")) for k, v in settings.items()])
    fixed = counts.agg(F.count("*")).select(F.explode(pairs).alias("s")).select("s.metric", "s.value")
    out = counts.unionByName(fixed)
    return out.unionByName(extra.select("metric", F.col("value").cast("string").alias("value"))) if extra is not None else out


def quality_rows(customers: DataFrame, row_id: str) -> DataFrame:
    """Rows with a problem and the reasons."""
    reasons = F.filter(
        F.array(F.when(F.col("business_id").isNull(), "missing_business_id"), F.when(F.col("model_estimated_potential_eur").isNull(), "not_matched_to_model")),
        lambda r: r.isNotNull(),
    )
    return customers.withColumn("reason", F.array_join(reasons, "; ")).filter("reason <> ''").select(row_id, "business_id", "reason")


def product_quality(products: DataFrame) -> DataFrame:
    """Coverage of measures and categories."""
    filled = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    size = F.coalesce("width_value", "length_value", "depth_value").isNotNull()
    full = filled("warehouse_category") & filled("category_level_2") & filled("category_level_3")
    return metrics_long(
        products,
        {
            "total_products": F.count("*"), "products_with_weight": F.count("weight_value"), "products_without_weight": F.count_if(F.col("weight_value").isNull()),
            "products_with_dimensions": F.count_if(size), "products_without_dimensions": F.count_if(~size), "products_with_warehouse_category": F.count_if(filled("warehouse_category")),
            "products_with_category_level_2": F.count_if(filled("category_level_2")), "products_with_category_level_3": F.count_if(filled("category_level_3")), "products_with_full_category_hierarchy": F.count_if(full),
        },
    )


def tree_statistics(products: DataFrame, levels: Sequence[str], other: Column) -> DataFrame:
    """Coverage, share of "other" groups and sizes of the leaves."""
    base = metrics_long(products, {"products": F.count("*"), "grouped_products": F.count_if(F.col(levels[0]).isNotNull()), "other_products": F.count_if(other)})
    leaves = products.groupBy(*levels).agg(F.count("*").alias("n"))
    sizes = metrics_long(leaves, {"leaf_groups": F.count("*"), "largest_leaf": F.max("n"), "smallest_leaf": F.min("n"), "leaves_under_5": F.count_if(F.col("n") < 5)})
    return base.unionByName(sizes)


def missing_by_name(rows: DataFrame, name: str, value: str, group: str) -> DataFrame:
    """Rows without a group, added up per name: a work list."""
    missing = rows.filter(F.coalesce(F.trim(group), F.lit("")) == "")
    return missing.groupBy(F.coalesce(F.lower(F.trim(name)), F.lit("")).alias("name_key")).agg(F.count("*").alias("rows"), F.sum(value).alias("sales_eur"))


def missing_summary(rows: DataFrame, *, name: str, value: str, code: str, group: str, method: str) -> DataFrame:
    """(metric, value): rows with and without a group, rows without a product code, their euros and names, rows by match method."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    names = rows.filter(blank(code)).groupBy(F.coalesce(name, F.lit("")).alias("_name")).agg(F.count("*").alias("_n"))
    parts = [
        metrics_long(rows, {
            "total_rows": F.count("*"), "rows_with_group": F.count_if(~blank(group)), "rows_missing_group": F.count_if(blank(group)), "missing_code_rows": F.count_if(blank(code)),
            "missing_code_sales_eur": F.round(F.coalesce(F.sum(F.when(blank(code), F.coalesce(value, F.lit(0.0)))), F.lit(0.0)), 2),
        }),
        metrics_long(names, {
            "unique_missing_code_names": F.count("*"), "repeated_missing_code_names": F.count_if(F.col("_n") > 1),
            "rows_in_repeated_missing_code_names": F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n"))), F.lit(0)),
        }),
        rows.groupBy(F.concat(F.lit("method:"), F.coalesce(method, F.lit(""))).alias("metric")).agg(F.count("*").cast("double").alias("value")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def missing_worklist(rows: DataFrame, *, code: str, key: Sequence[str], fill: Sequence[str]) -> DataFrame:
    """Rows without a product code, with the key by which they are updated and empty columns to fill in."""
    missing = rows.filter(F.coalesce(F.trim(code), F.lit("")) == "")
    return missing.withColumns({"update_key": F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key]), **{c: F.lit(None).cast("string") for c in fill}})


def review_analysis(products: DataFrame, rules: Sequence[tax.Rule], *, levels: Sequence[str], source: str, supplier: str, brand: str, texts: Sequence[str], stop_words: Sequence[str], words: int = 40) -> DataFrame:
    """(table, key, product_count) of the products under review: by group, supplier, brand and suggested group, by source mark, by word.

    ``source`` holds marks between ``|``.  A suggestion is its confidence, path and rule; products that no rule knows are
    ``manual``.  The first four tables come from one pass of grouping sets; of the words only the commonest are shown.
    """
    text = F.concat_ws(" ", *texts)
    judged = tax.classify(products, rules, tx.fold(text), "_g").withColumn(
        "_suggested", F.concat_ws(" | ", F.coalesce("_g.confidence", F.lit("manual")), F.concat_ws(" > ", *[F.nullif(F.col(f"_g.l{i + 1}"), F.lit("")) for i in range(3)]), F.coalesce("_g.source", F.lit("no rule")))
    )
    # columns of their own, as a level may be the brand too
    kinds = {"group": [f"_level{i}" for i in range(len(levels))], "supplier": ["_supplier"], "brand": ["_brand"], "suggestion": ["_suggested"]}
    judged = judged.withColumns({f"_level{i}": F.col(c) for i, c in enumerate(levels)} | {"_supplier": F.col(supplier), "_brand": F.col(brand)})
    columns = [c for part in kinds.values() for c in part]
    label, key = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, part in kinds.items():
        here = F.grouping(part[0]) == 0
        label, key = F.when(here, F.lit(kind)).otherwise(label), F.when(here, F.concat_ws(" > ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in part])).otherwise(key)
    counted = judged.groupingSets(list(kinds.values()), *columns).agg(label.alias("table"), key.alias("key"), F.count("*").alias("product_count")).select("table", "key", "product_count")
    marks = products.select(F.explode(F.split(F.coalesce(source, F.lit("")), r"\|")).alias("key")).groupBy("key").agg(F.count("*").alias("product_count"))
    common = top_words(products, text, words, stop_words)
    return counted.unionByName(marks.withColumn("table", F.lit("source"))).unionByName(common.select(F.lit("word").alias("table"), F.col("word").alias("key"), F.col("word_count").alias("product_count")))


def status_impact(sales: DataFrame, base: str, added: str, group: str, excluded: Sequence[str], *, value: str = "total_value") -> DataFrame:
    """What including another status would change: rows, euros and accounts of base, increment and both."""
    usable = ~F.coalesce(F.trim(group).isin(*excluded), F.lit(False)) & F.col("account_id").isNotNull() & F.col("sold_on").isNotNull()
    status = F.lower(F.trim("status"))
    scopes = {"current": status == base.lower(), "increment": status == added.lower(), "combined": status.isin(base.lower(), added.lower())}
    metrics = {}
    for name, cond in scopes.items():
        use = F.coalesce(cond & usable, F.lit(False))
        metrics[f"{name}_rows"] = F.count_if(use)
        metrics[f"{name}_eur"] = F.round(F.sum(F.when(use, F.col(value)).otherwise(0.0)), 2)
        metrics[f"{name}_accounts"] = F.count_distinct(F.when(use, F.col("account_id")))
    return metrics_long(sales, metrics)


def status_by_year(sales: DataFrame, statuses: Sequence[str], *, value: str = "total_value") -> DataFrame:
    keep = sales.filter(F.lower(F.trim("status")).isin(*[s.lower() for s in statuses]))
    return keep.groupBy(F.year("sold_on").alias("year"), F.trim("status").alias("status")).agg(
        F.count("*").alias("rows"), F.round(F.sum(value), 2).alias("sales_eur"), F.count_distinct("account_id").alias("accounts")
    )


def account_join_audit(months: DataFrame, accounts: DataFrame) -> DataFrame:
    """Share of accounts and euros of the model input that the register knows."""
    per_account = months.groupBy("account_id").agg(F.sum("total_value").alias("v"))
    flagged = flag_member(per_account, "account_id", accounts, "account_id", "_hit")
    return metrics_long(
        flagged,
        {
            "accounts": F.count("*"), "accounts_found": F.count_if("_hit"), "accounts_found_pct": F.round(100.0 * F.count_if("_hit") / F.count("*"), 2),
            "eur_found_pct": F.round(100.0 * F.sum(F.when(F.col("_hit"), F.col("v")).otherwise(0.0)) / F.sum("v"), 2),
        },
    )
