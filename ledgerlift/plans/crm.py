"""CRM rows: matching to accounts and validation of model figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlift.functions import numbers as nm
from ledgerlift.functions import text as tx
from ledgerlift.operators.aggregates import fold_distinct, merge_folded
from ledgerlift.operators.lookup import flag_member, sparse_join, unique_containment
from ledgerlift.operators.ranking import first_per_key


def match_customers(crm: DataFrame, accounts: DataFrame) -> DataFrame:
    """Business id of each CRM row: its own, by account id, by name, or by a name that is part of exactly one other.

    Later steps only touch rows the earlier ones left open; ``match_method`` tells which step it was.
    """
    known = accounts.filter(F.col("business_id").isNotNull()).select(
        "account_id", F.col("business_id").alias("_bid"), tx.name_for_matching(F.col("account_name")).alias("_name")
    )
    rows = crm.withColumns({"name_key": tx.name_for_matching(F.col("name")), "match_method": F.when(F.col("business_id").isNotNull(), "business_id")})

    def take(df: DataFrame, method: str) -> DataFrame:
        hit = F.col("business_id").isNull() & F.col("_bid").isNotNull()
        return df.withColumns(
            {"match_method": F.when(hit, F.lit(method)).otherwise(F.col("match_method")), "business_id": F.coalesce("business_id", "_bid")}
        ).drop("_bid")

    open_row = F.col("business_id").isNull()
    by_account = first_per_key(known, ["account_id"], [("_bid", "asc")]).select("account_id", "_bid")
    rows = take(sparse_join(rows, by_account, ["account_id"], open_row, spread=["crm_row_id"]), "account_id")
    by_name = first_per_key(known.filter(F.col("_name").isNotNull()), ["_name"], [("account_id", "asc")]).select(F.col("_name").alias("name_key"), "_bid")
    rows = take(sparse_join(rows, by_name, ["name_key"], open_row, spread=["crm_row_id"]), "name")
    contained = unique_containment(rows.filter(open_row), "crm_row_id", "name_key", known, "_name", "_bid")
    return take(rows.join(contained, "crm_row_id", "left"), "contained_name")


def crm_by_business(crm: DataFrame, accounts: DataFrame) -> DataFrame:
    """CRM rows added up per name, matched to accounts by name, then per business id.

    A name that belongs to several businesses goes to the first of them and is marked ambiguous.
    """
    rows = crm.withColumns(
        {
            "_name": tx.name_of_account(F.col("name")), "_sales": nm.zero_if_null(F.col("sales")),
            "_chance": nm.share_of_one(F.col("probability"), missing=0.0, bounded=True),
        }
    ).filter(F.col("_name") != "").withColumn("_expected", F.col("_sales") * F.col("_chance"))
    by_name = rows.groupBy("_name").agg(
        F.min_by("name", "crm_row_id").alias("crm_name"), F.count("*").alias("crm_source_row_count"), F.sum("_sales").alias("crm_sales_eur"),
        F.sum("_expected").alias("crm_expected_sales_eur"), F.max("_chance").alias("crm_max_probability"),
    )
    text = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    statuses = fold_distinct(rows.withColumn("_t", text(F.col("status"))), ["_name"], "_t", "crm_statuses")
    types = fold_distinct(rows.withColumn("_t", text(F.col("type"))), ["_name"], "_t", "crm_types")
    by_name = by_name.join(statuses, "_name", "left").join(types, "_name", "left")
    names = accounts.filter(F.col("business_id").isNotNull()).select(tx.name_of_account(F.col("account_name")).alias("_name"), "business_id")
    names = names.filter(F.col("_name") != "").groupBy("_name").agg(
        F.min("business_id").alias("business_id"), (F.min("business_id") != F.max("business_id")).alias("_ambiguous")
    )
    matched = by_name.join(names, "_name")
    return matched.groupBy("business_id").agg(
        F.min_by("crm_name", "_name").alias("crm_name"), F.sum("crm_source_row_count").alias("crm_source_row_count"), F.sum("crm_sales_eur").alias("crm_sales_eur"),
        F.sum("crm_expected_sales_eur").alias("crm_expected_sales_eur"), F.max("crm_max_probability").alias("crm_max_probability"),
        F.when(F.bool_or("_ambiguous"), "name_match_ambiguous").otherwise("name_match_unique").alias("crm_match_quality"),
    ).join(merge_folded(matched, ["business_id"], "crm_statuses", "crm_statuses"), "business_id", "left").join(
        merge_folded(matched, ["business_id"], "crm_types", "crm_types"), "business_id", "left"
    )


def crm_validation(potential_case: DataFrame, crm: DataFrame, accounts: DataFrame, *, value: str = "realistic_potential_eur") -> DataFrame:
    """Model potential next to the CRM's: raised where the CRM expects more, status at 20 percent."""
    frame = potential_case.join(crm_by_business(crm, accounts), "business_id", "left")
    original, expected = nm.zero_if_null(F.col(value)), F.col("crm_expected_sales_eur")
    found = F.col("crm_source_row_count").isNotNull()
    return frame.withColumns(
        {
            "crm_found": found,
            "crm_validated_potential_eur": F.when(found & (expected > original), expected).otherwise(original),
            "crm_value_action": F.when(~found, "kept_original_no_crm_match").when(expected > original, "raised_to_crm_expected_sales")
            .when(expected <= original, "kept_original_model_not_below_crm").otherwise("kept_original"),
            "crm_potential_diff_eur": original - expected,
            "crm_potential_diff_pct": nm.ratio(original - expected, F.nullif(expected, F.lit(0.0))),
            "crm_validation_status": F.when(~found, "missing_in_crm_kept_original").when(expected > original * 1.20, "model_may_be_too_low")
            .when(original > expected * 1.20, "model_above_crm_pipeline").otherwise("aligned_with_crm"),
            "crm_source_row_count": F.coalesce("crm_source_row_count", F.lit(0)),
            "crm_match_quality": F.coalesce("crm_match_quality", F.lit("missing_in_crm")),
            "crm_statuses": F.coalesce("crm_statuses", F.lit("")), "crm_types": F.coalesce("crm_types", F.lit("")), "crm_name": F.coalesce("crm_name", F.lit("")),
        }
    )


def model_vs_crm(customers: DataFrame, all_scored: DataFrame | None = None) -> DataFrame:
    """Status of model against CRM potential; close is 10 percent or 1000 euros, whichever is more.

    Account customers without a CRM row are appended as ``missing_in_crm``.
    """
    model, crm = F.col("model_estimated_potential_eur"), F.col("crm_potential_eur")
    band = F.greatest(F.abs(crm) * 0.10, F.lit(1000.0))
    diff = model - crm
    out = customers.withColumns(
        {
            "potential_diff_eur": diff,
            "potential_diff_pct": nm.ratio(diff, F.nullif(crm, F.lit(0.0))),
            "validation_match_status": F.when(F.col("business_id").isNull(), "missing_business_id").when(model.isNull(), "missing_in_model")
            .when(F.abs(diff) <= band, "exact_or_close").when(diff > band, "model_higher").when(diff < -band, "crm_higher").otherwise("missing_in_crm"),
        }
    )
    if all_scored is None:
        return out
    have = flag_member(all_scored.filter(F.col("is_account_customer") & F.col("business_id").isNotNull()), "business_id", customers, "business_id", "_in")
    missing = have.filter(~F.col("_in")).select(
        "business_id", F.col("company").alias("name"), F.col("estimated_potential_eur").cast("double").alias("model_estimated_potential_eur"),
        F.lit("missing_in_crm").alias("validation_match_status"),
    )
    return out.unionByName(missing, allowMissingColumns=True)
